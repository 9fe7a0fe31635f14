"""Decision analytics for card transactions, written as Spark jobs.

``sources``   schemas, scans and sinks
``functions`` column expressions, no Spark action anywhere
``operators`` DataFrame in, DataFrame out
``plans``     whole jobs built from operators
``streaming`` Structured Streaming queries
"""
