"""The folder that driver and executors share, and numpy files in it."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cardtide.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the one that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage is cut, executors may be lost."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of frames that nothing refers to any more.

    It does so when the driver's JVM next collects garbage, which may be long after. For steps that have written their
    results, which later steps read instead of the shuffle; drop the step's frames first.
    """
    gc.collect()
    spark._jvm.System.gc()


def delete_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder that this run made and no longer reads, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_array(uri: str, values: np.ndarray) -> None:
    """Write one array. A repeated task replaces the file by the same content."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.save(out, values)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as out:
        np.save(out, values)


def map_array(uri: str) -> np.ndarray:
    """Memory-map an array. From a store that is no file system, a copy without a name is mapped."""
    path = _local(uri)
    if path is not None:
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(inner) as source, tempfile.NamedTemporaryFile() as copy:
        while block := source.read(1 << 20):
            copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")  # the mapping outlives the name
