"""The queries of the operators in this subpackage, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardtide.llm import (
    decontamination, jaccard, language_model, licenses, manifest, neighbours, periodic, personal, pieces, quotations, secrets, toxicity, url_filter,
)
from cardtide.llm.words import UPPER


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    return quotations.linked_messages(table(spark, folder, "conversations"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"))


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.perplexity_report(table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_report(table(spark, folder, "documents"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest_report(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_report(table(spark, folder, "documents"))


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_report(table(spark, folder, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_model": op4_language_model,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_quotation_linking": op7_quotation_linking,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: CRC-32 of an ASCII text, from a table that is derived from the reflected polynomial.
_CRC_TABLE = """
    crc_table AS (
        SELECT list(c ORDER BY i) AS crcs FROM (
            SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
            FROM range(256) r(i)
        )
    )"""


def _crc(text: str) -> str:
    """For rows that are joined with ``crc_table``, which has one row."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1])"
    return f"xor(list_reduce({codes}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_FIELDS = [_field(name) for name in ("doc_id", "source", "lang", "text")]

#: The notices' words again, apart from the operator.
_NOTICES = """
    ('apache-2.0', 'licensed under the apache license version 2 0'),
    ('gpl-3.0', 'this work is licensed under the gnu general public license version 3'),
    ('lgpl', 'this library is licensed under the gnu lesser general public license'),
    ('cc-by-nc-4.0', 'licensed under cc by nc 4 0'),
    ('cc-by-sa', 'licensed under a creative commons attribution sharealike license'),
    ('mit', 'released under the mit license'),
    ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
    ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
    ('mpl-2.0', 'this source code form is subject to the terms of the mozilla public license v 2 0'),
    ('all-rights', 'copyright all rights reserved no part may be reproduced without written permission')"""

ORACLES = {
    "op1_license_scan": f"""
WITH docs AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
base AS (
    SELECT doc_id, len(w) AS n, p, label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM docs),
        (VALUES ('cc by', 2, 'cc-by'), ('general public license', 3, 'gpl'), ('all rights reserved', 3, 'reserved')) x(phrase, l, label)
    WHERE array_to_string(w[p + 1:p + l], ' ') = phrase
),
based AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS names FROM base GROUP BY ALL),
notices AS (SELECT label, list_distinct(string_split(words, ' ')) AS t FROM (VALUES {_NOTICES}) x(label, words)),
blocks AS (SELECT doc_id, w[32 * k + 1:32 * k + 64] AS b FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 31) // 32)) AS k FROM docs)),
matched AS (
    SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS share, len(list_intersect(t, b)) AS i, len(t) AS l FROM blocks, notices
),
found AS (
    SELECT doc_id, list(DISTINCT label) AS names, max(share) AS share FROM matched
    WHERE 5 * i >= 4 * l GROUP BY ALL
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(based.names), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(based.names, found.names))), ','), '') AS labels,
    CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM docs LEFT JOIN based USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op8_jaccard_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_SPACED} AS w FROM documents),
shingled AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 3) - 1], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY ALL),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
    FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * i >= 90 * (x.n + y.n - i)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a
),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least_of USING (doc_id)""",
    "op10_decontamination": f"""
WITH docs AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
items AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS phrase
    FROM (
        SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p
        FROM items WHERE len(w) > 0
    )
),
doc_windows AS (
    SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS phrase
    FROM (
        SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p
        FROM docs, (SELECT DISTINCT l FROM item_windows) WHERE len(w) >= l
    )
),
hits AS (SELECT doc_id, l, p, item_id FROM doc_windows JOIN item_windows USING (l, phrase)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS place FROM hits) GROUP BY ALL),
found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
        array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names
    FROM hits GROUP BY ALL
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
coded AS (
    SELECT *, {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS hit, {_FIELDS[0]} AS i, {_FIELDS[1]} AS s, {_FIELDS[2]} AS l, {_FIELDS[3]} AS t
    FROM documents, crc_table
),
leaves AS (
    SELECT doc_id, lang, sha256(i || s || l || {_field("n_chars")} || t) AS leaf,
        sha256(i || s || l || {_field("n_chars + CASE WHEN hit THEN 1 ELSE 0 END")} || t) AS tampered
    FROM coded
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS w FROM leaves
),
level AS (
    SELECT lang, 0 AS k, i, w, leaf AS h FROM numbered
    UNION ALL
    SELECT lang, k + 1, i // 2, (w + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM level WHERE w > 1 GROUP BY lang, k, w, i // 2
),
subroots AS (
    SELECT lang, k AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS w FROM level WHERE w = 1
),
top AS (
    SELECT 0 AS k, g AS i, w, subroot AS h FROM subroots
    UNION ALL
    SELECT k + 1, i // 2, (w + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE w > 1 GROUP BY k, w, i // 2
),
path AS (
    SELECT doc_id, k, n.i >> k AS at, x.h
    FROM numbered n JOIN level x ON n.lang IS NOT DISTINCT FROM x.lang AND x.w > 1 AND x.i = xor(n.i >> k, CAST(1 AS BIGINT))
    UNION ALL
    SELECT doc_id, height + k, g >> k, x.h
    FROM numbered n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang JOIN top x ON x.w > 1 AND x.i = xor(g >> k, CAST(1 AS BIGINT))
),
steps AS (
    SELECT n.doc_id, s.height + (SELECT max(k) FROM top) AS height, n.tampered, s.subroot
    FROM numbered n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang
),
fold AS (
    SELECT doc_id, 0 AS k, height, tampered AS h FROM steps
    UNION ALL
    SELECT f.doc_id, f.k + 1, height, sha256(CASE WHEN p.h IS NULL THEN f.h WHEN p.at % 2 = 1 THEN p.h || f.h ELSE f.h || p.h END)
    FROM fold f LEFT JOIN path p ON p.doc_id = f.doc_id AND p.k = f.k WHERE f.k < height
),
proofs AS (SELECT doc_id, string_agg(h, '' ORDER BY k) AS proof FROM path GROUP BY ALL)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, fold.h AS folded_root, fold.h = top.h AS verified
FROM numbered JOIN steps USING (doc_id) JOIN fold USING (doc_id) LEFT JOIN proofs USING (doc_id), top
WHERE fold.k = fold.height AND top.w = 1""",
    "op12_periodic_runs": f"""
WITH {_CRC_TABLE},
split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h
    FROM documents, crc_table
),
placed AS (SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
words AS (
    SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
        THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END])
        ELSE w END AS w
    FROM placed
),
fives AS (SELECT doc_id, i, w[i + 1:i + 5] AS f FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM words)),
alike AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM fives x JOIN fives y ON x.doc_id = y.doc_id AND x.f = y.f AND x.i < y.i
),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS l FROM islands GROUP BY doc_id, q, island),
runs AS (
    SELECT doc_id, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l
),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
),
best AS (
    SELECT doc_id, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1
),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
left_over AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
    FROM (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM words) ANTI JOIN dropped USING (doc_id, i)
    GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM words LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
}
