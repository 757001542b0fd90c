"""The text operators as registered queries, and the SQL of those that SQL can express on whole tables.

Trained models (1, 3, 4, 5, 8, 9, 13), winnowing with its hashes (10) and windows of bytes (6: DuckDB cuts strings by
characters, in time that grows with the place) have none; they are compared with plain twins in the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, contamination, conversations, filter_audit, fingerprints, language, licenses, ngram_join, pii, quality, secrets, sentencepiece_codec, substring_dedup

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words and windows as lists; a window is looked up by its words, for each length that a window of the benchmark has.
OP2_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k + 1 : k + least(10, len(w))], ' ') AS win FROM (SELECT item, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT n FROM bw),
 dw AS (SELECT doc_id, k, n, array_to_string(w[k + 1 : k + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
 hit AS (SELECT doc_id, item, k, n FROM dw JOIN bw USING (n, win)),
 words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP7_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + least(4, len(w))], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS k FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.query,
        "op2_decontamination": contamination.query,
        "op3_quality": quality.query,
        "op4_sentencepiece": sentencepiece_codec.query,
        "op5_pii": pii.query,
        "op6_suffix_dedup": substring_dedup.query,
        "op7_ngram_join": ngram_join.query,
        "op8_language_id": language.query,
        "op9_license_scan": licenses.query,
        "op10_fingerprints": fingerprints.query,
        "op11_conversation_repair": conversations.query,
        "op12_filter_audit": filter_audit.query,
        "op13_brown_scores": brown.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op7_ngram_join": OP7_SQL, "op11_conversation_repair": conversations.SQL, "op12_filter_audit": filter_audit.SQL}
