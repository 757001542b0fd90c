"""The pipeline's rows against brute-force twins of its stages, and the registered queries' contract columns."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from test_text_operators import brute_classes, brute_windows  # noqa: E402

import corpus_pipeline  # noqa: E402
from rigvane.llm import pii, quality, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CONTRACT = {
    "op1_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op13_brown_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


def test_contract_columns(spark):
    known = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in known) == list(range(1, 14))
    for name, cols in CONTRACT.items():
        df = known[name](spark, SF)
        assert df.columns[: len(cols)] == cols, name


def test_pipeline_equals_brute_force(spark):
    docs = corpus_pipeline.read(spark, SF, "documents")
    kept = quality.resample(docs, corpus_pipeline.read(spark, SF, "labels")).select("doc_id", "text").collect()
    least = {d: c for d, _, c in brute_classes([tuple(r) for r in kept], 5, 80)}
    rows = [tuple(r) for r in kept if least[r["doc_id"]] == r["doc_id"]]
    items = [tuple(r) for r in corpus_pipeline.read(spark, SF, "benchmark").select("item_id", "text").collect()]
    clean = {d for d, _, hit, *_ in brute_windows(rows, items, 10) if not hit}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == clean and len(out) == len(clean)
    texts = dict(rows)
    for r in out:
        assert r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) and r["n_chars"] == len(r["text"])
        spans = pii.base_spans(texts[r["doc_id"]])
        assert bool(spans) <= (r["text"] != texts[r["doc_id"]])
        assert all(texts[r["doc_id"]][s:e] not in r["text"] for k, s, e in spans if k == "email")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    """On whole tables, as the driver compares them."""
    import duckdb

    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
