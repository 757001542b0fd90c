"""Streaming twins give the rows of their batch twins on replayed files."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from rigvane.operators import crossframe, streams
from rigvane.streaming import stateful


def replay(spark, tmp_path, rows, schema, f, parts=2):
    """Runs f on a stream of `parts` micro-batches of rows, in order."""
    src = str(tmp_path / "src")
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    q = f(stream).writeStream.format("memory").queryName("twin").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return [tuple(r) for r in spark.table("twin").collect()]


def test_bundles(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{rng.randint(0, 1)}", rng.choice("ab"), 10 * i + rng.randint(0, 8), i) for i in range(60)]
    schema = "rig string, view string, stamp_ns long, arrival long"
    got = replay(spark, tmp_path, rows, schema, lambda s: stateful.bundles(s, ["a", "b"], 12))
    want = [tuple(r) for r in streams.bundles(spark.createDataFrame(rows, schema), "rig", ["a", "b"], 12).collect()]
    assert sorted(got) == sorted(want) and want


def test_global_ids(spark, tmp_path):
    rng = random.Random(2)
    rows, groups, costs = [], [], []
    for f in range(12):
        g = [(i, rng.choice("xy")) for i in range(1, rng.randint(0, 3) + 1)]
        c = [(a, b, rng.random()) for a in range(1, 4) for b, _ in g if rng.random() < 0.7]
        prev = groups[-1] if groups else []
        c = [x for x in c if any(a == x[0] and any(b == x[1] and lb == la for b, lb in g) for a, la in prev)]
        groups.append(g)
        costs.append(c)
        rows.append(("r", f, json.dumps(g), json.dumps(c)))
    got = replay(spark, tmp_path, rows, "rig string, frame long, groups string, costs string", stateful.global_ids)
    want = crossframe.inherit_ids(list(range(12)), dict(enumerate(groups)), {f: {(a, b): x for a, b, x in c} for f, c in enumerate(costs)})
    assert sorted((f, g, i) for _, f, g, i in got) == sorted(want)


def test_slot_lives(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, f, rng.random() < 0.5, rng.random() < 0.2) for f in range(20) for s in ("s0", "s1")]
    schema = "slot string, frame long, visible boolean, corrected boolean"
    got = replay(spark, tmp_path, rows, schema, lambda s: stateful.slot_lives(s, 3))
    want = [tuple(r) for r in streams.slot_lives(spark.createDataFrame(rows, schema), "slot", 3).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_refreshes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(r, f, rng.choice([None, rng.random()]) if rng.random() < 0.2 else 0.9, rng.randint(1, 6)) for f in range(40) for r in ("r0", "r1")]
    schema = "rig string, frame long, presence double, service int"
    got = replay(spark, tmp_path, rows, schema, lambda s: stateful.refreshes(s, 8, 2, 0.1), parts=3)
    want = [tuple(r) for r in streams.refreshes(spark.createDataFrame(rows, schema), "rig", 8, 2, 0.1).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[3] for r in want} == {None, "periodic", "tracking_anomaly"}


def test_history_ring(spark, tmp_path):
    rng = random.Random(6)
    processed = sorted(rng.sample(range(100), 50))
    asked = [(a, max(0, a - rng.randint(0, 9))) for a in processed for _ in range(2)]
    rows = sorted([("r", f, None) for f in processed] + [("r", a, ref) for a, ref in asked], key=lambda x: x[1])
    got = replay(spark, tmp_path, rows, "rig string, frame long, ref_frame long", lambda s: stateful.history_ring(s, 4), parts=1)
    frames = spark.createDataFrame([("r", f) for f in processed], "rig string, frame long")
    requests = spark.createDataFrame([("r", ref, a) for a, ref in asked], "rig string, ref_frame long, arrival_frame long")
    want = [("r", r["arrival_frame"], r["ref_frame"], r["available"]) for r in streams.history_ring(frames, requests, "rig", 4, 13).collect()]
    assert sorted(got) == sorted(want) and {x[3] for x in want} == {True, False}


def test_report_is_streaming(spark, tmp_path):
    rows = [("c", i * 10) for i in range(30)]
    got = replay(spark, tmp_path, rows, "stream string, s long", lambda s: stateful.report(s.withColumn("ts", F.timestamp_seconds("s")), "ts", "60 seconds", "0 seconds"))
    assert {r[2] for r in got} == {6}
