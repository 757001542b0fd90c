"""Stream twins with timers give the rows of their batch twins, whatever the order inside the watermark, and after a restart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rigvane.operators import streams
from rigvane.streaming import timed


@pytest.fixture()
def rocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    timed.needs_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def replay(spark, tmp_path, batches, schema, f):
    """Runs f on the batches one after another, in two runs with one checkpoint: the second goes on where the first ended."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part in (batches[: len(batches) // 2], batches[len(batches) // 2 :]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = f(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert not q.isActive and q.exception() is None
    return spark.read.parquet(out)


def shuffled(rows, at, reach, size, rng):
    """Batches of rows whose order differs from that of their times by less than `reach`."""
    order = sorted(rows, key=lambda r: r[at] + rng.random() * reach)
    return [order[i : i + size] for i in range(0, len(order), size)]


SCHEMA = "k string, side int, s long, v long"


def test_as_of(rocks, tmp_path):
    rng = random.Random(3)
    rows = [(k, int(rng.random() < 0.6), s, i) for i, (k, s) in enumerate((rng.choice("ab"), rng.randrange(1, 600)) for _ in range(120))]
    rows = [r for i, r in enumerate(rows) if r[1] or all((q[0], q[2]) != (r[0], r[2]) or q[1] for q in rows[:i])]  # one information for each time
    batches = [*shuffled(rows, 2, 20, 60, rng), [("z", 1, 10_000, 0)]]
    ts = lambda s: s.withColumn("ts", F.timestamp_seconds("s"))
    got = replay(rocks, tmp_path, batches, SCHEMA, lambda s: timed.as_of(ts(s).where("side = 1").select("k", "ts", "v"), ts(s).where("side = 0").select("k", "ts", "v"), "k", "ts", "ts", "60 seconds"))
    df = rocks.createDataFrame(rows, SCHEMA)
    want = streams.as_of(df.where("side = 1").select("k", "s", "v"), df.where("side = 0").select("k", F.col("s").alias("t"), F.col("v").alias("info")), ["k"], "s", "t", ["info"], width=50)
    read = got.select("k", (F.col("us") / 1_000_000).cast("long").alias("s"), F.get_json_object("row", "$.v").cast("long").alias("v"), F.get_json_object("info", "$.v").cast("long").alias("info"))
    assert sorted(map(tuple, read.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_pair_nearest(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(k, side, s, 0) for k in "ab" for side in (0, 1) for s in rng.sample(range(1, 501), 60)]
    batches = [*shuffled(rows, 2, 20, 120, rng), [("z", 1, 10_000, 0)]]
    ts = lambda s: s.withColumn("ts", F.timestamp_seconds("s"))
    got = replay(rocks, tmp_path, batches, SCHEMA, lambda s: timed.pair_nearest(ts(s).where("side = 0"), ts(s).where("side = 1"), "k", "ts", 3_000_000, "60 seconds"))
    df = rocks.createDataFrame(rows, SCHEMA)
    want = streams.pair_nearest(df.where("side = 0"), df.where("side = 1"), ["k"], 3, "s")
    have = [(r["k"], r["us_a"] // 10**6, r["us_b"] // 10**6, r["skew"] // 10**6) for r in got.collect()]
    assert sorted(have) == sorted((r["k"], r["stamp_a"], r["stamp_b"], r["skew"]) for r in want.collect()) and len(have) > 40
    assert len({x[:2] for x in have}) == len({(x[0], x[2]) for x in have}) == len(have)


RING = "rig string, frame long, ref_frame long"


def test_history_ring_goes_on_after_a_restart(rocks, tmp_path):
    rng = random.Random(6)
    processed = sorted(rng.sample(range(100), 50))
    asked = [(a, max(0, a - rng.randint(0, 9))) for a in processed for _ in range(2)]
    rows = sorted([("r", f, None) for f in processed] + [("r", a, ref) for a, ref in asked], key=lambda x: x[1])
    cut = next(i for i in range(70, len(rows)) if rows[i][1] != rows[i - 1][1])
    got = replay(rocks, tmp_path, [rows[:cut], rows[cut:]], RING, lambda s: timed.history_ring(s, "rig", 4))
    frames = rocks.createDataFrame([("r", f) for f in processed], "rig string, frame long")
    requests = rocks.createDataFrame([("r", ref, a) for a, ref in asked], "rig string, ref_frame long, arrival_frame long")
    want = [("r", r["arrival_frame"], r["ref_frame"], r["available"]) for r in streams.history_ring(frames, requests, "rig", 4, 13).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and {x[3] for x in want} == {True, False}

