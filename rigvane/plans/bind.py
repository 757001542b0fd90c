"""Test tables bound to the engine's canonical tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry

FX, FY, CX, CY = 615.3, 614.8, 319.5, 239.5
#: A total order of lineitem rows (its first two columns alone are not unique).
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

SAMPLES = """SELECT CAST(l_orderkey % 8 AS BIGINT) AS frame, CAST(l_suppkey % 2 AS BIGINT) AS view_id, l_returnflag AS label,
 (l_partkey * 7919) % 640 AS x, (l_orderkey * 104729 + l_linenumber * 31) % 480 AS y, l_extendedprice / 20000e0 AS z,
 l_discount - 0.05e0 AS logit, CAST(l_suppkey % 50 AS BIGINT) AS track_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem"""
POINTS = f"""SELECT *, (x - {CX}e0) * z / {FX}e0 + 0.15e0 * view_id AS wx, (y - {CY}e0) * z / {FY}e0 + (-0.03e0) * view_id AS wy, z + 0.2e0 AS wz
 FROM samples WHERE z BETWEEN 0.1e0 AND 6e0"""
VOXELS = """SELECT *, ((vx + 1048576) << 42) | ((vy + 1048576) << 21) | (vz + 1048576) AS key FROM (SELECT *, CAST(floor(wx * 4e0) AS BIGINT) AS vx,
 CAST(floor(wy * 4e0) AS BIGINT) AS vy, CAST(floor(wz * 4e0) AS BIGINT) AS vz FROM points)"""
#: DuckDB's side of the chain: WITH samples, points, vox, first (one row for each view, label, frame and voxel).
CHAIN = f"""WITH samples AS ({SAMPLES}), points AS ({POINTS}), vox AS ({VOXELS}),
 first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, view_id, label, key ORDER BY {', '.join(ORDER)}) AS rn FROM vox) WHERE rn = 1)"""
#: Small masks: instance = label, 64 x 48 pixels.
MASK = """SELECT CAST(l_orderkey % 4 AS BIGINT) AS frame, l_returnflag AS label, CAST(l_suppkey % 3 AS BIGINT) AS track_id, CAST((l_partkey * 7919) % 64 AS INT) AS x,
 CAST((l_orderkey * 104729 + l_linenumber * 31) % 48 AS INT) AS y, l_discount - 0.05e0 AS logit FROM lineitem"""
#: Event messages: arrival order differs from stamp order.
MESSAGES = """SELECT event_id, CAST(user_id AS BIGINT) AS user_id, event_type, value, CAST(epoch_us(ts) AS BIGINT) AS stamp_us, (event_id * 7919) % 10007 AS arrival FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(df: DataFrame, name: str, sql: str) -> DataFrame:
    return df.sparkSession.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: df})


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(table(spark, sf_dir, "lineitem"), "lineitem", SAMPLES)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, back-projected and moved to the world by each view's pose."""
    rows = samples(spark, sf_dir).where(geometry.valid_depth(F.col("z")))
    c = F.col
    p = geometry.back_project(c("x"), c("y"), c("z"), F.lit(FX), F.lit(FY), F.lit(CX), F.lit(CY))
    one, zero = F.lit(1.0), F.lit(0.0)
    pose = [[one, zero, zero], [zero, one, zero], [zero, zero, one]]
    return rows.select("*", *geometry.rigid(p, pose, [c("view_id") * 0.15, c("view_id") * -0.03, F.lit(0.2)]))


def voxels(spark: SparkSession, sf_dir: str, size: float = 0.25) -> DataFrame:
    rows = points(spark, sf_dir)
    rows = rows.select("*", *[geometry.quantize(F.col(f"w{a}"), 0.0, size).alias(f"v{a}") for a in "xyz"])
    return rows.withColumn("key", geometry.pack_key(F.col("vx"), F.col("vy"), F.col("vz")))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(table(spark, sf_dir, "lineitem"), "lineitem", MASK)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").cast("bigint").alias("user_id"), "event_type", "value", F.unix_micros("ts").alias("stamp_us"), ((F.col("event_id") * 7919) % 10007).alias("arrival"))
