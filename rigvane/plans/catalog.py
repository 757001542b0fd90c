"""Registered queries: each operator on the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import crossframe, crossview, detect, geometry, masks, profile, streams, voxel
from ..sources import frames as sources
from . import bind
from .bind import CHAIN, MASK, MESSAGES, ORDER, table
from .store import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(x) -> F.Column:
    return F.round(x, 6)


# --- projections and scalar functions --------------------------------------------------------

PIX = "SELECT p_partkey, p_size, p_retailprice, (p_partkey * 7919) % 640 AS x, (p_partkey * 104729) % 480 AS y, p_retailprice / 1000e0 AS z FROM part"


@query("a02_depth_decode", "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN p_size * 0.001e0 ELSE CAST(p_size AS DOUBLE) END, 6) AS depth_m FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("encoding", F.when(c("p_partkey") % 2 == 0, "16UC1").otherwise("32FC1"))
    return sources.depth_metres(p, raw="p_size").select("p_partkey", r6(c("depth_m")).alias("depth_m"))


@query("b01_back_project", f"WITH p AS ({PIX}) SELECT p_partkey, round((x - 319.5e0) * z / 615.3e0, 6) AS px, round((y - 239.5e0) * z / 614.8e0, 6) AS py, round(z, 6) AS pz FROM p")
def _(spark, sf):
    p = bind._sql(table(spark, sf, "part"), "part", PIX)
    got = geometry.back_project(c("x"), c("y"), c("z"), F.lit(bind.FX), F.lit(bind.FY), F.lit(bind.CX), F.lit(bind.CY))
    return p.select("p_partkey", *got).select("p_partkey", *[r6(c(a)).alias(a) for a in ("px", "py", "pz")])


QUAT = "SELECT *, (p_size % 7) / 9.7e0 AS qx, (p_size % 5) / 9.7e0 AS qy, (p_size % 3) / 9.7e0 AS qz, (p_size % 11) / 9.7e0 AS qw FROM p"


@query(
    "b03_rigid_quaternion",
    f"""WITH p AS ({PIX}), q AS ({QUAT}) SELECT p_partkey,
 round((1 - 2 * (qy * qy + qz * qz)) * x + 2 * (qx * qy - qz * qw) * y + 2 * (qx * qz + qy * qw) * z + 0.15e0, 4) AS wx,
 round(2 * (qx * qy + qz * qw) * x + (1 - 2 * (qx * qx + qz * qz)) * y + 2 * (qy * qz - qx * qw) * z - 0.03e0, 4) AS wy,
 round(2 * (qx * qz - qy * qw) * x + 2 * (qy * qz + qx * qw) * y + (1 - 2 * (qx * qx + qy * qy)) * z + 0.2e0, 4) AS wz FROM q""",
)
def _(spark, sf):
    p = bind._sql(table(spark, sf, "part"), "part", PIX)
    q = [(c("p_size") % m) / F.lit(9.7) for m in (7, 5, 3, 11)]
    w = geometry.rigid([c("x"), c("y"), c("z")], geometry.quaternion_rotation(*q), [F.lit(0.15), F.lit(-0.03), F.lit(0.2)])
    return p.select("p_partkey", *w).select("p_partkey", *[F.round(c(a), 4).alias(a) for a in ("wx", "wy", "wz")])


@query("b05_voxel_keys", f"{CHAIN} SELECT view_id, label, count(*) AS n, count(DISTINCT key) AS n_keys, min(key) AS least, max(key) AS most, CAST(sum(key % 1000003) AS BIGINT) AS checksum FROM vox GROUP BY view_id, label")
def _(spark, sf):
    return bind.voxels(spark, sf).groupBy("view_id", "label").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"), F.min("key").alias("least"), F.max("key").alias("most"), F.sum(c("key") % 1000003).alias("checksum"))


@query(
    "b08_presence",
    f"""WITH s AS ({bind.SAMPLES}), a AS (SELECT frame, track_id, max(logit) AS m, sum(CASE WHEN logit > 0 THEN 1 ELSE 0 END) AS n FROM s GROUP BY frame, track_id)
 SELECT frame, track_id, round(1 / (1 + exp(-least(greatest(m, -20e0), 20e0))) * least(greatest(20e0 * n / 10000e0, 0e0), 1e0), 6) AS presence FROM a""",
)
def _(spark, sf):
    return masks.presence(bind.samples(spark, sf), ["frame", "track_id"], 10_000)


PAIRS = "SELECT a.vec_id AS vec_id, a.embedding AS u, b.embedding AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _vec_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", c("embedding").alias("u")).join(e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("v")), "vec_id")


@query("b09_cosine_distance", f"WITH p AS ({PAIRS}) SELECT vec_id, round(1 - list_dot_product(CAST(u AS DOUBLE[]), CAST(v AS DOUBLE[])) / sqrt(list_dot_product(CAST(u AS DOUBLE[]), CAST(u AS DOUBLE[])) * list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 5) AS distance FROM p")
def _(spark, sf):
    return _vec_pairs(spark, sf).select("vec_id", F.round(S.cosine_distance(c("u"), c("v")), 5).alias("distance"))


@query(
    "b10_blend_embedding",
    f"""WITH p AS ({PAIRS}), m AS (SELECT vec_id, list_transform(list_zip(CAST(u AS DOUBLE[]), CAST(v AS DOUBLE[])), lambda z: z[1] * 0.75e0 + z[2] * 0.25e0) AS m FROM p)
 SELECT vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 5) AS first, round(m[64] / sqrt(list_dot_product(m, m)), 5) AS last FROM m""",
)
def _(spark, sf):
    b = _vec_pairs(spark, sf).select("vec_id", S.blend_embedding(c("u"), c("v")).alias("b"))
    return b.select("vec_id", F.round(c("b")[0], 5).alias("first"), F.round(c("b")[63], 5).alias("last"))


@query(
    "b11_colour_histogram",
    """WITH h AS (SELECT p_brand, (least((p_partkey % 256) * 4 // 256, 3) * 4 + least((p_size * 5) % 256 * 4 // 256, 3)) * 4 + least((p_partkey * 7) % 256 * 4 // 256, 3) AS bin, count(*) AS n FROM part GROUP BY ALL),
 t AS (SELECT p_brand, sum(n) AS total, sqrt(sum(n * n)) AS len FROM h GROUP BY p_brand) SELECT p_brand, CAST(bin AS BIGINT) AS bin, round(n / len, 6) AS weight FROM h JOIN t USING (p_brand) WHERE total >= 8""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    h = p.groupBy("p_brand", S.colour_bin(c("p_partkey") % 256, (c("p_size") * 5) % 256, (c("p_partkey") * 7) % 256, 4).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand")
    h = h.withColumn("total", F.sum("n").over(w)).withColumn("len", F.sqrt(F.sum(c("n") * c("n")).over(w)))
    return h.where("total >= 8").select("p_brand", "bin", r6(c("n") / c("len")).alias("weight"))


@query("b12_b13_colours", "SELECT s_suppkey, CAST((((s_suppkey * 3) % 256) << 16) | (((s_suppkey * 5) % 256) << 8) | ((s_suppkey * 7) % 256) AS INT) AS rgb, CAST((coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END, s_suppkey) - 1 + 6) % 6 AS BIGINT) AS slot, CAST(CASE CAST((coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END, s_suppkey) - 1 + 6) % 6 AS INT) WHEN 0 THEN 15093840 WHEN 1 THEN 5296760 WHEN 2 THEN 5281520 WHEN 3 THEN 15449670 WHEN 4 THEN 11819745 ELSE 4641495 END AS INT) AS palette_rgb FROM supplier")
def _(spark, sf):
    k = c("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", S.pack_rgb(k * 3 % 256, k * 5 % 256, k * 7 % 256).alias("rgb"), S.palette_index(F.when(k % 3 == 0, c("s_nationkey")), k).cast("bigint").alias("slot"), S.palette_rgb(S.palette_index(F.when(k % 3 == 0, c("s_nationkey")), k)).alias("palette_rgb"))


@query("b14_label_text", "SELECT n_nationkey, concat_ws(' ', n_name, '[slot ' || n_regionkey || ']', 'G' || CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, 'M' || CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END) AS text FROM nation")
def _(spark, sf):
    k = c("n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", S.label_text(c("n_name"), c("n_regionkey"), F.when(k % 2 == 0, k), F.when(k % 3 == 0, k)).alias("text"))


@query("b15_b29_confidence_status", "SELECT s_suppkey, round(least(greatest(s_acctbal / 5000e0, 0e0), 1e0), 6) AS confidence, CASE WHEN s_suppkey % 4 <> 0 THEN 'visible' ELSE 'lost' END AS status FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", r6(S.clamp01(c("s_acctbal") / 5000.0)).alias("confidence"), S.status(F.when(c("s_suppkey") % 4 != 0, c("s_suppkey"))).alias("status"))


@query("b16_adaptive_stride", "SELECT p_partkey, CAST(CASE WHEN p_partkey * 37 / 4e0 > 2000 THEN 2 * ceil(sqrt(p_partkey * 37 / 4e0 / 2000)) ELSE 2 END AS BIGINT) AS stride FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", geometry.adaptive_stride(2, c("p_partkey") * 37, 2000).alias("stride"))


@query("b17_b18_stamps_rates", f"WITH m AS ({MESSAGES}) SELECT user_id, CAST((min(stamp_us) // 1000000) * 1000000000 + (min(stamp_us) % 1000000) * 1000 AS BIGINT) AS first_ns, CASE WHEN count(*) >= 2 AND max(stamp_us) > min(stamp_us) THEN round((count(*) - 1) * 1e6 * 3600 / (max(stamp_us) - min(stamp_us)), 6) END AS per_hour FROM m GROUP BY user_id")
def _(spark, sf):
    m = bind.messages(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.min("stamp_us").alias("a"), F.max("stamp_us").alias("b"))
    return m.select("user_id", S.stamp_ns(F.expr("a div 1000000"), (c("a") % 1_000_000) * 1000).alias("first_ns"), r6(S.rate(c("n"), c("a"), c("b"), 3.6e9)).alias("per_hour"))


IMAGES = "SELECT CAST(p_partkey // 192 AS BIGINT) AS image, CAST(p_partkey % 16 AS INT) AS x, CAST((p_partkey // 16) % 12 AS INT) AS y, p_retailprice / 1000e0 AS logit FROM part"


@query(
    "b20_resize_bilinear",
    f"""WITH g AS ({IMAGES}), xs AS (SELECT d, greatest((d + 0.5e0) * (16e0 / 24e0) - 0.5e0, 0e0) AS a FROM range(24) t(d)), ys AS (SELECT d, greatest((d + 0.5e0) * (12e0 / 18e0) - 0.5e0, 0e0) AS a FROM range(18) t(d)),
 xx AS (SELECT d, least(floor(a), 15) AS i, 1 - (a - least(floor(a), 15)) AS w FROM xs UNION ALL SELECT d, least(floor(a) + 1, 15), a - least(floor(a), 15) FROM xs), yy AS (SELECT d, least(floor(a), 11) AS i, 1 - (a - least(floor(a), 11)) AS w FROM ys UNION ALL SELECT d, least(floor(a) + 1, 11), a - least(floor(a), 11) FROM ys)
 SELECT image, CAST(yy.d AS INT) AS y, CAST(xx.d AS INT) AS x, round(sum(logit * xx.w * yy.w), 8) AS logit FROM g JOIN xx ON xx.i = g.x AND xx.w > 0 JOIN yy ON yy.i = g.y AND yy.w > 0 GROUP BY image, yy.d, xx.d""",
)
def _(spark, sf):
    """All rows of part, 192 to an image; the pixels that the last image lacks count as 0."""
    g = table(spark, sf, "part").selectExpr("p_partkey div 192 image", "cast(p_partkey % 16 as int) x", "cast(p_partkey div 16 % 12 as int) y", "p_retailprice / 1000 logit")
    return masks.resize_bilinear(g, ["image"], (16, 12), (24, 18), 8)


@query("b21_b22_boxes", "SELECT c_custkey, round(((c_custkey % 100) / 100e0 - (c_custkey % 7) / 20e0) * 640, 4) AS x0, round(((c_custkey % 100) / 100e0 + (c_custkey % 7) / 20e0) * 640, 4) AS x1, round(1 / (1 + exp(-(c_acctbal / 5000e0))) * (1 / (1 + exp(-(c_nationkey / 10e0)))), 6) AS score FROM customer")
def _(spark, sf):
    k = c("c_custkey")
    x0, _, x1, _ = S.box_corners(k % 100 / 100.0, F.lit(0.5), (k % 7) / 10.0, F.lit(0.1), 640.0, 480.0)
    return table(spark, sf, "customer").select("c_custkey", F.round(x0, 4).alias("x0"), F.round(x1, 4).alias("x1"), r6(S.detector_score(c("c_acctbal") / 5000.0, c("c_nationkey") / 10.0)).alias("score"))


PROMPTS = [("red", 3), ("green", 2), ("blue", 1)]
SLOTS = "SELECT CAST(row_number() OVER (ORDER BY pos, k) - 1 AS INT) AS slot_index, CAST(row_number() OVER (ORDER BY pos, k) AS INT) AS track_id, label, CAST(k AS INT) AS class_slot FROM (VALUES (0, 'red', 3), (1, 'green', 2), (2, 'blue', 1)) p(pos, label, cap), range(3) t(k) WHERE k < cap"


@query("b26_slot_layout", SLOTS)
def _(spark, sf):
    return detect.slot_layout(spark, detect.parse_prompts(PROMPTS))


@query("b27_capacity", "SELECT CAST(2 * sum(r_regionkey + 1) AS BIGINT) AS max_instances, CAST(sum((r_regionkey + 1) * 2 * (r_regionkey + 1) * 2) AS BIGINT) AS max_pairs FROM region")
def _(spark, sf):
    return detect.capacity_bounds(table(spark, sf, "region").select((c("r_regionkey") + 1).alias("capacity")), 2)


@query("b28_refresh_cadence", "SELECT n_nationkey, CAST(greatest(1, round_even(n_nationkey * 0.25e0 * (n_regionkey + 1), 0)) AS BIGINT) AS frames FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", S.refresh_frames(c("n_nationkey") * F.lit(0.25), c("n_regionkey") + 1).alias("frames"))


# --- filters and sampling --------------------------------------------------------------------


@query("c01_mask_threshold", f"WITH s AS ({bind.SAMPLES}) SELECT frame, track_id, count(*) AS n FROM s WHERE logit > 0 GROUP BY ALL")
def _(spark, sf):
    return masks.threshold(bind.samples(spark, sf)).groupBy("frame", "track_id").agg(F.count("*").alias("n"))


@query("c02_c03_valid_lattice", f"WITH s AS ({bind.SAMPLES}) SELECT frame, view_id, count(*) AS n, min(x) AS least_x, max(y) AS most_y FROM s WHERE z BETWEEN 0.1e0 AND 6e0 AND x % 4 = 0 AND y % 4 = 0 GROUP BY ALL")
def _(spark, sf):
    s = bind.samples(spark, sf).where(geometry.valid_depth(c("z")) & geometry.on_lattice(c("x"), c("y"), F.lit(4)))
    return s.groupBy("frame", "view_id").agg(F.count("*").alias("n"), F.min("x").alias("least_x"), F.max("y").alias("most_y"))


@query("f06_even_cap", f"WITH s AS ({bind.SAMPLES}), n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY frame, label) AS n FROM s WINDOW w AS (PARTITION BY frame, label ORDER BY {', '.join(ORDER)})), k AS (SELECT frame, label, n, CAST(CASE WHEN k = 99 THEN n - 1 ELSE floor(k * ((n - 1) / 99e0)) END AS BIGINT) AS i FROM (SELECT DISTINCT frame, label, n FROM n), range(100) t(k)) SELECT frame, label, l_orderkey, l_partkey FROM n WHERE n <= 100 UNION ALL SELECT n.frame, n.label, l_orderkey, l_partkey FROM n JOIN (SELECT DISTINCT * FROM k) k ON n.frame = k.frame AND n.label = k.label AND n.i = k.i WHERE n.n > 100")
def _(spark, sf):
    return geometry.even_cap(bind.samples(spark, sf), ["frame", "label"], ORDER, 100).select("frame", "label", "l_orderkey", "l_partkey")


DET = "SELECT CAST(o_orderkey % 40 AS BIGINT) AS frame, CASE WHEN o_orderstatus = 'F' THEN 'red' WHEN o_orderstatus = 'O' THEN 'green' ELSE 'blue' END AS label, o_orderkey AS ord, floor(o_totalprice / 1000e0) / 500e0 AS score, o_custkey % 50 AS pixels FROM orders"
RANK = f"WITH d AS ({DET}), k AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, ord) - 1 AS rank FROM d WHERE score > 0.2e0 AND score >= 0.3e0 AND pixels >= 10)"


def _ranked(spark, sf):
    d = bind._sql(table(spark, sf, "orders"), "orders", DET)
    return detect.rank_in_class(detect.filter_detections(d, 0.3, 0.2, 10), ["frame"], ["ord"])


@query("c04_f01_rank_in_class", f"{RANK} SELECT frame, label, ord, rank FROM k")
def _(spark, sf):
    return _ranked(spark, sf).select("frame", "label", "ord", "rank")


@query("g06_top_k", f"{RANK} SELECT frame, label, ord FROM k WHERE rank < 3")
def _(spark, sf):
    return detect.top_k(_ranked(spark, sf), 3).select("frame", "label", "ord")


@query("e12_class_counts", f"{RANK}, s AS ({SLOTS}), f AS (SELECT DISTINCT CAST(o_orderkey % 40 AS BIGINT) AS frame FROM orders) SELECT f.frame, l.label, count(k.ord) AS n FROM f CROSS JOIN (SELECT DISTINCT label FROM s) l LEFT JOIN k ON k.frame = f.frame AND k.label = l.label AND k.rank < 3 GROUP BY ALL")
def _(spark, sf):
    frames = table(spark, sf, "orders").select((c("o_orderkey") % 40).alias("frame")).distinct()
    return detect.class_counts(detect.top_k(_ranked(spark, sf), 3), spark.createDataFrame(PROMPTS, "label string, capacity int"), frames, ["frame"])


@query("d20_seed_slots", f"{RANK}, s AS ({SLOTS}), f AS (SELECT DISTINCT CAST(o_orderkey % 40 AS BIGINT) AS frame FROM orders) SELECT f.frame, s.track_id, s.label, k.ord FROM f CROSS JOIN s LEFT JOIN k ON k.frame = f.frame AND k.label = s.label AND k.rank = s.class_slot")
def _(spark, sf):
    frames = table(spark, sf, "orders").select((c("o_orderkey") % 40).alias("frame")).distinct()
    return detect.seed(_ranked(spark, sf), detect.slot_layout(spark, PROMPTS), frames, ["frame"]).select("frame", "track_id", "label", "ord")



#: Detections with masks: a window of 12 x 10 pixels for each, of which rows set pixels; the windows of a class overlap.
OBJECTS = """SELECT CAST(l_orderkey % 2 AS BIGINT) AS frame, l_returnflag AS label, CAST(l_suppkey % 15 AS BIGINT) AS det, CAST(2 * (l_suppkey % 5) + (l_partkey * 7919) % 12 AS INT) AS x,
 CAST(4 * (l_suppkey % 3) + (l_orderkey * 104729 + l_linenumber * 31) % 10 AS INT) AS y, l_quantity FROM lineitem"""


@query(
    "f02_nms",
    f"""WITH RECURSIVE o AS ({OBJECTS}), m AS (SELECT DISTINCT frame, label, det, x, y FROM o),
 d AS (SELECT frame, label, det, max(l_quantity) + sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS score, count(DISTINCT 64 * y + x) AS n FROM o GROUP BY ALL),
 k AS (SELECT frame, label, det, n, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, det) - 1 AS rank FROM d WHERE n >= 10),
 i AS (SELECT p.frame, p.label, p.det AS a, q.det AS b, count(*) AS i FROM m p JOIN m q USING (frame, label, x, y) WHERE p.det <> q.det GROUP BY ALL),
 bad AS (SELECT v.frame, v.label, v.rank, list(u.rank) AS bad FROM i JOIN k u ON u.frame = i.frame AND u.label = i.label AND u.det = i.a JOIN k v ON v.frame = i.frame AND v.label = i.label AND v.det = i.b AND u.rank < v.rank WHERE i.i / CAST(u.n + v.n - i.i AS DOUBLE) >= 0.2e0 GROUP BY ALL),
 w AS (SELECT frame, label, 0::BIGINT AS rank, [0::BIGINT] AS kept, true AS keep FROM k WHERE rank = 0
  UNION ALL SELECT frame, label, rank, CASE WHEN ok THEN list_append(kept, rank) ELSE kept END, ok FROM (SELECT k.frame, k.label, k.rank, w.kept, len(w.kept) < 5 AND NOT list_has_any(w.kept, coalesce(bad.bad, [])) AS ok FROM w JOIN k ON k.frame = w.frame AND k.label = w.label AND k.rank = w.rank + 1 LEFT JOIN bad ON bad.frame = k.frame AND bad.label = k.label AND bad.rank = k.rank))
 SELECT w.frame, w.label, w.rank, k.det FROM w JOIN k USING (frame, label, rank) WHERE keep""",
)
def _(spark, sf):
    o = bind._sql(table(spark, sf, "lineitem"), "lineitem", OBJECTS)
    keys = ["frame", "label", "det"]
    score = o.groupBy(*keys).agg((F.max("l_quantity") + F.count_if(c("l_quantity") > 25)).alias("score"))
    d = masks.packed(o, keys).where("area >= 10").join(score, keys)
    ranked = cut(detect.rank_in_class(d, ["frame"], ["det"]))
    return detect.nms(ranked, ["frame"], ["tiles", "words"], masks.packed_iou, 0.2, 5).join(ranked.select(*keys, "rank"), ["frame", "label", "rank"])


# --- masks -----------------------------------------------------------------------------------

M = f"WITH m AS (SELECT DISTINCT frame, label, x, y FROM ({MASK}) WHERE logit > 0)"
ERODE = """, h AS (SELECT *, count(*) OVER (PARTITION BY frame, label, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM m), f AS (SELECT * FROM h WHERE n = least(x + 1, 63) - greatest(x - 1, 0) + 1),
 v AS (SELECT *, count(*) OVER (PARTITION BY frame, label, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS k FROM f), e AS (SELECT frame, label, y, x FROM v WHERE k = least(y + 1, 47) - greatest(y - 1, 0) + 1)"""


def _mask(spark, sf):
    return masks.threshold(bind.mask(spark, sf))


@query("f03_erode", f"{M}{ERODE} SELECT * FROM e")
def _(spark, sf):
    return masks.erode(_mask(spark, sf), ["frame", "label"], 1, 64, 48)


@query("f04_dilate", f"{M} SELECT DISTINCT frame, label, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM m, (SELECT unnest([-2, -1, 0, 1, 2]) AS dx), (SELECT unnest([-2, -1, 0, 1, 2]) AS dy) WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 47")
def _(spark, sf):
    return masks.dilate(_mask(spark, sf), ["frame", "label"], 2, 64, 48)


@query("e07_bbox", f"{M}{ERODE} SELECT frame, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS foreground FROM e GROUP BY ALL")
def _(spark, sf):
    return masks.bbox(masks.erode(_mask(spark, sf), ["frame", "label"], 1, 64, 48), ["frame", "label"])


@query("e10_owner_map", f"WITH m AS (SELECT DISTINCT frame, track_id, x, y FROM ({MASK}) WHERE logit > 0) SELECT frame, y, x, CAST(CASE WHEN count(*) = 1 THEN min(track_id) ELSE 0 END AS BIGINT) AS owner FROM m GROUP BY frame, y, x")
def _(spark, sf):
    return masks.owner_map(_mask(spark, sf), ["frame"])


@query("e11_exclusion_union", f"{M} SELECT DISTINCT frame, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM m, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE label IN ('A', 'R') AND x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 47")
def _(spark, sf):
    return masks.exclusion_union(_mask(spark, sf), ["frame"], detect.excluded_labels([" A", "R ", " "]), 1, 64, 48)


@query("a15_instance_raster", f"SELECT frame, y, x, CAST(max(least(track_id + 254, 255)) AS BIGINT) AS code FROM ({MASK}) WHERE logit > 0 GROUP BY frame, y, x")
def _(spark, sf):
    return masks.instance_raster(_mask(spark, sf).withColumn("code", c("track_id") + 254), ["frame"])


@query("d07_mask_iou", f"{M}, n AS (SELECT frame, label, count(*) AS n FROM m GROUP BY ALL), i AS (SELECT p.frame, p.label AS a, q.label AS b, count(*) AS i FROM m p JOIN m q ON p.frame = q.frame AND p.x = q.x AND p.y = q.y AND p.label < q.label GROUP BY ALL) SELECT i.frame, a, b, round(i / CAST(u.n + v.n - i AS DOUBLE), 6) AS iou FROM i JOIN n u ON u.frame = i.frame AND u.label = a JOIN n v ON v.frame = i.frame AND v.label = b")
def _(spark, sf):
    return masks.mask_iou(_mask(spark, sf), ["frame"], "label")


@query("h04_mask_or_and", f"{M}, p AS (SELECT a.label AS a, b.label AS b FROM (SELECT DISTINCT label FROM m) a, (SELECT DISTINCT label FROM m) b WHERE a.label < b.label) SELECT 'or' AS op, frame, a, b, count(DISTINCT y * 64 + x) AS n FROM m JOIN p ON label IN (a, b) GROUP BY frame, a, b UNION ALL SELECT 'and', u.frame, u.label, v.label, count(*) FROM m u JOIN m v ON u.frame = v.frame AND u.x = v.x AND u.y = v.y AND u.label < v.label GROUP BY ALL")
def _(spark, sf):
    """Every two labels of a frame."""
    m = _mask(spark, sf)
    labels = m.select("label").distinct()
    pairs = labels.select(c("label").alias("a")).join(labels.select(c("label").alias("b")), c("a") < c("b"))
    side = lambda x: m.withColumnRenamed("label", x).join(F.broadcast(pairs), x)
    part = lambda how: masks.combine(side("a"), side("b"), ["frame", "a", "b"], how).groupBy(F.lit(how).alias("op"), "frame", "a", "b").agg(F.count("*").alias("n"))
    return part("or").unionByName(part("and"))


@query("e08_components")
def _(spark, sf):
    return masks.components(_mask(spark, sf), ["frame", "label"]).groupBy("frame", "label", "component").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("c12_small_components")
def _(spark, sf):
    return masks.drop_small(_mask(spark, sf), ["frame", "label"], 4).groupBy("frame", "label").agg(F.count("*").alias("n"))


# --- voxels and fusion -----------------------------------------------------------------------

KEYS = ["frame", "view_id", "label", "key"]
WORLD = ["wx", "wy", "wz", "vx", "vy", "vz"]


def _first(spark, sf):
    return voxel.first_wins(bind.voxels(spark, sf), KEYS, ORDER, [*WORLD, *ORDER])


@query("e01_voxel_first_wins", f"{CHAIN} SELECT frame, view_id, label, key, l_orderkey, l_linenumber, l_partkey FROM first")
def _(spark, sf):
    return _first(spark, sf).select("frame", "view_id", "label", "key", "l_orderkey", "l_linenumber", "l_partkey")


@query("e02_fused_union", f"{CHAIN}, u AS (SELECT *, row_number() OVER (PARTITION BY frame, label, key ORDER BY view_id) AS r FROM first) SELECT frame, label, key, view_id FROM u WHERE r = 1")
def _(spark, sf):
    return voxel.union_first_wins(_first(spark, sf), ["frame", "label"], "view_id", "key", ["wx"]).select("frame", "label", "key", "view_id")


@query("e03_downsample", f"{CHAIN} SELECT frame, view_id, label, key, CAST(row_number() OVER (PARTITION BY frame, view_id, label ORDER BY {', '.join(ORDER)}) AS INT) AS ord FROM first")
def _(spark, sf):
    return voxel.downsample(bind.voxels(spark, sf), KEYS, ORDER, ["wx"]).select("frame", "view_id", "label", "key", "ord")


@query("e04_median_centroid", f"{CHAIN} SELECT view_id, label, round(median(wx), 5) AS cx, round(median(wy), 5) AS cy, round(median(wz), 5) AS cz, count(*) AS n FROM first GROUP BY ALL")
def _(spark, sf):
    f = _first(spark, sf)
    return geometry.median_centroid(f, ["view_id", "label"], digits=5, groups=f.groupBy("view_id", "label").agg(F.count("*").alias("n")))


@query("e05_robust_bbox", f"{CHAIN} SELECT frame, label, round(quantile_cont(wx, 0.01), 5) AS lox, round(quantile_cont(wx, 0.99), 5) AS hix, round(quantile_cont(wz, 0.01), 5) AS loz, round(quantile_cont(wz, 0.99), 5) AS hiz FROM points GROUP BY ALL")
def _(spark, sf):
    return geometry.robust_bbox(bind.points(spark, sf), ["frame", "label"], ("wx", "wz"), digits=5)


@query("e06_b19_voxel_bbox", f"{CHAIN} SELECT frame, view_id, label, min(vx) AS min_vx, max(vx) AS max_vx, count(*) AS n_voxels, round(min(vx) * 0.25e0, 6) AS lo, round((max(vx) + 1) * 0.25e0, 6) AS hi FROM first GROUP BY ALL")
def _(spark, sf):
    b = voxel.bbox(_first(spark, sf), ["frame", "view_id", "label"])
    lo, hi = geometry.voxel_bbox_metric(c("min_vx"), c("max_vx"), 0.0, 0.25)
    return b.select("frame", "view_id", "label", "min_vx", "max_vx", "n_voxels", r6(lo).alias("lo"), r6(hi).alias("hi"))


OBS = "(CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + view_id"
BOX = f"{CHAIN}, o AS (SELECT *, CAST({OBS} AS BIGINT) AS obs FROM first), b AS (SELECT frame, label, view_id, obs, min(vx) AS x0, max(vx) AS x1, min(vy) AS y0, max(vy) AS y1, min(vz) AS z0, max(vz) AS z1 FROM o GROUP BY ALL)"
PAIR = ", p AS (SELECT a.frame, a.label, a.obs AS a, b.obs AS b FROM b a JOIN b ON a.frame = b.frame AND a.label = b.label AND a.view_id < b.view_id AND a.x1 + 1 >= b.x0 AND b.x1 + 1 >= a.x0 AND a.y1 + 1 >= b.y0 AND b.y1 + 1 >= a.y0 AND a.z1 + 1 >= b.z0 AND b.z1 + 1 >= a.z0)"


def _observed(spark, sf):
    return _first(spark, sf).withColumn("obs", F.expr(f"cast({OBS} as bigint)"))


def _pairs(o):
    return crossview.candidates(voxel.bbox(o, ["frame", "label", "view_id", "obs"]), ["frame"], 1)


@query("d08_cross_view_candidates", f"{BOX}{PAIR} SELECT frame, label, a, b FROM p")
def _(spark, sf):
    return _pairs(_observed(spark, sf)).select("frame", "label", "a", "b")


COVER = """, s AS (SELECT frame, obs, count(*) AS n FROM o GROUP BY ALL), ab AS (SELECT p.frame, p.a, p.b, count(*) AS h FROM p JOIN o x ON x.frame = p.frame AND x.obs = p.a JOIN o y ON y.frame = p.frame AND y.obs = p.b AND y.key = x.key GROUP BY ALL),
 sc AS (SELECT p.frame, p.label, p.a, p.b, coalesce(h, 0) / CAST(u.n AS DOUBLE) AS a_to_b, coalesce(h, 0) / CAST(v.n AS DOUBLE) AS b_to_a FROM p LEFT JOIN ab ON ab.frame = p.frame AND ab.a = p.a AND ab.b = p.b JOIN s u ON u.frame = p.frame AND u.obs = p.a JOIN s v ON v.frame = p.frame AND v.obs = p.b)"""


def _scores(o, radius=0):
    """o: the observed voxels, a table that is read several times (written once by `cut`)."""
    p = _pairs(o)
    return voxel.coverage(o.select("frame", "obs", "key"), p.select("frame", "a", "b"), ["frame"], "a", "b", radius).join(p, ["frame", "a", "b"])


@query("d09_d11_coverage_exact", f"{BOX}{PAIR}{COVER} SELECT frame, label, a, b, round(a_to_b, 6) AS a_to_b, round(b_to_a, 6) AS b_to_a, round(0.5e0 * (a_to_b + b_to_a), 6) AS score FROM sc")
def _(spark, sf):
    return _scores(cut(_observed(spark, sf))).select("frame", "label", "a", "b", *[r6(c(x)).alias(x) for x in ("a_to_b", "b_to_a", "score")])


@query(
    "d10_coverage_neighbourhood",
    f"""{BOX}{PAIR}, n AS (SELECT frame, obs, count(*) AS n FROM o GROUP BY ALL), g AS (SELECT unnest([-1, 0, 1]) AS d), near AS (SELECT DISTINCT frame, obs, ((vx + i.d + 1048576) << 42) | ((vy + j.d + 1048576) << 21) | (vz + k.d + 1048576) AS key FROM o, g i, g j, g k),
 h AS (SELECT p.frame, p.a, p.b, count(*) AS h FROM p JOIN o x ON x.frame = p.frame AND x.obs = p.a JOIN near y ON y.frame = p.frame AND y.obs = p.b AND y.key = x.key GROUP BY ALL) SELECT p.frame, p.a, p.b, round(coalesce(h, 0) / CAST(n.n AS DOUBLE), 6) AS a_to_b FROM p LEFT JOIN h USING (frame, a, b) JOIN n ON n.frame = p.frame AND n.obs = p.a""",
)
def _(spark, sf):
    return _scores(cut(_observed(spark, sf)), 1).select("frame", "a", "b", r6(c("a_to_b")).alias("a_to_b"))


@query("c08_accepted_pairs", f"{BOX}{PAIR}{COVER} SELECT frame, label, a, b FROM sc WHERE 0.5e0 * (a_to_b + b_to_a) >= 0.15e0 AND least(a_to_b, b_to_a) >= 0.2e0")
def _(spark, sf):
    return crossview.accepted(_scores(cut(_observed(spark, sf)))).select("frame", "label", "a", "b")


FUSED = f"{BOX}{PAIR}{COVER}, ok AS (SELECT * FROM sc WHERE 0.5e0 * (a_to_b + b_to_a) >= 0.15e0 AND least(a_to_b, b_to_a) >= 0.2e0), r AS (SELECT o.frame, o.obs, coalesce(min(ok.a), min(o.obs)) AS root FROM (SELECT DISTINCT frame, obs FROM o) o LEFT JOIN ok ON ok.frame = o.frame AND ok.b = o.obs GROUP BY o.frame, o.obs), gr AS (SELECT frame, obs, CAST(dense_rank() OVER (PARTITION BY frame ORDER BY root) AS BIGINT) AS group_id FROM r)"


def _matched(o):
    return crossview.match_views(crossview.accepted(_scores(o)), ["frame"])


def _groups(o):
    return crossview.groups(o.select("frame", "obs", "view_id").distinct(), _matched(o), ["frame"])


@query("d14_e16_e20_groups", f"{FUSED} SELECT frame, obs, group_id FROM gr")
def _(spark, sf):
    return _groups(cut(_observed(spark, sf)))


@query("a17_fused_instances", f"{FUSED}, f AS (SELECT gr.group_id, o.*, row_number() OVER (PARTITION BY o.frame, gr.group_id, o.key ORDER BY o.obs) AS q FROM o JOIN gr ON gr.frame = o.frame AND gr.obs = o.obs) SELECT frame, group_id, round(median(wx), 5) AS cx, round(median(wy), 5) AS cy, round(median(wz), 5) AS cz, min(vx) AS min_vx, max(vx) AS max_vx, min(vy) AS min_vy, max(vy) AS max_vy, min(vz) AS min_vz, max(vz) AS max_vz, count(*) AS n_points FROM f WHERE q = 1 GROUP BY frame, group_id")
def _(spark, sf):
    o = cut(_observed(spark, sf))
    return crossview.fused_instances(crossview.fuse(o, _groups(o), ["frame"], WORLD), ["frame"], 5)


@query("e13_e19_counters", f"{FUSED}, f AS (SELECT DISTINCT o.frame, gr.group_id, o.key FROM o JOIN gr ON gr.frame = o.frame AND gr.obs = o.obs), pb AS (SELECT frame, count(*) AS n FROM o GROUP BY ALL), pa AS (SELECT frame, count(*) AS n FROM f GROUP BY ALL), pc AS (SELECT frame, count(*) AS n FROM p GROUP BY ALL), pm AS (SELECT frame, count(*) AS n FROM ok GROUP BY ALL) SELECT pb.frame, coalesce(pc.n, 0) AS pairs, coalesce(pm.n, 0) AS matches, pb.n AS points_before, coalesce(pa.n, 0) AS points_after, round((1e0 - pa.n / CAST(greatest(1, pb.n) AS DOUBLE)) * 100, 4) AS reduction FROM pb LEFT JOIN pa USING (frame) LEFT JOIN pc USING (frame) LEFT JOIN pm USING (frame)")
def _(spark, sf):
    o = cut(_observed(spark, sf))
    m = cut(_matched(o))
    g = crossview.groups(o.select("frame", "obs", "view_id").distinct(), m, ["frame"])
    n = crossview.counters(_pairs(o), m, o, crossview.fuse(o, g, ["frame"], ["wx"]), ["frame"])
    return n.withColumn("reduction", F.round(S.reduction_percent(c("points_before"), c("points_after")), 4))


@query("f05_dilate_voxels", f"{CHAIN}, g AS (SELECT unnest([-1, 0, 1]) AS d), near AS (SELECT DISTINCT view_id, ((vx + i.d + 1048576) << 42) | ((vy + j.d + 1048576) << 21) | (vz + k.d + 1048576) AS key FROM first, g i, g j, g k) SELECT view_id, count(*) AS n, min(key) AS least, max(key) AS most FROM near GROUP BY view_id")
def _(spark, sf):
    near = voxel.neighbourhood(_first(spark, sf).select("view_id", "key").distinct(), ["view_id"], 1)
    return near.groupBy("view_id").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))


@query("f07_rank_in_segment", f"{CHAIN} SELECT frame, view_id, label, key, CAST(row_number() OVER (PARTITION BY frame, view_id, label ORDER BY key) - 1 AS INT) AS rank FROM first")
def _(spark, sf):
    return voxel.rank_in_segment(_first(spark, sf), ["frame", "view_id", "label"], ["key"]).select("frame", "view_id", "label", "key", "rank")


@query("e18_segment_offsets", f"{CHAIN}, n AS (SELECT frame, label, least(count(*), 200) AS n FROM first GROUP BY ALL) SELECT frame, label, n, CAST(coalesce(sum(n) OVER (PARTITION BY frame ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")
def _(spark, sf):
    return voxel.segment_offsets(_first(spark, sf), ["frame"], "label", 200)


@query("a11_point_cloud", f"{CHAIN} SELECT view_id, count(*) AS n, round(min(CAST(CASE WHEN l_partkey % 2 = 0 THEN wx ELSE wy END AS FLOAT)), 4) AS least, max(CAST((((l_partkey % 256) << 16) | ((l_suppkey % 256) << 8) | (l_linenumber % 256)) AS INT)) AS rgb FROM first GROUP BY view_id")
def _(spark, sf):
    # Where the pose is unknown, the point of the camera is taken.
    known = c("l_partkey") % 2 == 0
    p = _first(spark, sf).select("view_id", *[F.when(known, c(a)).alias(a) for a in ("wx", "wy", "wz")], c("wy").alias("px"), c("wx").alias("py"), c("wz").alias("pz"), (c("l_partkey") % 256).alias("r"), (c("l_suppkey") % 256).alias("g"), (c("l_linenumber") % 256).alias("b"))
    return sources.cloud(p, ["view_id"]).groupBy("view_id").agg(F.count("*").alias("n"), F.round(F.min("x"), 4).alias("least"), F.max("rgb").alias("rgb"))


# --- identities ------------------------------------------------------------------------------

CENT = f"{CHAIN}, g AS (SELECT frame, label, CAST({OBS} AS BIGINT) AS group_id, median(wx) AS cx, median(wy) AS cy, median(wz) AS cz FROM first GROUP BY ALL)"


def _centroids(spark, sf):
    return _observed(spark, sf).groupBy("frame", "label", c("obs").alias("group_id")).agg(F.median("wx").alias("cx"), F.median("wy").alias("cy"), F.median("wz").alias("cz"))


#: Frame numbers with gaps: each processed frame is three after the one before.
NUMBERED = f"{CENT}, k AS (SELECT *, dense_rank() OVER (ORDER BY frame) AS n FROM g)"
NEAR = "sqrt((b.cx - a.cx) ** 2 + (b.cy - a.cy) ** 2 + (b.cz - a.cz) ** 2)"


@query("d12_cross_frame_candidates", f"{NUMBERED} SELECT b.frame * 3 AS frame, b.label, a.group_id AS a, b.group_id AS b, round({NEAR}, 5) AS distance FROM k a JOIN k b ON b.n = a.n + 1 AND a.label = b.label WHERE {NEAR} <= 0.3e0")
def _(spark, sf):
    g = _centroids(spark, sf).withColumn("frame", c("frame") * 3)
    return crossframe.candidates(g.withColumn("rig", F.lit(0)), ["rig"], gate=0.3).select("frame", "label", "a", "b", F.round("distance", 5).alias("distance"))


CH = f"{CENT}, pt AS (SELECT DISTINCT frame, CAST({OBS} AS BIGINT) AS group_id, wx AS x, wy AS y, wz AS z FROM first), cp AS (SELECT b.frame, a.group_id AS a, b.group_id AS b FROM g a JOIN g b ON b.frame = a.frame + 1 AND a.label = b.label AND a.group_id = b.group_id), d AS (SELECT cp.frame, a, b, u.x AS ux, u.y AS uy, u.z AS uz, v.x AS vx, v.y AS vy, v.z AS vz, sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.z - v.z) ** 2) AS d FROM cp JOIN pt u ON u.frame = cp.frame - 1 AND u.group_id = a JOIN pt v ON v.frame = cp.frame AND v.group_id = b)"
CHAMFER = CH + ", f AS (SELECT frame, a, b, avg(m) AS m FROM (SELECT frame, a, b, min(d) AS m FROM d GROUP BY frame, a, b, ux, uy, uz) GROUP BY ALL), k AS (SELECT frame, a, b, avg(m) AS m FROM (SELECT frame, a, b, min(d) AS m FROM d GROUP BY frame, a, b, vx, vy, vz) GROUP BY ALL) SELECT f.frame, f.a, f.b, round(0.5e0 * (f.m + k.m), 5) AS chamfer FROM f JOIN k USING (frame, a, b)"


def _points(o):
    return o.select(F.lit(0).alias("rig"), "frame", c("obs").alias("group_id"), c("wx").alias("x"), c("wy").alias("y"), c("wz").alias("z")).distinct()


def _chamfer(spark, sf):
    """Each group with the same one of the frame before, on all points."""
    o = cut(_observed(spark, sf))
    g = o.select(F.lit(0).alias("rig"), "frame", c("obs").alias("group_id")).distinct()
    pairs = g.join(crossframe.frames_before(g, ["rig"]), ["rig", "frame"]).select("rig", "frame", "before", c("group_id").alias("a"), c("group_id").alias("b"))
    pairs = pairs.join(g.select("rig", c("frame").alias("before"), c("group_id").alias("a")), ["rig", "before", "a"], "left_semi")
    return crossframe.chamfer(pairs, _points(o), ["rig"])


@query("d13_chamfer", CHAMFER)
def _(spark, sf):
    return crossframe.cap_chamfer(_chamfer(spark, sf), None).select("frame", "a", "b", F.round("chamfer", 5).alias("chamfer"))


@query("c09_chamfer_cap", f"SELECT frame, a, b FROM ({CHAMFER}) WHERE chamfer <= 0.2e0")
def _(spark, sf):
    return crossframe.cap_chamfer(_chamfer(spark, sf).withColumn("chamfer", F.round("chamfer", 5)), 0.2).select("frame", "a", "b")


@query("j04_global_ids")
def _(spark, sf):
    g = cut(_centroids(spark, sf).withColumn("rig", F.lit("r0")))
    near = crossframe.candidates(g, ["rig"], gate=2.0).withColumnRenamed("distance", "cost")
    return crossframe.global_ids(g.select("rig", "frame").distinct(), g.select("rig", "frame", "group_id", "label"), near, ["rig"])


COST = "SELECT CAST(c_nationkey AS BIGINT) AS frame, c_custkey % 4 AS a, (c_custkey // 4) % 4 AS b, min(abs(c_acctbal)) / 10000e0 AS cost FROM customer GROUP BY ALL"


#: All assignments of four rows to four columns or none (-1), from k (frame, a, b, cost).
BEST = """ f AS (SELECT DISTINCT frame FROM k), n AS (SELECT unnest([0, 1, 2, 3, -1]) AS v), full_ AS (SELECT f.frame, p.v AS p, q.v AS q, r.v AS r, s.v AS s FROM f, n p, n q, n r, n s WHERE (p.v < 0 OR p.v NOT IN (q.v, r.v, s.v)) AND (q.v < 0 OR q.v NOT IN (r.v, s.v)) AND (r.v < 0 OR r.v <> s.v)),
 t AS (SELECT x.frame, (CASE WHEN a.cost IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN b.cost IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN c.cost IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN d.cost IS NOT NULL THEN 1 ELSE 0 END) AS n, coalesce(a.cost, 0) + coalesce(b.cost, 0) + coalesce(c.cost, 0) + coalesce(d.cost, 0) AS total FROM full_ x LEFT JOIN k a ON a.frame = x.frame AND a.a = 0 AND a.b = p LEFT JOIN k b ON b.frame = x.frame AND b.a = 1 AND b.b = q LEFT JOIN k c ON c.frame = x.frame AND c.a = 2 AND c.b = r LEFT JOIN k d ON d.frame = x.frame AND d.a = 3 AND d.b = s)
 SELECT frame, CAST(max(n) AS BIGINT) AS n, round(min(total) FILTER (n = m), 6) AS total FROM (SELECT *, max(n) OVER (PARTITION BY frame) AS m FROM t) GROUP BY frame"""


@query("d14_optimal_assignment", f"WITH k AS ({COST}),{BEST}")
def _(spark, sf):
    k = table(spark, sf, "customer").groupBy(c("c_nationkey").cast("bigint").alias("frame"), (c("c_custkey") % 4).alias("a"), (F.expr("c_custkey div 4") % 4).alias("b")).agg((F.min(F.abs("c_acctbal")) / 10000.0).alias("cost"))
    return detect.optimal_match(k, ["frame"]).groupBy("frame").agg(F.count("*").alias("n"), r6(F.sum("cost")).alias("total"))


@query("d18_associate", f"WITH g AS (SELECT CAST(c_nationkey AS BIGINT) AS frame, c_custkey % 4 AS a, (c_custkey // 4) % 4 AS b, min(c_custkey) AS q FROM customer GROUP BY ALL), p AS (SELECT *, CASE WHEN q % 9 <> 0 THEN (q % 50) / 100e0 END AS d, (q % 11) / 10e0 AS i, (q % 13) / 13e0 AS e, q % 3 = 0 AS s FROM g), k AS (SELECT frame, a, b, coalesce(d, 0) + 0.5e0 * (1 - i) + 0.25e0 * e + CASE WHEN s THEN 0 ELSE 0.7e0 END AS cost FROM p WHERE NOT (i < 0.3e0 AND (d IS NULL OR d > 0.2e0))),{BEST}")
def _(spark, sf):
    g = table(spark, sf, "customer").groupBy(c("c_nationkey").cast("bigint").alias("frame"), (c("c_custkey") % 4).alias("track"), (F.expr("c_custkey div 4") % 4).alias("det")).agg(F.min("c_custkey").alias("q"))
    q = c("q")
    pairs = g.select("frame", "track", "det", F.when(q % 9 != 0, q % 50 / 100.0).alias("dist"), (q % 11 / 10.0).alias("iou"), (q % 13 / 13.0).alias("embedding_distance"), (q % 3 == 0).alias("same_label"))
    got = detect.associate(pairs, ["frame"], 0.2, 0.3, (1.0, 0.5, 0.25), 0.7)
    return got.groupBy("frame").agg(F.count("*").alias("n"), r6(F.sum("cost")).alias("total"))


@query(
    "d15_greedy_match",
    """WITH RECURSIVE e AS (SELECT CAST(c_nationkey AS BIGINT) AS frame, c_custkey % 7 AS det, (c_custkey // 7) % 5 AS track, max(abs(c_acctbal) / 10000e0) AS iou FROM customer GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY iou DESC, det DESC, track DESC) AS i FROM e WHERE iou >= 0.05e0),
 w AS (SELECT DISTINCT frame, 0::BIGINT AS i, []::BIGINT[] AS dets, []::BIGINT[] AS tracks, NULL::BIGINT AS det, NULL::BIGINT AS track FROM k UNION ALL
  SELECT frame, i, CASE WHEN ok THEN list_append(dets, d) ELSE dets END, CASE WHEN ok THEN list_append(tracks, t) ELSE tracks END, CASE WHEN ok THEN d END, CASE WHEN ok THEN t END FROM (SELECT w.frame, k.i, w.dets, w.tracks, k.det AS d, k.track AS t, NOT list_contains(w.dets, k.det) AND NOT list_contains(w.tracks, k.track) AS ok FROM w JOIN k ON k.frame = w.frame AND k.i = w.i + 1))
 SELECT frame, det, track FROM w WHERE det IS NOT NULL""",
)
def _(spark, sf):
    e = table(spark, sf, "customer").select(c("c_nationkey").cast("bigint").alias("frame"), (c("c_custkey") % 7).alias("det"), (F.expr("c_custkey div 7") % 5).alias("track"), (F.abs("c_acctbal") / 10000.0).alias("iou"))
    return detect.greedy_match(e.groupBy("frame", "det", "track").agg(F.max("iou").alias("iou")), ["frame"], 0.05)


@query(
    "d16_fill_free_slots",
    """WITH d AS (SELECT CAST(c_nationkey AS BIGINT) AS frame, c_custkey AS det, c_acctbal AS score FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det) AS k FROM d WHERE det % 5 <> 0),
 s AS (SELECT CAST(n_nationkey AS BIGINT) AS frame, t AS track, row_number() OVER (PARTITION BY n_nationkey ORDER BY t) AS k FROM nation, range(6) r(t) WHERE t % 2 = 0 AND NOT (t = 4 AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 5 = 0))) SELECT frame, det, track FROM k JOIN s USING (frame, k)""",
)
def _(spark, sf):
    d = table(spark, sf, "customer").select(c("c_nationkey").cast("bigint").alias("frame"), c("c_custkey").alias("det"), c("c_acctbal").alias("score"))
    s = table(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("frame"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("track"))
    s = s.select("frame", "track", c("track").alias("class_slot"), (c("track") % 2 == 0).alias("free"))
    matched = d.where("det % 5 = 0").select("frame", "det", F.lit(4).cast("bigint").alias("track"))
    return detect.fill_free_slots(d, s, matched, ["frame"], [c("score").desc(), c("det")])


@query("d18_composite_cost", "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 50) / 100e0 END AS d, (c_custkey % 11) / 10e0 AS i, (c_custkey % 13) / 13e0 AS e, c_custkey % 3 = 0 AS s FROM customer) SELECT c_custkey, round(coalesce(d, 0) + 0.5e0 * (1 - i) + 0.25e0 * e + CASE WHEN s THEN 0 ELSE 0.7e0 END, 6) AS cost FROM p WHERE NOT (i < 0.3e0 AND (d IS NULL OR d > 0.2e0))")
def _(spark, sf):
    k = c("c_custkey")
    d, i, e = F.when(k % 9 != 0, k % 50 / 100.0), k % 11 / 10.0, k % 13 / 13.0
    cost = detect.composite_cost(d, i, e, k % 3 == 0, 0.2, 0.3, (1.0, 0.5, 0.25), 0.7)
    return table(spark, sf, "customer").select("c_custkey", r6(cost).alias("cost")).where("cost is not null")


# --- streams ---------------------------------------------------------------------------------

SLOP = SLOP_US = 600_000_000  # ten minutes, in microseconds


@query(
    "d01_pair_nearest",
    f"""WITH m AS ({MESSAGES}), a AS (SELECT DISTINCT user_id, stamp_us AS stamp_a FROM m WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, stamp_us AS stamp_b FROM m WHERE event_type = 'view'),
 p AS (SELECT user_id, stamp_a, stamp_b, abs(stamp_a - stamp_b) AS skew FROM a JOIN b USING (user_id) WHERE abs(stamp_a - stamp_b) <= {60 * SLOP}), q AS (SELECT *, row_number() OVER (PARTITION BY user_id, stamp_a ORDER BY skew, stamp_b) AS i, row_number() OVER (PARTITION BY user_id, stamp_b ORDER BY skew, stamp_a) AS j FROM p) SELECT user_id, stamp_a, stamp_b, skew FROM q WHERE i = 1 AND j = 1""",
)
def _(spark, sf):
    m = bind.messages(spark, sf)
    side = lambda t: m.where(c("event_type") == t).select("user_id", "stamp_us").distinct()
    return streams.pair_nearest(side("click"), side("view"), ["user_id"], 60 * SLOP, "stamp_us")


@query("d02_d04_as_of", f"WITH m AS ({MESSAGES}), a AS (SELECT event_id, user_id, stamp_us FROM m WHERE event_type = 'click'), b AS (SELECT user_id, stamp_us AS at, value FROM m WHERE event_type = 'view') SELECT a.event_id, a.user_id, round(b.value, 6) AS value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.stamp_us >= b.at")
def _(spark, sf):
    m = bind.messages(spark, sf)
    a = m.where("event_type = 'click'").select("event_id", "user_id", "stamp_us")
    b = m.where("event_type = 'view'").select("user_id", c("stamp_us").alias("at"), "value")
    return streams.as_of(a, b, ["user_id"], "stamp_us", "at", ["value"]).select("event_id", "user_id", r6(c("value")).alias("value"))


@query("a03_calibration", f"WITH m AS (SELECT *, arrival * 1000000 + event_id AS t FROM ({MESSAGES})), a AS (SELECT event_id, user_id, t FROM m WHERE event_type = 'click'), b AS (SELECT user_id, t, stamp_us AS info_us FROM m WHERE event_type = 'view') SELECT a.event_id, a.user_id, b.info_us FROM a ASOF JOIN b ON a.user_id = b.user_id AND a.t >= b.t")
def _(spark, sf):
    m = bind.messages(spark, sf).withColumn("at", c("arrival") * 1_000_000 + c("event_id"))
    pairs = m.where("event_type = 'click'").select("event_id", "user_id", "at")
    infos = m.where("event_type = 'view'").select("user_id", "at", c("stamp_us").alias("info_us"))
    return sources.latest_calibration(pairs, infos, ["user_id"], "at", ["info_us"], 1e9).select("event_id", "user_id", "info_us")


@query(
    "d03_bundles",
    f"""WITH RECURSIVE m AS ({MESSAGES}), k AS (SELECT user_id, event_type, stamp_us * 1000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY stamp_us) AS i FROM m WHERE event_type IN ('click', 'view')),
 w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS c, NULL::BIGINT AS v, 0::BIGINT AS n, NULL::BIGINT AS lo, NULL::BIGINT AS hi FROM k UNION ALL
  SELECT user_id, i, CASE WHEN hit OR c < v THEN NULL ELSE c END, CASE WHEN hit OR v < c THEN NULL ELSE v END, n + CASE WHEN hit THEN 1 ELSE 0 END, CASE WHEN hit THEN least(c, v) END, CASE WHEN hit THEN greatest(c, v) END
  FROM (SELECT *, coalesce(abs(c - v) <= {60 * SLOP_US * 1000}, false) AS hit FROM (SELECT w.user_id, k.i, CASE WHEN k.event_type = 'click' THEN k.s ELSE w.c END AS c, CASE WHEN k.event_type = 'view' THEN k.s ELSE w.v END AS v, w.n FROM w JOIN k ON k.user_id = w.user_id AND k.i = w.i + 1)))
 SELECT user_id AS rig, n, lo AS first_ns, hi AS last_ns FROM w WHERE lo IS NOT NULL""",
)
def _(spark, sf):
    m = bind.messages(spark, sf).select(c("user_id").alias("rig"), c("event_type").alias("view"), (c("stamp_us") * 1000).alias("stamp_ns"), c("stamp_us").alias("arrival"))
    return streams.bundles(m, "rig", ["click", "view"], 60 * SLOP * 1000)


@query(
    "j01_latest_wins_queue",
    f"""WITH RECURSIVE m AS ({MESSAGES}), k AS (SELECT user_id, event_id AS id, stamp_us AS t, row_number() OVER (PARTITION BY user_id ORDER BY stamp_us, event_id) AS i FROM m),
 w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS qt, NULL::BIGINT AS qi, NULL::BIGINT AS free, NULL::BIGINT AS id, NULL::BIGINT AS "at", NULL::VARCHAR AS outcome FROM k UNION ALL
  SELECT user_id, i, t, new, CASE WHEN served THEN begin_ + {3 * SLOP_US} ELSE free END, qi, CASE WHEN served THEN begin_ WHEN qi IS NOT NULL THEN t END, CASE WHEN served THEN 'processed' WHEN qi IS NOT NULL THEN 'evicted' END
  FROM (SELECT w.user_id, k.i, k.t, k.id AS new, w.qi, w.free, coalesce(greatest(w.free, w.qt), w.qt) AS begin_, w.qi IS NOT NULL AND (w.free IS NULL OR w.free <= k.t) AS served FROM w JOIN k ON k.user_id = w.user_id AND k.i = w.i + 1))
 SELECT user_id, id, "at", outcome FROM w WHERE id IS NOT NULL UNION ALL SELECT user_id, qi, coalesce(greatest(free, qt), qt), 'processed' FROM (SELECT *, max(i) OVER (PARTITION BY user_id) AS z FROM w) WHERE i = z""",
)
def _(spark, sf):
    return streams.queue_outcomes(bind.messages(spark, sf).select("user_id", c("event_id").alias("id"), c("stamp_us").alias("t")), "user_id", 3 * SLOP)


FRAMES_OF_USERS = f"m AS ({MESSAGES}), k AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM m)"


def _frames_of_users(spark, sf):
    return bind.messages(spark, sf).withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)


@query(
    "j05_j06_refreshes",
    f"""WITH RECURSIVE {FRAMES_OF_USERS}, x AS (SELECT user_id, frame, CASE WHEN event_type <> 'error' THEN value / 500e0 END AS presence, 3 + event_id % 4 AS service FROM k),
 w AS (SELECT DISTINCT user_id, -1::BIGINT AS frame, NULL::BIGINT AS last, NULL::BIGINT AS job, NULL::BIGINT AS ready, NULL::BIGINT AS result_of, NULL::VARCHAR AS reason, false AS accepted FROM k UNION ALL
  SELECT user_id, frame, CASE WHEN taken THEN frame ELSE last END, CASE WHEN taken THEN frame ELSE job END, CASE WHEN taken THEN frame + service WHEN job IS NOT NULL THEN ready END, got, reason, taken
  FROM (SELECT *, reason IS NOT NULL AND job IS NULL AS taken FROM (SELECT *, CASE WHEN last IS NULL OR frame - last >= 3 THEN CASE WHEN presence IS NULL OR presence < 0.02e0 THEN 'tracking_anomaly' WHEN last IS NULL OR frame - last >= 10 THEN 'periodic' END END AS reason
   FROM (SELECT w.user_id, x.frame, x.presence, x.service, w.last, w.ready, CASE WHEN x.frame >= w.ready THEN w.job END AS got, CASE WHEN w.ready IS NULL OR x.frame < w.ready THEN w.job END AS job FROM w JOIN x ON x.user_id = w.user_id AND x.frame = w.frame + 1))))
 SELECT user_id, frame, result_of, reason, accepted FROM w WHERE frame >= 0""",
)
def _(spark, sf):
    f = _frames_of_users(spark, sf).select("user_id", "frame", F.when(c("event_type") != "error", c("value") / 500.0).alias("presence"), (c("event_id") % 4 + 3).alias("service"))
    return streams.refreshes(f, "user_id", 10, 3, 0.02)


@query("j08_history_ring", f"WITH {FRAMES_OF_USERS}, q AS (SELECT user_id, event_id AS arrival_frame, lag(event_id, CAST(1 + event_id % 6 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS ref_frame FROM k), p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM k WHERE event_type <> 'error') SELECT q.user_id, ref_frame, arrival_frame, coalesce(a.n - r.n BETWEEN 0 AND 3, false) AS available FROM q LEFT JOIN p a ON a.user_id = q.user_id AND a.event_id = arrival_frame LEFT JOIN p r ON r.user_id = q.user_id AND r.event_id = ref_frame WHERE ref_frame IS NOT NULL")
def _(spark, sf):
    m = bind.messages(spark, sf)
    w = Window.partitionBy("user_id").orderBy("event_id")
    back = F.coalesce(*[F.when(c("event_id") % 6 == k - 1, F.lag("event_id", k).over(w)) for k in range(1, 7)])
    asked = m.select("user_id", back.alias("ref_frame"), c("event_id").alias("arrival_frame")).where("ref_frame is not null")
    return streams.history_ring(m.where("event_type <> 'error'").select("user_id", c("event_id").alias("frame")), asked, "user_id", 4, 1000)


CORR = f"WITH m AS ({MESSAGES}) SELECT event_id AS ref_frame, event_id + CAST(floor(abs(value)) AS BIGINT) % 60 AS arrival_frame FROM m WHERE event_type = 'error'"


@query("d19_corrections", f"WITH k AS ({CORR}) SELECT ref_frame, arrival_frame, CASE WHEN ref_frame >= arrival_frame THEN 'reference_not_older_than_current' WHEN ref_frame < arrival_frame - 32 THEN 'reference_feature_expired' END AS reason, NOT (ref_frame >= arrival_frame OR ref_frame < arrival_frame - 32) AS admitted FROM k")
def _(spark, sf):
    k = bind.messages(spark, sf).where("event_type = 'error'").select(c("event_id").alias("ref_frame"), (c("event_id") + F.floor(F.abs("value")) % 60).alias("arrival_frame"))
    return streams.admit_corrections(k, 32)


GAPS = f"WITH m AS ({MESSAGES}), l AS (SELECT *, lag(stamp_us) OVER (PARTITION BY user_id ORDER BY arrival, event_id) AS b FROM m), g AS (SELECT *, CASE WHEN stamp_us > b THEN stamp_us - b END AS gap, coalesce(stamp_us <= b, false) AS back FROM l)"


@query("f08_gaps", f"{GAPS} SELECT event_id, user_id, gap, back AS non_monotonic FROM g")
def _(spark, sf):
    return streams.gaps(bind.messages(spark, sf), ["user_id"], "stamp_us", ["arrival", "event_id"], 1000).select("event_id", "user_id", "gap", "non_monotonic")


@query("e15_stream_rates", f"{GAPS} SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 2 AND max(stamp_us) > min(stamp_us) THEN round((count(*) - 1) * 3.6e9 / (max(stamp_us) - min(stamp_us)), 6) END AS rate, round(avg(gap) / 1e6, 3) AS gap_mean, round(median(gap) / 1e6, 3) AS gap_median, round(quantile_cont(gap, 0.95) / 1e6, 3) AS gap_p95, max(gap) AS gap_max, count(*) FILTER (back) AS n_non_monotonic FROM g GROUP BY user_id")
def _(spark, sf):
    g = streams.gaps(bind.messages(spark, sf), ["user_id"], "stamp_us", ["arrival", "event_id"], 1000)
    return streams.rates(g, ["user_id"], "stamp_us", 3.6e9, 6).withColumns({k: F.round(c(k) / 1e6, 3) for k in ("gap_mean", "gap_median", "gap_p95")})


REPORT = 432_000_000_000  # five days, in microseconds


def _four(value: str, name: str) -> str:
    return f"round(avg({value}), 6) AS {name}_mean, round(median({value}), 6) AS {name}_median, round(quantile_cont({value}, 0.95), 6) AS {name}_p95, round(max({value}), 6) AS {name}_max"


@query(
    "e15_rate_report",
    f"""WITH m AS (SELECT *, stamp_us + arrival * 1000000 AS wall_us FROM ({MESSAGES})), p AS (SELECT *, (wall_us // {REPORT}) * {REPORT} AS win, lag(stamp_us) OVER (PARTITION BY event_type ORDER BY wall_us, event_id) AS before FROM m),
 g AS (SELECT *, (wall_us - lag(wall_us) OVER w) / 1000e0 AS wg, (stamp_us - lag(stamp_us) OVER w) / 1000e0 AS sg, coalesce(stamp_us <= before, false) AS back FROM p WINDOW w AS (PARTITION BY event_type, win ORDER BY wall_us, event_id)),
 h AS (SELECT *, CASE WHEN wg > 0 THEN wg END AS wp, CASE WHEN sg > 0 THEN sg END AS sp FROM g), r AS (SELECT event_type, win, count(*) AS n, first(stamp_us ORDER BY wall_us, event_id) AS a, last(stamp_us ORDER BY wall_us, event_id) AS z, {_four('wp', 'wall_gap')}, {_four('sp', 'stamp_gap')}, count(*) FILTER (back) AS n_non_monotonic FROM h GROUP BY ALL)
 SELECT * EXCLUDE (win, a, z), win AS "window", round(n * (1e6 / {REPORT}e0), 6) AS wall_rate, CASE WHEN n >= 2 AND z > a THEN round((n - 1) * 1e6 / (z - a), 6) END AS stamp_rate FROM r""",
)
def _(spark, sf):
    m = bind.messages(spark, sf).withColumn("wall_us", c("stamp_us") + c("arrival") * 1_000_000)
    return streams.rate_report(m, ["event_type"], "wall_us", "stamp_us", ["wall_us", "event_id"], REPORT, 1e6)


@query(
    "e15_sync_report",
    f"""WITH m AS (SELECT *, (stamp_us // {REPORT}) * {REPORT} AS win FROM ({MESSAGES})), t AS (SELECT win, stamp_us AS a, stamp_us + event_id % 7 * 1000 - 3000 AS b, stamp_us - event_id % 11 * 2000 AS c, event_id FROM m WHERE event_type = 'click'), s AS (SELECT *, abs(a - b) / 1000e0 AS ab, abs(a - c) / 1000e0 AS ac, abs(b - c) / 1000e0 AS bc, (greatest(a, b, c) - least(a, b, c)) / 1000e0 AS abc FROM t),
 r AS (SELECT win, count(*) FILTER (event_type IN ('click', 'view')) AS colour, count(*) FILTER (event_type IN ('click', 'error')) AS depth FROM m GROUP BY win), d AS (SELECT win, count(*) AS dropped FROM t WHERE event_id % 13 = 0 GROUP BY win), o AS (SELECT win, count(*) AS n, {_four('ab', 'colour_depth')}, {_four('ac', 'colour_info')}, {_four('bc', 'depth_info')}, {_four('abc', 'tuple_span')} FROM s GROUP BY win)
 SELECT o.* EXCLUDE (win), o.win AS "window", round(100e0 * n / colour, 6) AS sync_colour_pct, round(100e0 * n / depth, 6) AS sync_depth_pct, round(100e0 * coalesce(dropped, 0) / n, 6) AS drop_pct FROM o JOIN r ON r.win = o.win LEFT JOIN d ON d.win = o.win""",
)
def _(spark, sf):
    m = bind.messages(spark, sf).withColumn("window", F.floor(c("stamp_us") / REPORT) * REPORT)
    t = m.where("event_type = 'click'").select("window", "event_id", c("stamp_us").alias("colour"), (c("stamp_us") + c("event_id") % 7 * 1000 - 3000).alias("depth"), (c("stamp_us") - c("event_id") % 11 * 2000).alias("info"))
    raw = m.groupBy("window").agg(F.count_if(c("event_type").isin("click", "view")).alias("colour"), F.count_if(c("event_type").isin("click", "error")).alias("depth"))
    return streams.sync_report(t, raw, t.where("event_id % 13 = 0").groupBy("window").agg(F.count("*").alias("dropped")), ["window"], 1e6)


@query("f10_missing_runs", f"WITH m AS ({MESSAGES}), s AS (SELECT user_id, event_id, event_type = 'error' AS lost FROM m), g AS (SELECT *, sum(CASE WHEN lost THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM s) SELECT user_id, event_id, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS missing_frames, sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) >= 2 AS released FROM g")
def _(spark, sf):
    s = bind.messages(spark, sf).withColumn("status", F.when(c("event_type") == "error", "lost").otherwise("visible"))
    return streams.missing_runs(s, ["user_id"], "event_id", 2, 500).select("user_id", "event_id", "missing_frames", "released")


@query("f12_running_totals", f"WITH m AS ({MESSAGES}) SELECT event_id, CAST(sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM m")
def _(spark, sf):
    m = bind.messages(spark, sf).withColumn("v", c("event_id") % 10)
    return streams.running_totals(m, ["user_id"], ["event_id"], "v", 500).select("event_id", "total")


@query("f13_report_windows", "SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    return streams.report_windows(e, ["event_type"], "ts", "1 day")


@query(
    "f13_call_windows",
    """WITH RECURSIVE e AS (SELECT event_type, CAST(epoch_us(ts) AS BIGINT) AS t, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT event_type, min(t) AS s FROM e GROUP BY event_type
  UNION ALL SELECT w.event_type, min(e.t) FROM w JOIN e ON e.event_type = w.event_type AND e.t >= w.s + 21600000000 GROUP BY w.event_type, w.s),
 x AS (SELECT event_type, s, lead(s) OVER (PARTITION BY event_type ORDER BY s) AS f, row_number() OVER (PARTITION BY event_type ORDER BY s) AS k FROM w)
 SELECT x.event_type, x.s AS start, x.f AS "end", CAST(coalesce(sum(e.n), 0) AS BIGINT) AS n FROM x LEFT JOIN e ON e.event_type = x.event_type AND (e.t > x.s OR (x.k = 1 AND e.t = x.s)) AND (x.f IS NULL OR e.t <= x.f) GROUP BY ALL""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(c("ts").cast("timestamp")))
    return streams.call_windows(e, ["event_type"], "us", 21_600_000_000)


TIMES = "SELECT CAST(event_id // 5 AS BIGINT) AS frame, event_type AS stage, sum(value) AS value_ms FROM events GROUP BY ALL"


def _sums(spark, sf):
    return profile.stage_sums(table(spark, sf, "events").select(F.expr("event_id div 5").cast("bigint").alias("frame"), c("event_type").alias("stage"), c("value").alias("value_ms")))


@query("e17_stage_sums", f"WITH t AS ({TIMES}) SELECT frame, stage, round(value_ms, 5) AS value_ms FROM t")
def _(spark, sf):
    return _sums(spark, sf).withColumn("value_ms", F.round("value_ms", 5))


@query("e14_f11_stage_summary", f"WITH t AS (SELECT frame, stage, round(value_ms, 6) AS value_ms FROM ({TIMES})), f AS (SELECT DISTINCT frame FROM t ORDER BY frame LIMIT 30) SELECT stage, count(*) AS n, round(avg(value_ms), 4) AS mean, round(median(value_ms), 4) AS median, round(quantile_cont(value_ms, 0.95), 4) AS p95, round(max(value_ms), 4) AS max, arg_max(frame, (value_ms, -frame)) AS max_frame FROM t WHERE frame NOT IN (SELECT frame FROM f) GROUP BY stage")
def _(spark, sf):
    return profile.summary(profile.after_warmup(_sums(spark, sf).withColumn("value_ms", r6(c("value_ms"))), 30), 4)


@query(
    "j03_slot_life",
    f"""WITH RECURSIVE {FRAMES_OF_USERS}, w AS (SELECT DISTINCT user_id, -1::BIGINT AS frame, NULL::VARCHAR AS status, 0::BIGINT AS missing, true AS active FROM k UNION ALL
  SELECT user_id, frame, CASE WHEN NOT on_ THEN NULL WHEN seen THEN 'visible' ELSE 'lost' END, CASE WHEN NOT on_ THEN missing WHEN seen THEN 0 ELSE missing + 1 END, on_ AND (seen OR missing + 1 < 2)
  FROM (SELECT w.user_id, k.frame, k.event_type <> 'error' AS seen, w.active OR k.event_type = 'click' AS on_, CASE WHEN NOT w.active AND k.event_type = 'click' THEN 0 ELSE w.missing END AS missing FROM w JOIN k ON k.user_id = w.user_id AND k.frame = w.frame + 1))
 SELECT user_id, frame, status, missing AS missing_frames, active FROM w WHERE frame >= 0""",
)
def _(spark, sf):
    m = _frames_of_users(spark, sf).select("user_id", "frame", (c("event_type") != "error").alias("visible"), (c("event_type") == "click").alias("corrected"))
    return streams.slot_lives(m, "user_id", 2)


@query("i_map_merge", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS a, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 ELSE c_custkey % 3 END AS b, CASE WHEN c_custkey % 4 <> 0 THEN 7 END::BIGINT AS c FROM customer")
def _(spark, sf):
    k = c("c_custkey")
    first = F.create_map(F.lit("a"), c("c_nationkey").cast("bigint"), F.lit("b"), k % 3)
    second = F.when(k % 4 != 0, F.create_map(F.lit("b"), k % 5, F.lit("c"), F.lit(7).cast("bigint")))
    m = table(spark, sf, "customer").select("c_custkey", S.merge_maps(first, second).alias("m"))
    return m.select("c_custkey", *[F.try_element_at("m", F.lit(x)).alias(x) for x in "abc"])


@query("h01_h02_h05_sets", "SELECT 'shared' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'unmatched', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', count(*) FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation)")
def _(spark, sf):
    cu, su, na = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    shared = cu.select("c_nationkey").intersect(su.select("s_nationkey"))
    unmatched = na.select("n_nationkey").exceptAll(su.select("s_nationkey"))
    both = su.select("s_nationkey").union(na.select("n_nationkey"))
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return count(shared, "shared").unionByName(count(unmatched, "unmatched")).unionByName(count(both, "all"))


@query("flagship_voxel_census", f"{CHAIN} SELECT view_id, label, count(DISTINCT key) AS n_voxels, round(median(wx), 5) AS cx, round(median(wy), 5) AS cy, round(median(wz), 5) AS cz FROM first GROUP BY ALL")
def flagship(spark, sf):
    """How many occupied voxels has each class in each camera, and where is their median?"""
    f = _first(spark, sf)
    return geometry.median_centroid(f, ["view_id", "label"], digits=5, groups=f.groupBy("view_id", "label").agg(F.countDistinct("key").alias("n_voxels")))


# --- sources, sinks and the rest -------------------------------------------------------------


@query("a05_make_frames", "SELECT event_type AS camera, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS INT) AS frame_index FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(c("event_type").alias("camera"), "event_id", c("ts").alias("ts_ns"))
    return sources.make_frames(e, 5).select("camera", "event_id", "frame_index")


@query("a10_timing_rows", f"WITH t AS ({TIMES}) SELECT frame, round(sum(value_ms) FILTER (stage = 'view'), 5) AS view, round(sum(value_ms) FILTER (stage = 'click'), 5) AS click, round(sum(value_ms) FILTER (stage = 'error'), 5) AS error FROM t WHERE stage IN ('view', 'click', 'error') GROUP BY frame")
def _(spark, sf):
    w = profile.wide(_sums(spark, sf), ["view"], ["error", "click"])
    return w.select("frame", *[F.round(k, 5).alias(k) for k in ("view", "click", "error")])


@query("a12_fused_cloud", f"{CHAIN} SELECT label, count(*) AS n, round(max(CAST(wz AS FLOAT)), 4) AS most, CAST(max(CASE (view_id + 5) % 6 WHEN 0 THEN 15093840 WHEN 5 THEN 4641495 ELSE 0 END) AS INT) AS rgb FROM first GROUP BY label")
def _(spark, sf):
    p = _first(spark, sf).select("label", "wx", "wy", "wz", F.lit(None).cast("bigint").alias("global_id"), c("view_id").alias("group_id"))
    return sources.fused_cloud(p, ["label"]).groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("z"), 4).alias("most"), F.max("rgb").alias("rgb"))


@query("a13_markers", f"WITH s AS ({SLOTS}), i AS (SELECT s_suppkey AS track_id, s_acctbal / 1000e0 AS cz, s_nationkey AS g FROM supplier) SELECT s.track_id, CASE WHEN cz IS NOT NULL THEN 'ADD' ELSE 'DELETE' END AS action, CASE WHEN cz IS NOT NULL THEN s.label || ' [slot ' || class_slot || '] G' || g END AS text, round(cz + 0.12e0, 6) AS text_z, CASE WHEN cz IS NOT NULL THEN 0.001e0 ELSE 0.001e0 END AS size_x FROM s LEFT JOIN i ON i.track_id = s.track_id")
def _(spark, sf):
    z = c("s_acctbal") / 1000.0
    i = table(spark, sf, "supplier").select(c("s_suppkey").cast("int").alias("track_id"), z.alias("cx"), z.alias("cz"), c("s_nationkey").alias("global_id"), F.lit(None).cast("int").alias("group_id"), *[F.lit(0.0).alias(f"{k}{a}") for k in ("lo", "hi") for a in "xyz"])
    return sources.markers(detect.slot_layout(spark, PROMPTS), i, ["track_id"]).select("track_id", "action", "text", r6(c("text_z")).alias("text_z"), "size_x")


@query("a14_overlay", "SELECT p_partkey, CAST(round(0.55e0 * (p_partkey % 256) + 0.45e0 * 230) AS INT) AS r, CAST(round(0.55e0 * (p_size % 256) + 0.45e0 * 80) AS INT) AS g, CAST(round(0.55e0 * 7 + 0.45e0 * 80) AS INT) AS b FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (c("p_partkey") % 256).alias("r"), (c("p_size") % 256).alias("g"), F.lit(7).alias("b"))
    return masks.overlay(p, S.palette_rgb(F.lit(0)))


@query("c11_active_slots", f"WITH s AS ({bind.SAMPLES}) SELECT frame, track_id, count(*) AS n FROM s WHERE track_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0) GROUP BY ALL")
def _(spark, sf):
    slots = table(spark, sf, "supplier").select(c("s_suppkey").alias("track_id"), (c("s_nationkey") % 2 == 0).alias("active"))
    return detect.on_active_slots(bind.samples(spark, sf), slots, ["track_id"]).groupBy("frame", "track_id").agg(F.count("*").alias("n"))


@query("d05_mask_depth", f"{M}, d AS (SELECT CAST((p_partkey - 1) % 64 AS INT) AS x, CAST(((p_partkey - 1) // 64) % 48 AS INT) AS y, min(p_retailprice) / 1000e0 AS z FROM part GROUP BY ALL) SELECT frame, label, count(*) AS n, round(min(z), 6) AS least, round(max(z), 6) AS most FROM m JOIN d ON d.x = m.x AND d.y = m.y GROUP BY ALL")
def _(spark, sf):
    d = table(spark, sf, "part").groupBy(F.expr("cast((p_partkey - 1) % 64 as int)").alias("x"), F.expr("cast(((p_partkey - 1) div 64) % 48 as int)").alias("y")).agg((F.min("p_retailprice") / 1000.0).alias("z"))
    m = _mask(spark, sf).select("frame", "label", "y", "x").distinct()
    return masks.with_depth(m, d, []).groupBy("frame", "label").agg(F.count("*").alias("n"), r6(F.min("z")).alias("least"), r6(F.max("z")).alias("most"))


@query("d06_record_views", f"WITH s AS ({bind.SAMPLES}), v AS (SELECT CAST(r_regionkey AS BIGINT) AS view_id, 600e0 + r_regionkey AS fx, 300e0 + 10 * r_regionkey AS cx, 0.15e0 * r_regionkey AS tx FROM region) SELECT view_id, count(*) AS n, round(min((x - cx) * z / fx + tx), 5) AS least, round(max((x - cx) * z / fx + tx), 5) AS most FROM s JOIN v USING (view_id) GROUP BY view_id")
def _(spark, sf):
    k = c("r_regionkey")
    v = table(spark, sf, "region").select(k.cast("bigint").alias("view_id"), (F.lit(600.0) + k).alias("fx"), (F.lit(300.0) + 10 * k).alias("cx"), (F.lit(0.15) * k).alias("tx"))
    px, _, _ = geometry.back_project(c("x"), c("x"), c("z"), c("fx"), c("fx"), c("cx"), c("cx"))
    s = geometry.with_views(bind.samples(spark, sf), v, ["view_id"]).select("view_id", px.alias("px"), "tx").withColumn("wx", c("px") + c("tx"))
    return s.groupBy("view_id").agg(F.count("*").alias("n"), F.round(F.min("wx"), 5).alias("least"), F.round(F.max("wx"), 5).alias("most"))


@query("a19_masks_on_demand", f"WITH m AS (SELECT DISTINCT track_id, x, y FROM ({MASK}) WHERE logit > 0) SELECT CAST(n_nationkey AS BIGINT) AS track_id, count(m.x) AS n, coalesce(min(y * 64 + x), -1)::BIGINT AS least, coalesce(max(y * 64 + x), -1)::BIGINT AS most FROM nation LEFT JOIN m ON m.track_id = n_nationkey GROUP BY ALL")
def _(spark, sf):
    asked = table(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("track_id"))
    m = masks.materialize(asked, _mask(spark, sf).select("track_id", "y", "x"), ["track_id"], 64)
    end = lambda f: F.coalesce(f("pixels"), F.lit(-1).cast("bigint"))
    return m.select("track_id", F.size("pixels").cast("bigint").alias("n"), end(F.array_min).alias("least"), end(F.array_max).alias("most"))


@query("d21_view_arity", f"WITH s AS ({bind.SAMPLES}) SELECT frame, count(DISTINCT view_id) AS views FROM s GROUP BY frame")
def _(spark, sf):
    s = bind.samples(spark, sf)
    return crossview.assert_arity(s, s.where("z > 0"), ["frame"])


@query("j13_fallback_masks", f"WITH m AS (SELECT DISTINCT track_id, x, y FROM ({MASK}) WHERE logit > 0) SELECT s.n_nationkey AS track_id, count(m.x) AS pixels FROM nation s LEFT JOIN m ON m.track_id = s.n_nationkey WHERE s.n_regionkey < 3 GROUP BY ALL")
def _(spark, sf):
    slots = table(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("track_id"), (c("n_regionkey") < 3).alias("active"))
    return detect.fallback_masks(slots, _mask(spark, sf).select("track_id", "x", "y").distinct(), ["track_id"]).select(c("track_id").cast("int").alias("track_id"), "pixels")


@query("e12_active_dummy", "SELECT s_nationkey, count(*) FILTER (s_acctbal > 0) AS n_active, count(*) FILTER (s_acctbal <= 0) AS n_dummy FROM supplier GROUP BY ALL")
def _(spark, sf):
    return detect.status_counts(table(spark, sf, "supplier").withColumn("active", c("s_acctbal") > 0), ["s_nationkey"])


@query("e20_group_numbers", f"{FUSED} SELECT frame, obs, group_id FROM gr")
def _(spark, sf):
    # Roots whose order is not that of the groups' first observations.
    g = _groups(cut(_observed(spark, sf))).select("frame", "obs", (100 - c("group_id")).alias("root"))
    return crossview.number_groups(g, ["frame"]).select("frame", "obs", c("group_id").cast("bigint").alias("group_id"))
