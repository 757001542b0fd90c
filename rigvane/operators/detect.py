"""Detections and slots: filters, ranks, suppression, seeding and association."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import assign
from .ordered import in_order


def parse_prompts(prompts: list) -> list[tuple[str, int]]:
    """B-24: prompts as text, (label, capacity) or {label, capacity}; stripped; empty, repeated or non-positive ones are errors."""
    out: list[tuple[str, int]] = []
    for p in prompts:
        label, cap = (p, 1) if isinstance(p, str) else (p["label"], p.get("capacity", 1)) if isinstance(p, dict) else p
        label, cap = str(label).strip(), int(cap)
        if not label or cap <= 0 or label in (x for x, _ in out):
            raise ValueError(f"bad prompt: {p!r}")
        out.append((label, cap))
    if not out:
        raise ValueError("no prompts")
    return out


def excluded_labels(labels: list[str]) -> list[str]:
    """B-25."""
    return sorted({s for x in labels if (s := x.strip())})


def slot_layout(spark: SparkSession, prompts: list[tuple[str, int]]) -> DataFrame:
    """B-26: slot_index, track_id, label, class_slot; labels in the order given."""
    classes = spark.createDataFrame([(i, *p) for i, p in enumerate(prompts)], "pos int, label string, capacity int")
    rows = classes.select("pos", "label", F.explode(F.sequence(F.lit(0), F.col("capacity") - 1)).alias("class_slot"))
    index = F.row_number().over(Window.orderBy("pos", "class_slot")) - 1  # a few rows: one for each slot
    return rows.select(index.alias("slot_index"), (index + 1).alias("track_id"), "label", "class_slot")


def capacity_bounds(classes: DataFrame, views: int) -> DataFrame:
    """B-27: most instances and most candidate pairs of `views` views."""
    if views <= 0:
        raise ValueError("views must be positive")
    return classes.agg((F.lit(views) * F.sum("capacity")).cast("bigint").alias("max_instances"), F.sum(F.col("capacity") * views * F.col("capacity") * views).cast("bigint").alias("max_pairs"))


def capacity_pairs(views: int, capacities: list[int]) -> int:
    return sum((views * k) ** 2 for k in capacities)


def filter_detections(detections: DataFrame, least_score: float, model_score: float, least_pixels: int) -> DataFrame:
    """C-4: score at the higher of two levels (the model's pre-filter is strict), and enough mask pixels."""
    return detections.where((F.col("score") > model_score) & (F.col("score") >= max(least_score, model_score)) & (F.col("pixels") >= least_pixels))


def rank_in_class(detections: DataFrame, frame: list[str], order: list[str]) -> DataFrame:
    """F-1, G-1: 0, 1, ... by score in each class; ties in input order."""
    w = Window.partitionBy(*frame, "label").orderBy(F.col("score").desc(), *order)
    return detections.withColumn("rank", F.row_number().over(w) - 1)


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    """G-6."""
    return ranked.where(F.col("rank") < k)


def nms(ranked: DataFrame, frame: list[str], features: list[str], overlap: Callable[[tuple, tuple], float], level: float, capacity: int) -> DataFrame:
    """F-2: greedy suppression in each class, at most `capacity` kept: (frame, label, rank).

    A class's detections come in the order of their ranks; each is compared with those kept so far, of which there are at
    most `capacity`, so the work is linear in the detections and no pairs are stored.  overlap gets the features of two (packed masks and
    `masks.packed_iou`, for example)."""
    keys = [*frame, "label"]

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        kept: list[tuple] = []

        def step(p: pd.DataFrame) -> pd.DataFrame:
            at = []
            if len(kept) < capacity:
                for i, x in enumerate(zip(*(p[f] for f in features))):
                    if all(overlap(x, k) < level for k in kept):
                        kept.append(x)
                        at.append(i)
                        if len(kept) == capacity:
                            break
            return p.iloc[at][[*keys, "rank"]]

        return step

    rows = ranked.select(*keys, F.col("rank").cast("long").alias("rank"), *features)
    return in_order(rows, keys, ["rank"], start, rows.select(*keys, "rank").schema)


def class_counts(detections: DataFrame, classes: DataFrame, frames: DataFrame, frame: list[str]) -> DataFrame:
    """E-12: kept detections of each class and frame; classes without any have 0."""
    n = detections.groupBy(*frame, "label").agg(F.count("*").alias("n"))
    return frames.crossJoin(F.broadcast(classes.select("label"))).join(n, [*frame, "label"], "left").select(*frame, "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def seed(ranked: DataFrame, slots: DataFrame, frames: DataFrame, frame: list[str]) -> DataFrame:
    """D-20: every slot of every frame, with the detection of its class and rank if there is one.  The slots are a
    short fixed list, so pairing them with frames is no join of two large sides."""
    grid = frames.crossJoin(F.broadcast(slots))
    d = ranked.withColumnRenamed("rank", "class_slot")
    return grid.join(d, [*frame, "label", "class_slot"], "left")


def greedy_match(edges: DataFrame, keys: list[str], level: float) -> DataFrame:
    """C-14, D-15: edges (keys, iou, det, track) at `level` or over, matched greedily inside each key group."""
    lists = edges.where(F.col("iou") >= level).groupBy(*keys).agg(F.collect_list(F.struct("iou", "det", "track")).alias("edges"))

    @F.pandas_udf("array<struct<det:bigint,track:bigint>>")
    def match(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"det": a, "track": b} for a, b in assign.greedy([(e["iou"], e["det"], e["track"]) for e in edges])] for edges in lists])

    return lists.select(*keys, F.inline(match("edges")))


def fill_free_slots(detections: DataFrame, slots: DataFrame, matched: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """D-16, G-4, H-2: unmatched detections by score take free slots by class_slot; surplus detections are dropped.

    detections (keys, det, score), slots (keys, track, class_slot, free), matched (keys, det, track)."""
    d = detections.join(matched.select(*keys, "det"), [*keys, "det"], "left_anti")
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    s = slots.where("free").join(matched.select(*keys, "track"), [*keys, "track"], "left_anti")
    s = s.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("class_slot", "track")))
    return d.join(s, [*keys, "__k"]).select(*keys, "det", "track")


def status_counts(slots: DataFrame, frame: list[str]) -> DataFrame:
    """E-12: active and inactive slots."""
    return slots.groupBy(*frame).agg(F.count_if(F.col("active")).alias("n_active"), F.count_if(~F.col("active")).alias("n_dummy"))


def composite_cost(dist: Column, overlap: Column, embedding: Column, same_label: Column, max_dist: float, least_iou: float, weights: tuple[float, float, float], label_penalty: float) -> Column:
    """D-18: weighted cost of a pair; null where the pair is skipped (too far and too little overlap, or no centroid and too little)."""
    cost = weights[0] * F.coalesce(dist, F.lit(0.0)) + weights[1] * (1 - overlap) + weights[2] * embedding + F.when(same_label, 0.0).otherwise(label_penalty)
    skip = (overlap < least_iou) & (dist.isNull() | (dist > max_dist))
    return F.when(~skip, cost)


def optimal_match(costs: DataFrame, keys: list[str], limit: float = math.inf) -> DataFrame:
    """D-14, C-13: costs (keys, a, b, cost) -> pairs (keys, a, b, cost) of an optimal assignment in each key group.

    A group is the candidate list of one class in one frame: it is bounded by the slots (B-27)."""
    schema = T.StructType([costs.schema[k] for k in keys] + [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("cost", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.sort(pdf["a"].unique()), np.sort(pdf["b"].unique())
        m = np.full((len(rows), len(cols)), assign.INVALID)
        ok = pdf[pdf["cost"] < limit]
        m[np.searchsorted(rows, ok["a"]), np.searchsorted(cols, ok["b"])] = ok["cost"]
        got = assign.optimal(m)
        out = pd.DataFrame({"a": [int(rows[i]) for i, _ in got], "b": [int(cols[j]) for _, j in got], "cost": [float(m[i, j]) for i, j in got]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return costs.where(F.col("cost").isNotNull()).groupBy(*keys).applyInPandas(run, schema)


def associate(pairs: DataFrame, frame: list[str], max_dist: float, least_iou: float, weights: tuple[float, float, float], label_penalty: float) -> DataFrame:
    """D-18 as a whole: (frame, det, track) of a least-cost assignment.  pairs (frame, det, track, dist (null without both
    centroids), iou, embedding_distance, same_label) has every detection of a frame with every track, both bounded by the slots."""
    cost = composite_cost(F.col("dist"), F.col("iou"), F.col("embedding_distance"), F.col("same_label"), max_dist, least_iou, weights, label_penalty)
    costs = pairs.select(*frame, F.col("track").alias("a"), F.col("det").alias("b"), cost.alias("cost"))
    return optimal_match(costs, frame, 1e5).select(*frame, F.col("b").alias("det"), F.col("a").alias("track"), "cost")


def on_active_slots(rows: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """C-11: rows whose slot (keys) is known and active."""
    return rows.join(slots.where("active").select(*keys), keys, "left_semi")


def fallback_masks(slots: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """J-13: every active slot with the number of its stored mask pixels; a slot without a mask has 0 (an empty fallback)."""
    n = mask.groupBy(*keys).agg(F.count("*").alias("pixels"))
    return slots.where("active").select(*keys).join(n, keys, "left").select(*keys, F.coalesce("pixels", F.lit(0)).cast("bigint").alias("pixels"))
