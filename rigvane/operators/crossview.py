"""One object in several cameras: candidates, thresholds, matching, groups and fused instances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import assign, detect, voxel


def bbox_compatible(a: str, b: str, radius: int, axes: tuple[str, ...] = ("vx", "vy", "vz")) -> Column:
    """C-7: boxes that touch when grown by radius, on every axis."""
    out = F.lit(True)
    for x in axes:
        out = out & (F.col(f"{a}max_{x}") + radius >= F.col(f"{b}min_{x}")) & (F.col(f"{b}max_{x}") + radius >= F.col(f"{a}min_{x}"))
    return out


def candidates(observations: DataFrame, frame: list[str], radius: int) -> DataFrame:
    """D-8, C-5, H-1: pairs of observations of a frame and label in views a < b whose boxes are compatible."""
    cols = ["obs", "view_id", *[f"{m}_{v}" for v in ("vx", "vy", "vz") for m in ("min", "max")]]
    a = observations.select(*frame, "label", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = observations.select(*frame, "label", *[F.col(c).alias(f"b_{c}") for c in cols])
    near = (F.col("a_view_id") < F.col("b_view_id")) & bbox_compatible("a_", "b_", radius)
    return a.join(b, [*frame, "label"]).where(near).select(*frame, "label", F.col("a_view_id").alias("view_a"), F.col("b_view_id").alias("view_b"), F.col("a_obs").alias("a"), F.col("b_obs").alias("b"))


def accepted(scores: DataFrame, least_score: float = 0.15, least_both: float = 0.20) -> DataFrame:
    """C-8."""
    return scores.where((F.col("score") >= least_score) & (F.least("a_to_b", "b_to_a") >= least_both))


def match_views(scores: DataFrame, frame: list[str]) -> DataFrame:
    """D-14: for each pair of views and label the assignment with the highest total score (cost 1 - score)."""
    costs = scores.withColumn("cost", 1.0 - F.col("score"))
    return detect.optimal_match(costs, [*frame, "label", "view_a", "view_b"]).withColumn("score", 1.0 - F.col("cost"))


def groups(observations: DataFrame, edges: DataFrame, frame: list[str]) -> DataFrame:
    """E-16, E-20, D-17, G-2: a group number for every observation (obs, view_id) of a frame; edges (a, b, score) join observations
    of different views.  A frame's observations are bounded by the slots."""
    links = edges.groupBy(*frame).agg(F.collect_list(F.struct("score", "a", "b")).alias("edges"))
    lists = observations.groupBy(*frame).agg(F.sort_array(F.collect_list(F.struct("obs", "view_id"))).alias("observations")).join(links, frame, "left")

    @F.pandas_udf("array<struct<obs:bigint,group_id:bigint>>")
    def number(observations: pd.Series, edges: pd.Series) -> pd.Series:
        out = []
        for o, e in zip(observations, edges):
            index = {x["obs"]: i for i, x in enumerate(o)}
            ids = assign.constrained_groups([x["view_id"] for x in o], [(x["score"], index[x["a"]], index[x["b"]]) for x in (e if e is not None else [])])
            out.append([{"obs": x["obs"], "group_id": g} for x, g in zip(o, ids)])
        return pd.Series(out)

    return lists.select(*frame, F.inline(number("observations", "edges")))


def number_groups(roots: DataFrame, frame: list[str]) -> DataFrame:
    """E-20 alone: (frame, obs, root) -> group_id by each group's first observation."""
    first = roots.withColumn("__f", F.min("obs").over(Window.partitionBy(*frame, "root")))
    return first.withColumn("group_id", F.dense_rank().over(Window.partitionBy(*frame).orderBy("__f"))).drop("__f")


def fuse(voxels: DataFrame, grouped: DataFrame, frame: list[str], keep: list[str]) -> DataFrame:
    """E-2, H-3: the voxels of each group, of equal keys the first observation's."""
    return voxel.union_first_wins(voxels.join(grouped, [*frame, "obs"]), [*frame, "group_id"], "obs", "key", keep)


def fused_instances(fused: DataFrame, frame: list[str], digits: int = 6) -> DataFrame:
    """A-17, E-4, E-6: centroid, box and number of points of each group."""
    return fused.groupBy(*frame, "group_id").agg(*[F.round(F.median(p), digits).alias(f"c{p[-1]}") for p in ("wx", "wy", "wz")], *[f(v).alias(f"{n}_{v}") for v in ("vx", "vy", "vz") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n_points"))


def counters(candidates_: DataFrame, matches: DataFrame, before: DataFrame, after: DataFrame, frame: list[str]) -> DataFrame:
    """E-13: candidate pairs, matches, points before and after, by frame."""
    part = lambda df, name: df.groupBy(*frame).agg(F.count("*").alias(name))
    out = part(before, "points_before")
    for df, name in ((candidates_, "pairs"), (matches, "matches"), (after, "points_after")):
        out = out.join(part(df, name), frame, "left")
    return out.select(*frame, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("pairs", "matches", "points_before", "points_after")])


def assert_arity(views: DataFrame, corrections: DataFrame, frame: list[str]) -> DataFrame:
    """D-21: corrections joined with their frames; an error where they do not cover all its views."""
    need = views.groupBy(*frame).agg(F.countDistinct("view_id").alias("__need"))
    have = corrections.groupBy(*frame).agg(F.countDistinct("view_id").alias("__have"))
    ok = need.join(have, frame)
    return ok.select(*frame, F.when(F.col("__need") == F.col("__have"), F.col("__have")).otherwise(F.raise_error(F.lit("views and corrections differ in number")).cast("bigint")).alias("views"))


