"""Identities from frame to frame: centroid gate, Chamfer distance, assignment and id inheritance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import assign, nearest
from .ordered import in_order, previous


def frames_before(frames: DataFrame, rig: list[str], frame: str = "frame", width: float = 100_000) -> DataFrame:
    """(rig, frame, before): each processed frame with the processed one before it, whatever its number."""
    return previous(frames.select(*rig, frame).distinct(), rig, [frame], frame, width, "before")


def candidates(groups: DataFrame, rig: list[str], frame: str = "frame", gate: float = 0.20, frames: DataFrame | None = None) -> DataFrame:
    """D-12, C-5, C-6: pairs (a in the processed frame before, b) of one label with centroids within the gate; null centroids never pass.

    frames lists the processed frames, also empty ones (after which nothing is remembered); without it those that have groups."""
    steps = frames_before(groups if frames is None else frames, rig, frame)
    a = groups.select(*rig, F.col(frame).alias("before"), "label", F.col("group_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("cx", "cy", "cz")])
    b = groups.select(*rig, frame, "label", F.col("group_id").alias("b"), "cx", "cy", "cz").join(steps, [*rig, frame])
    d = F.sqrt(sum(((F.col(c) - F.col(f"a_{c}")) * (F.col(c) - F.col(f"a_{c}")) for c in ("cx", "cy", "cz")), F.lit(0.0)))
    return a.join(b, [*rig, "before", "label"]).withColumn("distance", d).where("distance <= %r and not isnan(distance)" % gate).select(*rig, frame, "before", "label", "a", "b", "distance")


def chamfer(pairs: DataFrame, points: DataFrame, rig: list[str], frame: str = "frame") -> DataFrame:
    """D-13: the mean of both directions' mean nearest distances, for pairs (rig, frame, before, a, b) of a group a of frame `before` and b of
    `frame`; infinite if a side is empty.

    Each point set (those of one instance in one frame, so no more than the frame's pixels) is packed once, as one row; the two of a pair meet
    in one function, which builds a k-d tree of each and searches both ways (`nearest`), in n log n."""
    packed = points.groupBy(*rig, frame, "group_id").agg(F.collect_list(F.array("x", "y", "z")).alias("__p"))
    side = lambda at, who, n: packed.select(*rig, F.col(frame).alias(at), F.col("group_id").alias(who), F.col("__p").alias(n))
    both = pairs.join(side("before", "a", "__pa"), [*rig, "before", "a"], "left").join(side(frame, "b", "__pb"), [*rig, frame, "b"], "left")
    rows = both.select(*rig, frame, "before", "a", "b", "__pa", "__pb")
    schema = T.StructType([*rows.schema[:-2], T.StructField("chamfer", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [nearest.chamfer(_xyz(x), _xyz(y)) for x, y in zip(batch.column("__pa"), batch.column("__pb"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(got, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def _xyz(cell: pa.ListScalar) -> np.ndarray | None:
    """The numbers of a list of points, without a Python object for each."""
    return cell.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3) if cell.is_valid else None


def cap_chamfer(pairs: DataFrame, most: float | None) -> DataFrame:
    """C-9: finite, and at most the cap if there is one."""
    out = pairs.where(F.col("chamfer").isNotNull() & (F.col("chamfer") < F.lit(float("inf"))) & ~F.isnan("chamfer"))
    return out if most is None else out.where(F.col("chamfer") <= most)


class Memory:
    """J-4, F-9: the groups of the last processed frame with their ids.  A matched group inherits the id, others get new ones;
    a frame without groups clears the memory."""

    def __init__(self, before: dict[int, tuple[int, str]] | None = None, fresh: int = 1):
        self.before, self.fresh = before or {}, fresh

    def frame(self, groups: list[tuple[int, str]], cost: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
        """(group, id) of a frame's groups (number, label); cost[a, b] of accepted candidates."""
        now: dict[int, int] = {}
        for label in sorted({label for _, label in groups}):
            rows = sorted(g for g in self.before if self.before[g][1] == label)
            cols = sorted(g for g, x in groups if x == label)
            m = np.full((len(rows), len(cols)), assign.INVALID)
            for i, a in enumerate(rows):
                for j, b in enumerate(cols):
                    m[i, j] = cost.get((a, b), assign.INVALID)
            for i, j in assign.optimal(m):
                now[cols[j]] = self.before[rows[i]][0]
        for g, _ in sorted(groups):
            if g not in now:
                now[g], self.fresh = self.fresh, self.fresh + 1
        self.before = {g: (now[g], label) for g, label in groups}
        return [(g, now[g]) for g, _ in sorted(groups)]


def inherit_ids(frames: list[int], groups: dict[int, list[tuple[int, str]]], cost: dict[int, dict[tuple[int, int], float]]) -> list[tuple[int, int, int]]:
    """J-4, F-9: (frame, group, id) of all processed frames, in order."""
    memory = Memory()
    return [(f, g, i) for f in frames for g, i in memory.frame(groups.get(f, []), cost.get(f, {}))]


def global_ids(frames: DataFrame, groups: DataFrame, costs: DataFrame, rig: list[str]) -> DataFrame:
    """J-4 in batch: (rig, frame, group_id, global_id).  frames lists every processed frame, also empty ones; groups (rig, frame, group_id,
    label); costs (rig, frame, a, b, cost) of accepted candidates.

    A frame is one row with its groups and costs, both bounded by the slots; a rig's frames come in order, and one frame is remembered."""
    keys = [*rig, "frame"]
    per = lambda df, cols, name: df.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias(name))
    rows = frames.select(*keys).distinct().join(per(groups, ["group_id", "label"], "groups"), keys, "left").join(per(costs, ["a", "b", "cost"], "costs"), keys, "left")

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        memory = Memory()

        def step(p: pd.DataFrame) -> pd.DataFrame:
            out = []
            for f, g, c in zip(p["frame"], p["groups"], p["costs"]):
                known = [(x["group_id"], x["label"]) for x in (g if g is not None else [])]
                out += [(f, n, i) for n, i in memory.frame(known, {(x["a"], x["b"]): x["cost"] for x in (c if c is not None else [])})]
            got = pd.DataFrame(out, columns=["frame", "group_id", "global_id"]).astype("int64")
            for k in reversed(rig):
                got.insert(0, k, p[k].iloc[0])
            return got

        return step

    schema = T.StructType([*(frames.schema[k] for k in rig), *(T.StructField(c, T.LongType()) for c in ("frame", "group_id", "global_id"))])
    return in_order(rows, rig, ["frame"], start, schema)
