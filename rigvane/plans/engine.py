"""The whole geometry path as one plan: masks and depth in, fused instances with lasting ids out.

Every step is a DataFrame operator, so Catalyst sees one plan for all frames; only assignment, grouping
and id inheritance are small grouped functions.  Tables (names of columns):

  logits (rig, frame, view_id, label, track_id, y, x, logit)     depth (rig, frame, view_id, y, x, z)
  views (rig, view_id, fx, fy, cx, cy, r00 .. r22, tx, ty, tz, width, height)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crossframe, crossview, geometry, masks, voxel
from ..sources.frames import config
from .store import cut

FRAME = ["rig", "frame"]


class Engine:
    """Settings and the steps; each step takes and gives DataFrames."""

    def __init__(self, settings: dict | None = None, excluded: list[str] | None = None):
        self.set, self.excluded = config(settings), excluded or []

    def clean_masks(self, logits: DataFrame, width: int, height: int) -> DataFrame:
        """C-1, C-10, F-3, C-12: thresholded, eroded masks without small parts; excluded labels do not go on."""
        keys = [*FRAME, "view_id", "label", "track_id"]
        m = masks.threshold(logits.where(~F.col("label").isin(self.excluded)), self.set["mask_threshold"])
        return masks.drop_small(masks.erode(m, keys, self.set["erosion"], width, height), keys, self.set["min_component"])

    def voxels(self, mask: DataFrame, depth: DataFrame, views: DataFrame, stride: int = 1) -> DataFrame:
        """D-5, D-6, C-2, C-3, B-1, B-3, B-5, B-6, E-1: one world point for each instance and voxel, the first in raster order.

        The lattice and depth filters come before the join; the views are one row for each camera."""
        on = mask.where(geometry.on_lattice(F.col("x"), F.col("y"), F.lit(stride)))
        z = depth.where(geometry.valid_depth(F.col("z"), self.set["min_depth"], self.set["max_depth"]))
        rows = geometry.with_views(on.join(z, [*FRAME, "view_id", "y", "x"]), views, ["rig", "view_id"])
        c = F.col
        p = geometry.back_project(c("x"), c("y"), c("z"), c("fx"), c("fy"), c("cx"), c("cy"))
        w = geometry.rigid(p, [[c(f"r{i}{j}") for j in range(3)] for i in range(3)], [c("tx"), c("ty"), c("tz")])
        rows = rows.select(*FRAME, "view_id", "label", "track_id", "y", "x", *w)
        rows = rows.select("*", *[geometry.quantize(c(f"w{a}"), 0.0, self.set["voxel"]).alias(f"v{a}") for a in "xyz"])
        rows = rows.withColumn("key", geometry.pack_key(c("vx"), c("vy"), c("vz")))
        keep = ["wx", "wy", "wz", "vx", "vy", "vz"]
        first = voxel.first_wins(rows, [*FRAME, "view_id", "label", "track_id", "key"], ["y", "x"], keep)
        return first.withColumn("obs", c("view_id") * 1_000_000 + c("track_id"))

    def fuse(self, voxels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """D-8 .. D-17, E-2, E-16, E-20: (groups, fused points)."""
        boxes = voxel.bbox(voxels, [*FRAME, "label", "view_id", "obs"])
        pairs = crossview.candidates(boxes, FRAME, self.set["radius"])
        scores = voxel.coverage(voxels.select(*FRAME, "obs", "key"), pairs.select(*FRAME, "a", "b"), FRAME, "a", "b", self.set["radius"]).join(pairs, [*FRAME, "a", "b"])
        matched = crossview.match_views(crossview.accepted(scores, self.set["min_score"], self.set["min_both"]), FRAME)
        groups = crossview.groups(boxes.select(*FRAME, "obs", "view_id"), matched, FRAME)
        labels = boxes.select(*FRAME, "obs", "label")
        return groups.join(labels, [*FRAME, "obs"]), crossview.fuse(voxels, groups, FRAME, ["wx", "wy", "wz", "vx", "vy", "vz"])

    def identities(self, frames: DataFrame, groups: DataFrame, fused: DataFrame) -> DataFrame:
        """D-12, D-13, C-9, D-14, J-4: (rig, frame, group_id, global_id)."""
        inst = crossview.fused_instances(fused, FRAME).join(groups.groupBy(*FRAME, "group_id").agg(F.min("label").alias("label")), [*FRAME, "group_id"])
        near = crossframe.candidates(inst, ["rig"], gate=self.set["gate"], frames=frames)
        pts = fused.select(*FRAME, "group_id", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
        cost = crossframe.cap_chamfer(crossframe.chamfer(near, pts, ["rig"]), self.set.get("max_chamfer"))
        return crossframe.global_ids(frames, inst.select(*FRAME, "group_id", "label"), cost.withColumnRenamed("chamfer", "cost"), ["rig"])

    def run(self, logits: DataFrame, depth: DataFrame, views: DataFrame, width: int, height: int, stride: int = 1) -> DataFrame:
        """A-17: fused instances of every frame, with their lasting ids.  Voxels, groups and fused points are written once and read by all later steps."""
        v = cut(self.voxels(self.clean_masks(logits, width, height), depth, views, stride))
        groups, fused = (cut(x) for x in self.fuse(v))
        ids = self.identities(logits.select(*FRAME).distinct(), groups, fused)
        return crossview.fused_instances(fused, FRAME).join(ids, [*FRAME, "group_id"])
