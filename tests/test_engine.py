"""The whole path on a made scene: two cameras see one square move; it stays one object."""

from __future__ import annotations

from pyspark.sql import functions as F

from rigvane.plans.engine import Engine


def test_one_object_in_two_views_keeps_its_id(spark):
    px = [(("r", f, v, "box", 1, y, x, 1.0), ("r", f, v, y, x, 1.0)) for f in range(3) for v in range(2) for y in range(10, 22) for x in range(10 + f, 22 + f)]
    logits = spark.createDataFrame([a for a, _ in px], "rig string, frame long, view_id long, label string, track_id long, y int, x int, logit double")
    depth = spark.createDataFrame([b for _, b in px], "rig string, frame long, view_id long, y int, x int, z double")
    eye = {f"r{i}{j}": float(i == j) for i in range(3) for j in range(3)}
    rows = [{"rig": "r", "view_id": v, "fx": 100.0, "fy": 100.0, "cx": 16.0, "cy": 16.0, "tx": 0.0, "ty": 0.0, "tz": 0.0, **eye} for v in range(2)]
    names = ["rig", "view_id", "fx", "fy", "cx", "cy", "tx", "ty", "tz", *eye]
    views = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {'string' if n == 'rig' else 'long' if n == 'view_id' else 'double'}" for n in names))
    out = Engine({"voxel": 0.02, "erosion": 1, "min_component": 4}).run(logits, depth, views, 40, 40).orderBy("frame").collect()
    assert [(r["frame"], r["group_id"], r["global_id"]) for r in out] == [(0, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert out[0]["n_points"] > 20 and out[2]["cx"] > out[0]["cx"]


def test_excluded_label_never_reaches_points(spark):
    logits = spark.createDataFrame([("r", 0, 0, "hand", 1, 5, 5, 1.0)], "rig string, frame long, view_id long, label string, track_id long, y int, x int, logit double")
    assert Engine({"erosion": 0, "min_component": 1}, excluded=["hand"]).clean_masks(logits, 10, 10).where(F.lit(True)).count() == 0
