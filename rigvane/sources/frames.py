"""Sources and sinks: frames, configuration, point clouds, markers and timing files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import decode_depth, label_text, pack_rgb, palette_index, palette_rgb

MODES = ("sequential", "fixed_batch")


def config(values: dict | None = None, mode: str | None = None) -> dict:
    """A-9: settings with defaults; the execution mode is checked."""
    out = {"mask_threshold": 0.0, "erosion": 2, "exclusion_dilation": 3, "min_component": 30, "min_depth": 0.10, "max_depth": 6.0, "voxel": 0.01, "radius": 1, "min_score": 0.15, "min_both": 0.20, "gate": 0.20, "release_after": 30, "slot_iou": 0.05, "history": 32, "warmup": 30, "mode": "fixed_batch"} | (values or {})
    out["mode"] = mode or out["mode"]
    if out["mode"] not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return out


def load_config(path: str, mode: str | None = None) -> dict:
    """A-9: settings from a YAML or JSON file (JSON is YAML too), with defaults; the execution mode may be given apart."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:  # YAML files need PyYAML, JSON files do not
        values = json.loads(text) if text.strip() else {}
    else:
        values = yaml.safe_load(text) or {}
    if not isinstance(values, dict):
        raise ValueError(f"{path}: settings are not a mapping")
    return config(values, mode.strip().lower() if mode else None)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """A-18."""
    p = argparse.ArgumentParser(prog="rigvane", description="Fused instances with lasting ids from mask logits, depth and views; or the rates of message streams.")
    p.add_argument("--config", help="YAML or JSON file with settings")
    p.add_argument("--execution-mode", choices=MODES)
    p.add_argument("--camera-only", action="store_true", help="only the rate report of the message table")
    for table in ("logits", "depth", "views", "messages", "out"):
        p.add_argument(f"--{table}", help=f"Parquet path of table {table}")
    p.add_argument("--width", type=int, default=640)
    p.add_argument("--height", type=int, default=480)
    p.add_argument("--window-seconds", type=float, default=10.0, help="report window of --camera-only")
    return p.parse_args(argv)


#: A-6: tables of a detector outside the engine.
DETECTIONS = "rig string, camera string, frame long, ord long, detection_id long, label string, score double"
CORRECTIONS = "rig string, ref_frame long, arrival_frame long, wall_ms double"


def external_detections(spark: SparkSession, path: str, labels: list[str], stream: bool = False) -> DataFrame:
    """A-6: detections of another detector, as they seed slots and correct them: known labels and finite scores only."""
    rows = messages(spark, path, DETECTIONS, stream)
    return rows.where(F.col("label").isin(labels) & F.col("score").isNotNull() & ~F.isnan("score"))


def external_corrections(spark: SparkSession, path: str, history: int, stream: bool = False) -> DataFrame:
    """A-6: correction payloads, with the reason why one is dropped."""
    from ..operators.streams import admit_corrections

    return admit_corrections(messages(spark, path, CORRECTIONS, stream), history)


def messages(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """A-1, A-2, A-3: a message table or, as files arrive, a stream of it."""
    return (spark.readStream if stream else spark.read).schema(schema).parquet(path)


def depth_metres(pixels: DataFrame, encoding: str = "encoding", raw: str = "raw") -> DataFrame:
    """A-2."""
    return pixels.withColumn("depth_m", decode_depth(F.col(encoding), F.col(raw)))


def make_frames(inputs: DataFrame, views: int, camera: str = "camera", ts: str = "ts_ns") -> DataFrame:
    """A-5: frame_index 0, 1, 2, ... of each camera by time; an error if the number of cameras is not `views`."""
    n = inputs.select(camera).distinct().count()
    if n != views:
        raise ValueError(f"{n} cameras, {views} views")
    return inputs.withColumn("frame_index", F.row_number().over(Window.partitionBy(camera).orderBy(ts)) - 1)


def latest_calibration(pairs: DataFrame, infos: DataFrame, keys: list[str], arrival: str, cols: list[str], width: float) -> DataFrame:
    """A-3, D-2: each pair with the calibration that arrived last before it, whatever the stamps; a pair before the first one is unusable."""
    from ..operators.streams import as_of

    return as_of(pairs, infos.withColumnRenamed(arrival, "__at"), keys, arrival, "__at", cols, how="inner", width=width)


def cloud(points: DataFrame, keys: list[str]) -> DataFrame:
    """A-11: x, y, z (world if the pose is known, else camera) and packed colour."""
    at = lambda w, p: F.coalesce(F.col(w), F.col(p)).cast("float")
    return points.select(*keys, at("wx", "px").alias("x"), at("wy", "py").alias("y"), at("wz", "pz").alias("z"), pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))


def fused_cloud(points: DataFrame, keys: list[str]) -> DataFrame:
    """A-12: coloured by the global id, else the group."""
    return points.select(*keys, *[F.col(w).cast("float").alias(w[-1]) for w in ("wx", "wy", "wz")], palette_rgb(palette_index(F.col("global_id"), F.col("group_id"))).alias("rgb"))


def markers(slots: DataFrame, instances: DataFrame, keys: list[str], lift: float = 0.12) -> DataFrame:
    """A-13: label and box markers of every slot; unused slots say DELETE."""
    rows = slots.join(instances, keys, "left")
    used = F.col("cx").isNotNull()
    size = lambda a: F.greatest(F.col(f"hi{a}") - F.col(f"lo{a}"), F.lit(1e-3)).alias(f"size_{a}")
    return rows.select(
        *keys, F.when(used, "ADD").otherwise("DELETE").alias("action"), F.when(used, label_text(F.col("label"), F.col("class_slot"), F.col("global_id"), F.col("group_id"))).alias("text"), (F.col("cz") + lift).alias("text_z"), *[size(a) for a in "xyz"]
    )


def write_timings(wide: DataFrame, path: str) -> None:
    """A-10: appended to CSV files with a header."""
    wide.write.mode("append").option("header", True).csv(path)
