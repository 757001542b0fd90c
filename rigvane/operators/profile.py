"""Stage timings: sums, warm-up, summaries and the CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import with_quantiles


def stage_sums(timings: DataFrame) -> DataFrame:
    """E-17: repeated records of a stage in a frame add up."""
    return timings.groupBy("frame", "stage").agg(F.sum("value_ms").alias("value_ms"))


def after_warmup(sums: DataFrame, warmup: int) -> DataFrame:
    """F-11, J-11: without the first `warmup` completed frames; frame numbers stay.  A stage first seen later loses nothing.

    Only these few frame numbers are sorted; the last of them is one row beside all others."""
    last = sums.select("frame").distinct().orderBy("frame").limit(warmup).agg(F.max("frame").alias("__last"))
    return sums.join(F.broadcast(last), F.col("__last").isNull() | (F.col("frame") > F.col("__last"))).drop("__last")


def summary(sums: DataFrame, digits: int = 6) -> DataFrame:
    """E-14, G-7: count, mean, median, p95, maximum and the first frame with it."""
    v = "value_ms"
    plain = sums.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.max(v), digits).alias("max"), F.max_by("frame", F.struct(F.col(v), -F.col("frame"))).alias("max_frame"))
    return with_quantiles(plain, sums, ["stage"], [("median", v, 0.5), ("p95", v, 0.95)], digits).select("stage", "n", "mean", "median", "p95", "max", "max_frame")


def wide(sums: DataFrame, preferred: list[str], extras: list[str]) -> DataFrame:
    """A-10's rows: a column for each stage, preferred ones first, other known ones sorted; unknown stages are left out."""
    order = [*preferred, *sorted(set(extras) - set(preferred))]
    return sums.where(F.col("stage").isin(order)).groupBy("frame").pivot("stage", order).agg(F.first("value_ms"))


def report(name: str, summary_: DataFrame, preferred: list[str], frames: int, excluded: int) -> str:
    """A-16: the cumulative table as text, preferred stages first, others sorted.  The rows are one for each stage."""
    rows = {r["stage"]: r for r in summary_.collect()}
    order = [s for s in preferred if s in rows] + sorted(set(rows) - set(preferred))
    head = f"{'stage':<36}{'n':>8}{'mean':>10}{'median':>10}{'p95':>10}{'max':>10}{'worst':>9}"
    body = [f"{s:<36}{rows[s]['n']:>8}" + "".join(f"{rows[s][k]:>10.2f}" for k in ("mean", "median", "p95", "max")) + f"{rows[s]['max_frame']:>9}" for s in order]
    return "\n".join([f"{name}: {frames} frames, {excluded} of warm-up left out", head, *body])
