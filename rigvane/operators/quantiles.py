"""Exact quantiles of groups of any size, without a buffer that grows with a group.

Each wanted rank is narrowed down in steps of the same kind: a histogram of a group's values (summed before it is dealt out, so little is shuffled), running
sums over its bins, and the bin that holds the rank.  The rows are read once for each step, and only those in bins that hold a rank go on.  The first bins are equal steps of the logarithm (a fixed number for all doubles), the next LINEAR equal steps between a bin's
least and greatest value; what is left in one such part of a bin is ordered by value.  Bins only guide the search: whatever the
distribution, the value is the one at the rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins to a unit of the natural logarithm of 1 + |value|, and parts of each of these bins.
LOG_STEPS, LINEAR = 256, 4096


def _log_bin(v: Column) -> Column:
    """A whole number that never falls as v grows; infinities and NaN (the greatest) have bins of their own."""
    steps = F.floor(F.signum(v) * F.log1p(F.abs(v)) * LOG_STEPS)
    return F.when(F.isnan(v), F.lit(1 << 21)).when(F.abs(v) == float("inf"), F.signum(v) * (1 << 20)).otherwise(steps).cast("long")


def _part(v: Column, low: Column, high: Column) -> Column:
    """Which of LINEAR equal parts of [low, high] v lies in."""
    return F.when(low < high, F.least(F.floor((v - low) / (high - low) * LINEAR), F.lit(LINEAR - 1))).otherwise(0).cast("long")


def _histogram(values: DataFrame, at: list[str], bin_: str) -> DataFrame:
    """How many values (g, which, *at, v) each bin holds, and its least and greatest value."""
    return values.groupBy("g", "which", *at, bin_).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def _held(hist: DataFrame, wanted: DataFrame, at: list[str], bin_: str) -> DataFrame:
    """Wanted ranks (g, which, name, place, rank, *at) with the bin that holds each, the rank inside it, and the bin's ends."""
    upto = F.sum("n").over(Window.partitionBy("g", "which", *at).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0))
    hist = hist.withColumn("after", upto).withColumn("before", F.col("after") - F.col("n"))
    keep = ["g", "which", *at, bin_, "low", "high", "before", "after"]
    met = wanted.drop("low", "high").join(hist.select(*keep), ["g", "which", *at]).where("rank >= before and rank < after")
    return met.withColumn("rank", F.col("rank") - F.col("before")).drop("before", "after")


def quantiles(rows: DataFrame, keys: list[str], wanted: list[tuple[str, Column | str, float]]) -> DataFrame:
    """(keys, *names): for each (name, value, q) the linear quantile of each group's values that are not null (NaN is the greatest).  Groups
    without any value are left out; null keys are a group."""
    values: list[str] = []
    for _, v, _ in wanted:
        if str(v) not in values:
            values.append(str(v))
    column = {str(v): F.col(v) if isinstance(v, str) else v for _, v, _ in wanted}
    listed = F.array(*[F.struct(F.lit(i).alias("which"), column[v].cast("double").alias("v")) for i, v in enumerate(values)])
    flat = rows.select(F.struct(*keys).alias("g"), F.inline(listed)).where("v is not null")
    flat = flat.withColumn("bin", _log_bin(F.col("v")))
    asked = F.array(*[F.struct(F.lit(values.index(str(v))).alias("which"), F.lit(float(q)).alias("q"), F.lit(name).alias("name")) for name, v, q in wanted])
    hist = _histogram(flat, [], "bin")
    # Places of the wanted quantiles among a group's values, and the whole ranks on both sides of each.
    sizes = hist.groupBy("g", "which").agg(F.sum("n").alias("size")).withColumn("a", F.explode(F.filter(asked, lambda a: a["which"] == F.col("which"))))
    places = sizes.select("g", "which", F.col("a.name").alias("name"), (F.col("a.q") * (F.col("size") - 1)).alias("place"))
    ends = places.select("g", "which", "name", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    first = _held(hist, ends, [], "bin")
    edges = first.select("g", "which", "bin", "low", "high").distinct()
    inside = flat.join(edges, ["g", "which", "bin"]).withColumn("part", _part(F.col("v"), F.col("low"), F.col("high"))).select("g", "which", "bin", "part", "v")
    second = _held(_histogram(inside, ["bin"], "part"), first, ["bin"], "part")
    rest = inside.join(second.select("g", "which", "bin", "part").distinct(), ["g", "which", "bin", "part"]).withColumn("value", F.col("v"))
    last = _held(_histogram(rest, ["bin", "part"], "value"), second, ["bin", "part"], "value")
    # The value at a place between two ranks is their mean, weighed by nearness.
    low, high = F.min_by("value", "whole"), F.max_by("value", "whole")
    share = F.first("place") - F.floor(F.first("place"))
    named = last.withColumn("whole", F.col("value")).groupBy("g", "name").agg(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias("value"))
    out = named.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name, _, _ in wanted])
    return out.select(*[F.col("g")[k].alias(k) for k in keys], *[name for name, _, _ in wanted])


def with_quantiles(groups: DataFrame, rows: DataFrame, keys: list[str], wanted: list[tuple[str, Column | str, float]], digits: int | None = None) -> DataFrame:
    """Groups (one row for each of keys) with the quantiles of their rows, rounded to `digits` if given; null where a group has no value."""
    found = quantiles(rows, keys, wanted)
    names = [name for name, _, _ in wanted]
    right = found.select(F.struct(*keys).alias("__g"), *[(F.col(n) if digits is None else F.round(n, digits)).alias(n) for n in names])
    return groups.join(right, F.struct(*[groups[k] for k in keys]) == F.col("__g"), "left").drop("__g")
