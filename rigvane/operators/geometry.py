"""Pixels to world voxels: back-projection, rigid transforms, quantization, sampling and summaries of point sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_quantiles

KEY_BITS, KEY_BIAS = 21, 1 << 20


def back_project(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """B-1 (and B-2, whose ray tables are common subexpressions here): pinhole model; px, py, pz."""
    return [((x - cx) * z / fx).alias("px"), ((y - cy) * z / fy).alias("py"), z.alias("pz")]


def rigid(p: list[Column], r: list[list[Column]], t: list[Column]) -> list[Column]:
    """B-3: R p + t; null pose gives null points."""
    return [(r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + t[i]).alias(n) for i, n in enumerate(("wx", "wy", "wz"))]


def quaternion_rotation(qx: Column, qy: Column, qz: Column, qw: Column) -> list[list[Column]]:
    """B-4: the rotation matrix of a quaternion, as it is (not normalised)."""
    two = F.lit(2.0)
    return [
        [1 - two * (qy * qy + qz * qz), two * (qx * qy - qz * qw), two * (qx * qz + qy * qw)],
        [two * (qx * qy + qz * qw), 1 - two * (qx * qx + qz * qz), two * (qy * qz - qx * qw)],
        [two * (qx * qz - qy * qw), two * (qy * qz + qx * qw), 1 - two * (qx * qx + qy * qy)],
    ]


def quantize(p: Column, origin: float, size: float) -> Column:
    """B-5: multiplied by the inverse, not divided."""
    return F.floor((p - origin) * (1.0 / size)).cast("bigint")


def pack_key(vx: Column, vy: Column, vz: Column, check: bool = True) -> Column:
    """B-6, B-7: three biased 21-bit coordinates in one number; out of range is an error."""
    b = [v + F.lit(KEY_BIAS).cast("bigint") for v in (vx, vy, vz)]
    key = F.shiftleft(b[0], 2 * KEY_BITS).bitwiseOR(F.shiftleft(b[1], KEY_BITS)).bitwiseOR(b[2])
    if not check:
        return key
    good = b[0].between(0, (1 << KEY_BITS) - 1) & b[1].between(0, (1 << KEY_BITS) - 1) & b[2].between(0, (1 << KEY_BITS) - 1)
    return F.when(good | vx.isNull() | vy.isNull() | vz.isNull(), key).otherwise(F.raise_error(F.lit("voxel coordinate out of range")).cast("bigint"))


def unpack_key(key: Column) -> list[Column]:
    mask = F.lit((1 << KEY_BITS) - 1)
    return [F.shiftright(key, k * KEY_BITS).bitwiseAND(mask) - KEY_BIAS for k in (2, 1, 0)]


def valid_depth(z: Column, low: float = 0.10, high: float = 6.0) -> Column:
    """C-2: finite and within [low, high]."""
    return z.isNotNull() & ~F.isnan(z) & z.between(low, high)


def on_lattice(x: Column, y: Column, stride: Column) -> Column:
    """C-3: the global sampling lattice."""
    return (x % stride == 0) & (y % stride == 0)


def adaptive_stride(base: int, foreground: Column, max_points: int) -> Column:
    """B-16: the base stride, coarser for masks that would give over max_points samples."""
    expected = foreground / float(base * base)
    return F.when(expected > max_points, F.lit(base) * F.ceil(F.sqrt(expected / max_points))).otherwise(F.lit(base)).cast("bigint")


def with_views(records: DataFrame, views: DataFrame, keys: list[str], most: int = 4096) -> DataFrame:
    """D-6: records with the parameters of their view.  views has one row for each camera; it is broadcast if it has `most` rows at most
    (counted no further than that), and joined by shuffle otherwise."""
    small = views.limit(most + 1).count() <= most
    return records.join(F.broadcast(views) if small else views, keys)


def even_cap(rows: DataFrame, keys: list[str], order: list[str], max_points: int) -> DataFrame:
    """F-6: at most max_points rows of a group, evenly spaced in its order; <= 0 keeps all.

    Row i (of n) stays if some k has floor(k * (n - 1) / (max - 1)) = i in double precision: the two
    k next to i * (max - 1) / (n - 1) are tried, so no join is needed."""
    if max_points <= 0:
        return rows
    w = Window.partitionBy(*keys)
    out = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    if max_points == 1:
        keep = F.col("__i") == 0
    else:
        step = (F.col("__n") - 1) / float(max_points - 1)
        k0 = F.floor(F.col("__i") / step)
        hit = [(k0 + d >= 0) & (k0 + d <= max_points - 1) & (F.when(k0 + d == max_points - 1, F.col("__n") - 1).otherwise(F.floor((k0 + d) * step)) == F.col("__i")) for d in (0, 1)]
        keep = (F.col("__n") <= max_points) | hit[0] | hit[1]
    return out.where(keep).drop("__i", "__n")


def median_centroid(rows: DataFrame, keys: list[str], axes: tuple[str, ...] = ("wx", "wy", "wz"), digits: int = 6, groups: DataFrame | None = None) -> DataFrame:
    """E-4: component-wise exact median, beside the columns of `groups` (one row for each of keys) if they are given.  No task holds a group."""
    return with_quantiles(rows.select(*keys).distinct() if groups is None else groups, rows, keys, [(f"c{a[-1]}", a, 0.5) for a in axes], digits)


def robust_bbox(rows: DataFrame, keys: list[str], axes: tuple[str, ...] = ("wx", "wy", "wz"), low: float = 0.01, digits: int = 6) -> DataFrame:
    """E-5: 1 % and 99 % linear quantiles.  No task holds a group."""
    return with_quantiles(rows.select(*keys).distinct(), rows, keys, [(f"{n}{a[-1]}", a, q) for a in axes for n, q in (("lo", low), ("hi", 1 - low))], digits)


def voxel_bbox_metric(vmin: Column, vmax: Column, origin: float, size: float) -> list[Column]:
    """B-19."""
    return [F.lit(origin) + vmin * size, F.lit(origin) + (vmax + 1) * size]
