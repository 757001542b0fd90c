"""Column functions: colours, scores, stamps, embeddings and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six palette colours of instance ids, as (r, g, b).
PALETTE = [(230, 80, 80), (80, 210, 120), (80, 150, 240), (235, 190, 70), (180, 90, 225), (70, 210, 215)]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp01(x: Column) -> Column:
    """B-15: confidence limited to [0, 1]."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def presence_score(max_logit: Column, positive: Column, area: Column) -> Column:
    """B-8: sigmoid(clip(max, +-20)) * clip(20 * share of positive pixels, 0, 1); the share is of the whole frame."""
    return sigmoid(F.least(F.greatest(max_logit, F.lit(-20.0)), F.lit(20.0))) * clamp01(F.lit(20.0) * positive / area)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """B-9: 1 - cosine clipped to [-1, 1]; 0 for null, empty, unequal sizes or a zero norm."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    length = norm(a) * norm(b)
    return F.when(usable & (length > 0), F.lit(1.0) - F.greatest(F.least(dot(a, b) / length, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))


def blend_embedding(old: Column, new: Column, alpha: float = 0.25) -> Column:
    """B-10: (1 - alpha) * old + alpha * new, normalised; the other one if either is null or sizes differ."""
    mixed = F.zip_with(old, new, lambda x, y: x.cast("double") * (1 - alpha) + y.cast("double") * alpha)
    scaled = F.transform(mixed, lambda v: v / F.greatest(norm(mixed), F.lit(1e-12)))
    return F.when(new.isNull(), old.cast("array<double>")).when(old.isNull() | (F.size(old) != F.size(new)), new.cast("array<double>")).otherwise(scaled)


def colour_bin(r: Column, g: Column, b: Column, bins: int) -> Column:
    """B-11: the joint histogram cell of a colour."""
    n = max(2, bins)
    cell = lambda c: F.least(F.floor(c * n / 256), F.lit(n - 1))
    return (cell(r) * n + cell(g)) * n + cell(b)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """B-12."""
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def palette_index(global_id: Column, track_id: Column) -> Column:
    """B-13: (id - 1) mod 6 of the global id, else of the track id."""
    return F.pmod(F.coalesce(global_id, track_id) - 1, F.lit(len(PALETTE)))


def palette_rgb(index: Column) -> Column:
    packed = F.array(*[F.lit(r << 16 | g << 8 | b) for r, g, b in PALETTE])
    return F.element_at(packed, (index + 1).cast("int"))


def label_text(label: Column, slot: Column, global_id: Column, group: Column) -> Column:
    """B-14: "label [slot s] Gx My"; parts that are null are left out."""
    return F.concat_ws(" ", label, F.concat(F.lit("[slot "), slot.cast("string"), F.lit("]")), F.concat(F.lit("G"), global_id.cast("string")), F.concat(F.lit("M"), group.cast("string")))


def stamp_ns(sec: Column, nanosec: Column) -> Column:
    """B-17."""
    return sec.cast("bigint") * F.lit(1_000_000_000).cast("bigint") + nanosec.cast("bigint")


def rate(n: Column, first: Column, last: Column, scale: float) -> Column:
    """B-18: (n - 1) * scale / (last - first); null for fewer than two, or no time between them."""
    return F.when((n >= 2) & (last > first), (n - 1) * F.lit(scale) / (last - first))


def box_corners(cx: Column, cy: Column, w: Column, h: Column, width: float, height: float) -> list[Column]:
    """B-21: centre and size in [0, 1] to corners in pixels: x0, y0, x1, y1."""
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]


def detector_score(logit: Column, presence: Column) -> Column:
    """B-22."""
    return sigmoid(logit) * sigmoid(presence)


def refresh_frames(seconds: Column, hz: Column) -> Column:
    """B-28: frames between refreshes, halves to even, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround(seconds * hz, 0).cast("bigint"))


def status(bbox: Column) -> Column:
    """B-29."""
    return F.when(bbox.isNotNull(), F.lit("visible")).otherwise(F.lit("lost"))


def decode_depth(encoding: Column, raw: Column) -> Column:
    """A-2: millimetres of 16UC1 to metres, others as they are."""
    return F.when(encoding == "16UC1", raw.cast("double") * 0.001).otherwise(raw.cast("double"))


def reduction_percent(before: Column, after: Column) -> Column:
    """E-19."""
    return (F.lit(1.0) - after / F.greatest(F.lit(1), before)) * 100


def iou(inter: Column, n_a: Column, n_b: Column) -> Column:
    """D-7's last step: 0 where the union is empty."""
    union = n_a + n_b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def merge_maps(first: Column, second: Column) -> Column:
    """One map of both; where they share a key, the second one's value stays.  If one is null, the other."""
    left = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(left, second))
