"""2-D masks as pixel tables: a row is a set pixel.  Morphology, boxes, overlap, components and rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import iou, presence_score


def threshold(logits: DataFrame, level: float = 0.0) -> DataFrame:
    """C-1: pixels whose logit is over the level (strictly)."""
    return logits.where(F.col("logit") > level)


def presence(logits: DataFrame, keys: list[str], area: int, digits: int = 6) -> DataFrame:
    """B-8: a presence score for each object; missing pixels count as not positive."""
    positive = F.sum((F.col("logit") > 0).cast("int"))
    return logits.groupBy(*keys).agg(F.round(presence_score(F.max("logit"), positive, F.lit(float(area))), digits).alias("presence"))


def erode(mask: DataFrame, keys: list[str], radius: int, width: int, height: int) -> DataFrame:
    """F-3: pixels whose whole (2 r + 1) square inside the image is set; the border is neutral.

    Two range windows: set pixels near in the row, then rows near with a full stretch."""
    if radius <= 0:
        return mask.select(*keys, "y", "x").distinct()
    inside = lambda c, n: F.least(F.col(c) + radius, F.lit(n - 1)) - F.greatest(F.col(c) - radius, F.lit(0)) + 1
    one = mask.select(*keys, "y", "x").distinct()
    row = one.withColumn("__h", F.count("*").over(Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius)))
    full = row.where(F.col("__h") == inside("x", width))
    col = full.withColumn("__v", F.count("*").over(Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)))
    return col.where(F.col("__v") == inside("y", height)).select(*keys, "y", "x")


def dilate(mask: DataFrame, keys: list[str], radius: int, width: int, height: int) -> DataFrame:
    """F-4: pixels with a set one in their (2 r + 1) square.  One axis after the other: 2 (2 r + 1) copies, not (2 r + 1)**2."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    wide = mask.select(*keys, "y", F.explode(F.transform(step, lambda d: F.col("x") + d)).alias("x")).where(F.col("x").between(0, width - 1)).distinct()
    return wide.select(*keys, F.explode(F.transform(step, lambda d: F.col("y") + d)).alias("y"), "x").where(F.col("y").between(0, height - 1)).distinct()


def bbox(mask: DataFrame, keys: list[str]) -> DataFrame:
    """E-7: inclusive corners and the number of pixels."""
    return mask.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("foreground"))


#: A tile is a square of 8 x 8 pixels, whose set ones are one 64-bit word (bit 8 y + x); its number holds the tile's row and column.
TILE_SHIFT = 32


def to_tiles(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tile, word): masks as sparse tiles; repeated pixels count once.  Words are put together before the shuffle, which moves no pixel."""
    y, x = F.col("y").cast("bigint"), F.col("x").cast("bigint")
    tile = F.shiftleft(F.shiftright(y, 3), TILE_SHIFT).bitwiseOR(F.shiftright(x, 3))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (y.bitwiseAND(F.lit(7)) * 8 + x.bitwiseAND(F.lit(7))).cast("int"))
    return mask.select(*keys, tile.alias("tile"), bit.alias("__bit")).groupBy(*keys, "tile").agg(F.bit_or("__bit").alias("word"))


def from_tiles(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x): the pixels of sparse tiles."""
    there = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("word"), i).bitwiseAND(F.lit(1)) != 0)
    low = F.col("tile").bitwiseAND(F.lit((1 << TILE_SHIFT) - 1))
    rows = tiles.select(*keys, F.shiftright("tile", TILE_SHIFT).alias("__ty"), low.alias("__tx"), F.explode(there).alias("__i"))
    return rows.select(*keys, (F.col("__ty") * 8 + F.shiftright("__i", 3)).cast("int").alias("y"), (F.col("__tx") * 8 + F.col("__i").bitwiseAND(F.lit(7))).cast("int").alias("x"))


def packed(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tiles, words, area): each mask as one row, its tiles in order; an image of 640 x 480 pixels has 4,800 tiles at most."""
    rows = to_tiles(mask, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tile", "word"))).alias("__t"), F.sum(F.bit_count("word")).alias("area"))
    return rows.select(*keys, F.col("__t.tile").alias("tiles"), F.col("__t.word").alias("words"), "area")


def packed_iou(a: tuple, b: tuple) -> float:
    """D-7 of two packed masks (tiles, words): bits that both have over bits that one has."""
    (ta, wa), (tb, wb) = ((np.asarray(t, np.int64), np.asarray(w, np.int64)) for t, w in (a, b))
    _, i, j = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
    count = lambda w: int(np.bitwise_count(w.view(np.uint64)).sum())
    both = count(wa[i] & wb[j])
    union = count(wa) + count(wb) - both
    return both / union if union else 0.0


def owner_map(mask: DataFrame, frame: list[str], track: str = "track_id") -> DataFrame:
    """E-10: the instance of a pixel that exactly one covers, else 0.

    The instances of a tile (no more than a frame has) are gone through once, for the pixels that more than one covers."""
    members = to_tiles(mask, [*frame, track]).groupBy(*frame, "tile").agg(F.collect_list(F.struct(F.col(track).alias("owner"), "word")).alias("m"))
    start = F.struct(F.lit(0).cast("bigint").alias("one"), F.lit(0).cast("bigint").alias("more"))
    covered = F.aggregate("m", start, lambda s, m: F.struct(s["one"].bitwiseOR(m["word"]).alias("one"), s["more"].bitwiseOR(s["one"].bitwiseAND(m["word"])).alias("more")))
    rows = members.select(*frame, "tile", "m", covered["more"].alias("more"))
    alone = F.transform("m", lambda m: F.struct(m["owner"].alias("owner"), m["word"].bitwiseAND(F.bitwise_not("more")).alias("word")))
    none = F.array(F.struct(F.lit(0).cast(mask.schema[track].dataType).alias("owner"), F.col("more").alias("word")))
    return from_tiles(rows.select(*frame, "tile", F.inline(F.concat(alone, none))).where("word != 0"), [*frame, "owner"]).select(*frame, "y", "x", "owner")


def exclusion_union(mask: DataFrame, frame: list[str], labels: list[str], radius: int, width: int, height: int) -> DataFrame:
    """C-10, E-11: the union of the dilated masks of excluded labels."""
    return dilate(mask.where(F.col("label").isin(labels)), frame, radius, width, height)


def mask_iou(mask: DataFrame, frame: list[str], obj: str, digits: int = 6) -> DataFrame:
    """D-7: intersection over union of the masks of a frame that share a pixel (others have 0).  Masks meet by tiles, not by pixels."""
    one = to_tiles(mask, [*frame, obj])
    size = one.groupBy(*frame, obj).agg(F.sum(F.bit_count("word")).alias("n"))
    a, b = one.withColumnsRenamed({obj: "a", "word": "__a"}), one.withColumnsRenamed({obj: "b", "word": "__b"})
    both = F.bit_count(F.col("__a").bitwiseAND(F.col("__b")))
    inter = a.join(b, [*frame, "tile"]).where("a < b").groupBy(*frame, "a", "b").agg(F.sum(both).alias("i")).where("i > 0")
    sized = inter.join(size.withColumnsRenamed({obj: "a", "n": "n_a"}), [*frame, "a"]).join(size.withColumnsRenamed({obj: "b", "n": "n_b"}), [*frame, "b"])
    return sized.select(*frame, "a", "b", F.round(iou(F.col("i"), F.col("n_a"), F.col("n_b")), digits).alias("iou"))


def combine(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """H-4: OR or AND of two masks, by tiles."""
    one, two = to_tiles(a, keys), to_tiles(b, keys)
    if how == "or":
        tiles = one.union(two).groupBy(*keys, "tile").agg(F.bit_or("word").alias("word"))
    else:
        tiles = one.join(two.withColumnRenamed("word", "__b"), [*keys, "tile"]).withColumn("word", F.col("word").bitwiseAND(F.col("__b"))).drop("__b")
    return from_tiles(tiles, keys)


def instance_raster(mask: DataFrame, frame: list[str], code: str = "code", cap: int = 255) -> DataFrame:
    """A-15: compact code of the last instance at each pixel, at most cap."""
    return mask.groupBy(*frame, "y", "x").agg(F.max(F.least(F.col(code), F.lit(cap))).alias("code"))


def overlay(pixels: DataFrame, packed: Column, weight: float = 0.45) -> DataFrame:
    """A-14: colours of mask pixels mixed with the palette's."""
    part = lambda c, shift: F.round((1 - weight) * F.col(c) + weight * F.shiftright(packed, shift).bitwiseAND(F.lit(255))).cast("int")
    return pixels.withColumns({"r": part("r", 16), "g": part("g", 8), "b": part("b", 0)})


def resize_bilinear(logits: DataFrame, keys: list[str], src: tuple[int, int], dst: tuple[int, int], digits: int = 6) -> DataFrame:
    """B-20: logits on a grid of dst = (width, height), half-pixel centres, edges clamped.

    Each source pixel is sent to the target pixels that use it; the weights depend on the axis alone, so two small tables of
    (target, source, weight) are joined."""
    spark = logits.sparkSession

    def axis(n_src: int, n_dst: int, name: str) -> DataFrame:
        at = F.greatest((F.col("id") + 0.5) * (n_src / n_dst) - 0.5, F.lit(0.0))
        low = F.least(F.floor(at), F.lit(n_src - 1))
        t = spark.range(n_dst).select(F.col("id").cast("int").alias(f"{name}_out"), low.alias("l"), (at - low).alias("w"))
        pair = F.array(F.struct(F.col("l").cast("int").alias(name), (1 - F.col("w")).alias(f"w{name}")), F.struct(F.least(F.col("l") + 1, F.lit(n_src - 1)).cast("int").alias(name), F.col("w").alias(f"w{name}")))
        return t.select(f"{name}_out", F.inline(pair)).where(F.col(f"w{name}") > 0)

    xs, ys = axis(src[0], dst[0], "x"), axis(src[1], dst[1], "y")
    spread = logits.join(F.broadcast(xs), "x").join(F.broadcast(ys), "y")
    return spread.groupBy(*keys, F.col("y_out").alias("y"), F.col("x_out").alias("x")).agg(F.round(F.sum(F.col("logit") * F.col("wx") * F.col("wy")), digits).alias("logit"))


def label_components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """8-connected components of a pixel set: runs of a row are joined to touching runs of the row before; labels by first pixel."""
    order = np.lexsort((x, y))
    ys, xs = y[order], x[order]
    new = np.ones(len(ys), bool)
    new[1:] = (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)
    start = np.flatnonzero(new)
    run_y, lo = ys[start], xs[start]
    hi = xs[np.append(start[1:], len(xs)) - 1]
    parent = list(range(len(start)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    at = 0
    for k in range(len(start)):
        while at < k and (run_y[at] < run_y[k] - 1 or (run_y[at] == run_y[k] - 1 and hi[at] < lo[k] - 1)):
            at += 1
        j = at
        while j < k and run_y[j] == run_y[k] - 1 and lo[j] <= hi[k] + 1:
            a, b = find(j), find(k)
            parent[max(a, b)] = min(a, b)
            j += 1
    root = np.array([find(k) for k in range(len(start))], np.int64)
    _, dense = np.unique(root, return_inverse=True)
    out = np.empty(len(ys), np.int64)
    out[order] = np.repeat(dense + 1, np.diff(np.append(start, len(ys))))
    return out


def components(mask: DataFrame, keys: list[str]) -> DataFrame:
    """E-8: a component number for each pixel of a mask (8 neighbours)."""
    one = mask.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(component=label_components(pdf["y"].to_numpy(), pdf["x"].to_numpy()))

    return one.groupBy(*keys).applyInPandas(run, T.StructType([*one.schema, T.StructField("component", T.LongType())]))


def drop_small(mask: DataFrame, keys: list[str], least: int) -> DataFrame:
    """C-12: pixels of components with `least` pixels or more; skipped if least <= 1."""
    if least <= 1:
        return mask.select(*keys, "y", "x")
    parts = components(mask, keys)
    return parts.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "component"))).where(F.col("__n") >= least).select(*keys, "y", "x")


def map_frames(frames: DataFrame, model, schema: T.StructType | str) -> DataFrame:
    """A-7, A-8: the hook for a model: `model` turns an iterator of pandas batches of frames into batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from model(batches)

    return frames.mapInPandas(run, schema)


def with_depth(mask: DataFrame, depth: DataFrame, keys: list[str]) -> DataFrame:
    """D-5: mask pixels with their depth."""
    return mask.join(depth, [*keys, "y", "x"])


def materialize(instances: DataFrame, mask: DataFrame, keys: list[str], width: int) -> DataFrame:
    """A-19: each asked-for instance with its mask's pixel numbers (y * width + x) in order; none if there is no mask."""
    pixels = mask.groupBy(*keys).agg(F.sort_array(F.collect_set((F.col("y") * width + F.col("x")).cast("bigint"))).alias("pixels"))
    return instances.select(*keys).join(pixels, keys, "left").withColumn("pixels", F.coalesce("pixels", F.array().cast("array<bigint>")))
