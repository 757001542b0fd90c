"""Sparse voxel sets: first-wins deduplication, union, membership and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import KEY_BITS


def first_wins(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """E-1: one row for each key; of several, the first in the (total) order.  Partial sums run before the shuffle."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("__first")).select(*keys, "__first.*")


def downsample(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """E-3: as first_wins, with the row's number in the original order."""
    kept = first_wins(rows, keys, order, [*keep, *[c for c in order if c not in keep]])
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(*order)))


def union_first_wins(rows: DataFrame, group: list[str], member: str, key: str, keep: list[str]) -> DataFrame:
    """E-2, H-3: the union of the members' voxels; of equal keys the lowest member's row stays."""
    return rows.groupBy(*group, key).agg(F.min_by(F.struct(member, *keep), F.struct(member, key)).alias("__first")).select(*group, key, "__first.*")


def bbox(rows: DataFrame, keys: list[str], axes: tuple[str, ...] = ("vx", "vy", "vz")) -> DataFrame:
    """E-6: lowest and highest coordinates, and the number of voxels."""
    return rows.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "min"), (F.max, "max"))], F.count("*").alias("n_voxels"))


#: Bits of a block's coordinate: a block is a cube of 4 x 4 x 4 voxels, whose occupancy is one 64-bit word (bit 16 x + 4 y + z).
BLOCK_BITS = KEY_BITS - 2


def _bits(stride: int, low: int, high: int) -> Column:
    """The word of all voxels whose place along the axis with this stride is from low to high."""
    word = sum(1 << i for i in range(64) if low <= i // stride % 4 <= high)
    return F.lit(word - (1 << 64) if word >> 63 else word)


def to_blocks(voxels: DataFrame, ids: list[str], key: str = "key") -> DataFrame:
    """(ids, block, word): sets of voxels as sparse blocks; repeated voxels count once.  Words are put together before the shuffle."""
    at = [F.shiftright(key, k * KEY_BITS).bitwiseAND(F.lit((1 << KEY_BITS) - 1)) for k in (2, 1, 0)]
    block = sum((F.shiftleft(F.shiftright(v, 2), k * BLOCK_BITS) for k, v in zip((2, 1, 0), at)), F.lit(0).cast("bigint"))
    x, y, z = (v.bitwiseAND(F.lit(3)) for v in at)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (x * 16 + y * 4 + z).cast("int"))
    return voxels.select(*ids, block.alias("block"), bit.alias("__bit")).groupBy(*ids, "block").agg(F.bit_or("__bit").alias("word"))


def from_blocks(blocks: DataFrame, ids: list[str], key: str = "key") -> DataFrame:
    """(ids, key): the voxels of sparse blocks."""
    at = [F.shiftright("block", k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for k in (2, 1, 0)]
    base = sum((F.shiftleft(v, k * KEY_BITS + 2) for k, v in zip((2, 1, 0), at)), F.lit(0).cast("bigint"))
    inside = F.array(*[F.lit((i >> 4 << 2 * KEY_BITS) | ((i >> 2 & 3) << KEY_BITS) | (i & 3)).cast("bigint") for i in range(64)])
    there = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("word"), i).bitwiseAND(F.lit(1)) != 0)
    return blocks.select(*ids, base.alias("__base"), F.explode(F.transform(there, lambda i: F.element_at(inside, i + 1))).alias("__in")).select(*ids, (F.col("__base") + F.col("__in")).alias(key))


def _spread(word: Column, stride: int, radius: int) -> list[Column]:
    """What a block gives to the block before it, to itself and to the one after it, along one axis; radius up to 4."""
    down = up = F.lit(0).cast("bigint")
    own = word
    for d in range(1, radius + 1):
        if d < 4:
            own = own.bitwiseOR(F.shiftleft(word, d * stride).bitwiseAND(_bits(stride, d, 3))).bitwiseOR(F.shiftrightunsigned(word, d * stride).bitwiseAND(_bits(stride, 0, 3 - d)))
        up = up.bitwiseOR(F.shiftrightunsigned(word, (4 - d) * stride).bitwiseAND(_bits(stride, 0, d - 1)))
        down = down.bitwiseOR(F.shiftleft(word, (4 - d) * stride).bitwiseAND(_bits(stride, 4 - d, 3)))
    return [down, own, up]


def dilate_blocks(blocks: DataFrame, ids: list[str], radius: int) -> DataFrame:
    """D-10, F-5 on sparse blocks: all voxels at a Chebyshev distance of up to radius that lie on the lattice.

    Words are shifted along one axis after the other, with what crosses a border going to the block beside; a block gives at most 27 words, those that are
    not empty, to be put together before and after one shuffle.  Larger radii are several steps of up to 4."""
    at = [F.shiftright("block", k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for k in (2, 1, 0)]
    for r in [4] * (radius // 4) + [radius % 4] * (radius % 4 > 0):
        given = []
        for dz, wz in zip((-1, 0, 1), _spread(F.col("word"), 1, r)):
            for dy, wy in zip((-1, 0, 1), _spread(wz, 4, r)):
                for dx, wx in zip((-1, 0, 1), _spread(wy, 16, r)):
                    inner = [(v >= 1) if d < 0 else (v < (1 << BLOCK_BITS) - 1) for v, d in zip(at, (dx, dy, dz)) if d]
                    on = F.lit(True)
                    for i in inner:
                        on = on & i
                    step = dx * (1 << 2 * BLOCK_BITS) + dy * (1 << BLOCK_BITS) + dz
                    given.append(F.struct((F.col("block") + step).alias("block"), F.when(on, wx).otherwise(F.lit(0)).alias("word")))
        moved = blocks.select(*ids, F.inline(F.array(*given))).where("word != 0")
        blocks = moved.groupBy(*ids, "block").agg(F.bit_or("word").alias("word"))
    return blocks


def neighbourhood(voxels: DataFrame, ids: list[str], radius: int, key: str = "key") -> DataFrame:
    """D-10, F-5: the dilated set (Chebyshev distance up to radius), worked on as sparse blocks; coordinates outside the lattice are left out."""
    return from_blocks(dilate_blocks(to_blocks(voxels, ids, key), ids, radius), ids, key)


def coverage(voxels: DataFrame, pairs: DataFrame, ids: list[str], a: str, b: str, radius: int, key: str = "key") -> DataFrame:
    """D-9, D-10, D-11, E-9: for each pair (a, b) the share of a's voxels near one of b's, the reverse, and their mean.

    voxels: (ids, obs, key).  pairs: (ids, a, b).  Sets are sparse blocks of 64 voxels; a block meets the same block of the dilated target, and the
    bits that both have are counted."""
    own = to_blocks(voxels, [*ids, "obs"], key)
    near = dilate_blocks(own, [*ids, "obs"], radius).select(*ids, F.col("obs").alias("__dst"), "block", F.col("word").alias("__near"))
    sizes = own.groupBy(*ids, F.col("obs").alias("__src")).agg(F.sum(F.bit_count("word")).alias("__n"))
    # Both directions in one join: a pair is two rows (source, target).
    both = pairs.select(*ids, a, b, F.explode(F.array(F.struct(F.col(a).alias("s"), F.col(b).alias("d")), F.struct(F.col(b).alias("s"), F.col(a).alias("d")))).alias("__x"))
    both = both.select(*ids, a, b, F.col("__x.s").alias("__src"), F.col("__x.d").alias("__dst"))
    hits = both.select(*ids, "__src", "__dst").distinct().join(own.withColumnRenamed("obs", "__src"), [*ids, "__src"]).join(near, [*ids, "__dst", "block"])
    hits = hits.groupBy(*ids, "__src", "__dst").agg(F.sum(F.bit_count(F.col("word").bitwiseAND(F.col("__near")))).alias("__h"))
    shares = both.join(hits, [*ids, "__src", "__dst"], "left").join(sizes, [*ids, "__src"]).withColumn("__share", F.coalesce("__h", F.lit(0)) / F.col("__n"))
    one = lambda src, out: F.max(F.when(F.col("__src") == F.col(src), F.col("__share"))).alias(out)
    return shares.groupBy(*ids, a, b).agg(one(a, "a_to_b"), one(b, "b_to_a")).withColumn("score", 0.5 * (F.col("a_to_b") + F.col("b_to_a")))


def rank_in_segment(rows: DataFrame, segment: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """F-7, G-5: dense positions of rows inside their segment."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*segment).orderBy(*order)) - 1)


def segment_offsets(rows: DataFrame, group: list[str], segment: str, cap: int) -> DataFrame:
    """E-18: rows of each segment, capped, and where the segment starts in the packed order of its group."""
    counts = rows.groupBy(*group, segment).agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    w = Window.partitionBy(*group).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint"))
