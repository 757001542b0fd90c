"""Exact substring deduplication by hash-compared suffix sorting.

A byte is removed if a string of LENGTH bytes that covers it starts anywhere else
too.  The windows of LENGTH bytes are never shuffled one by one: each has an
anchor, its smallest k-gram hash (rightmost on ties), which depends on its bytes
alone; consecutive windows with the same anchor are a run, about 80 windows long.
Equal windows lie in runs of the same anchor.

 1. Runs are counted by anchor (with map-side sums).  Anchors met once are done.
 2. Runs of other anchors are shuffled, without their bytes.  A run whose bytes have the same digest (128 bits of
    SHA-256) as another run of its anchor is repeated as a whole.
 3. Of the rest, one run for each anchor and content gets its bytes.  The runs of an
    anchor are suffixes that begin there: they are sorted by mergesort, whose comparisons find
    the common extension by binary search over prefix hashes.  Neighbours' common extensions
    cut the order into segments for each length to the right; with a hash of
    the bytes to the left they show which windows are repeated, and bytes are compared to rule
    out collisions.
 4. An anchor with more than SORTED_RUNS different runs is split before it is sorted: its windows are dealt to
    STRATA by the number of bytes before the anchor, and those of a stratum to groups by all
    bytes that equal windows of the stratum must share.  Groups are treated as anchors
    in 2 and 3.  In a group that is still over the bound (its windows share LENGTH - LENGTH / STRATA bytes or so),
    windows are counted by their bytes, with map-side sums.
 5. Only texts that have something to remove, or share a hash bit with one, are
    shuffled, to be joined with their spans; texts that occur twice are removed whole.

Bitmaps that reach all tasks have a fixed size.  Texts are told apart by two independent 64-bit hashes.

Defined results: null and empty texts have 0 bytes and nothing to remove; texts
under LENGTH bytes keep everything; texts longer than STEP_BYTES are worked on in overlapping pieces, with the
same results; repeated rows count as other occurrences; rows without an id are treated as all others, as are
rows that share an id; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, chunked, cut, in_arrow, mix, pieces, powers, prefix_hash, random_table, range_hash, read

LENGTH, GRAM = 200, 40
#: Different runs of one anchor that are sorted together (about 100 bytes of memory for each of their bytes); more are split into strata.
SORTED_RUNS = 4_000
STRATA = 8
#: Runs, in whole anchors, that are sorted at once.
FLUSH_RUNS = 4_000
#: Pairs of windows whose bytes are compared at once.
COMPARED = 1024
BITMAP_BITS = 24
#: Bytes of text whose runs are found at once: about 110 times as much memory.
STEP_BYTES = 1 << 18
#: What tells a text: two hashes.
NODE = ["node", "twin"]
_VALUES = random_table(6)
_POS = U64((1 << 28) - 1)
_MUL = U64(0xD1342543DE82EF95)


def runs(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The runs of all texts: text, first and last window start and anchor place (in buf), and anchor hash."""
    window = length - gram + 1
    n = len(buf) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return dict(text=empty, first=empty, last=empty, at=empty, anchor=empty.astype(np.uint64))
    prefix = prefix_hash(_VALUES[buf])
    place = np.arange(len(buf) - gram + 1)
    g = mix(range_hash(prefix, place, place + gram))
    key = (g & ~_POS) | (_POS - place.astype(np.uint64))
    blocks = -(-len(key) // window)
    pad = np.full(blocks * window, U64(0xFFFFFFFFFFFFFFFF))
    pad[: len(key)] = key
    pad = pad.reshape(blocks, window)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[window - 1 : window - 1 + n])
    # Windows of text d start in [offs[d], offs[d + 1] - length].
    mark = np.zeros(len(buf) + 2, np.int32)
    lo, hi = offs[:-1], np.maximum(offs[:-1], offs[1:] - length + 1)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi, -1)
    inside = np.cumsum(mark)[:n] > 0
    new = np.ones(n + 1, bool)
    new[1:n] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    new[offs[(offs > 0) & (offs < n)]] = True
    start = np.flatnonzero(new)
    first, last = start[:-1], start[1:] - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    at = (_POS - (least[first] & _POS)).astype(np.int64)
    return dict(text=np.searchsorted(offs, first, side="right") - 1, first=first, last=last, at=at, anchor=g[at])


def digests(buf: np.ndarray, found: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of SHA-256 of each run's bytes and anchor place."""
    raw = buf.tobytes()
    each = zip(found["first"].tolist(), (found["last"] + length).tolist(), (found["at"] - found["first"]).tolist())
    out = np.frombuffer(b"".join(hashlib.sha256(raw[s:e] + bytes((a & 255, a >> 8))).digest()[:16] for s, e, a in each), np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def distinct_texts(batch: pa.RecordBatch, *node: int) -> pa.RecordBatch:
    """The rows of a batch without further copies of a text."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in node], axis=1)
    _, at = np.unique(keys, axis=0, return_index=True)
    return batch if len(at) == len(batch) else batch.take(pa.array(np.sort(at)))


def bitmap(numbers: DataFrame, column: str) -> DataFrame:
    """(__rv_word, __rv_bits): a set of 64-bit hashes as a bitmap of 2**BITMAP_BITS bits, of bounded size whatever its input."""
    slot = F.shiftrightunsigned(column, 64 - BITMAP_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - BITMAP_BITS}) & 63 as int))")
    return numbers.groupBy(F.shiftright(slot, 6).alias("__rv_word")).agg(F.bit_or(bit).alias("__rv_bits"))


def collected(bits: DataFrame) -> np.ndarray:
    """A bitmap as an array of 2**BITMAP_BITS / 64 words."""
    got, out = bits.toArrow(), np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def has_bit(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = numbers.view(np.uint64) >> U64(64 - BITMAP_BITS)
    return (words[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1


def with_bit(rows: DataFrame, column: str, bits: DataFrame, out: str) -> DataFrame:
    """Adds whether the number may be in the bitmap: never false for a member."""
    slot = F.shiftrightunsigned(column, 70 - BITMAP_BITS)
    hit = F.expr(f"shiftrightunsigned(__rv_bits, cast(shiftrightunsigned({column}, {64 - BITMAP_BITS}) & 63 as int)) & 1L") == 1
    return rows.join(F.broadcast(bits), slot == F.col("__rv_word"), "left").withColumn(out, F.coalesce(hit, F.lit(False))).drop("__rv_word", "__rv_bits")


class Slices:
    """The bytes of many short slices and their prefix hashes; powers follow the place in the slice, so few are needed."""

    def __init__(self, data: list[bytes]):
        lens = np.array([len(d) for d in data], np.int64)
        self.buf = np.frombuffer(b"".join(data), np.uint8)
        self.begin = np.cumsum(lens) - lens
        self.place = np.zeros(len(self.buf) + 1, np.int32)
        self.place[:-1] = np.arange(len(self.buf)) - np.repeat(self.begin, lens)
        up, self.down = powers(int(lens.max(initial=0)) + 1)
        self.prefix = np.zeros(len(self.buf) + 1, U64)
        np.multiply(_VALUES[self.buf], up[self.place[:-1]], out=self.prefix[1:])
        np.cumsum(self.prefix, out=self.prefix)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[self.place[start]]


def common_extension(text: Slices, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to most: binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = text.hash(a, a + mid) == text.hash(b, b + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_order(text: Slices, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mergesort of the suffixes [start, end) within their groups (group is ascending), all pairs of runs of a
    level merged at once: each suffix finds its place in the sibling run by binary search, a
    comparison being one common extension and one byte."""

    def below(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y; equal ones as ties says."""
        most = np.minimum(end[x] - start[x], end[y] - start[y])
        e = common_extension(text, start[x], start[y], most)
        out = np.where(end[x] - start[x] == end[y] - start[y], ties, end[x] - start[x] < end[y] - start[y])
        on = e < most
        out[on] = text.buf[start[x[on]] + e[on]] < text.buf[start[y[on]] + e[on]]
        return out

    n = len(start)
    order = np.arange(n)
    if not n:
        return order
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(heads, n))
    base = np.repeat(heads, size)
    top = base + np.repeat(size, size)
    width = 1
    while width < size.max():
        slot = np.arange(n)
        run = (slot - base) // width
        left = run % 2 == 0
        sib = base + (run + np.where(left, 1, -1)) * width
        sib_end = np.minimum(sib + width, top)
        lo, hi = np.minimum(sib, top), np.maximum(np.minimum(sib, top), sib_end)
        first = lo.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            # An equal suffix of the left run stays before one of the right run.
            before = below(order[mid], order[live], ~left[live])
            lo[live[before]] = mid[before] + 1
            hi[live[~before]] = mid[~before]
            live = live[lo[live] < hi[live]]
        own = slot - (base + run * width)
        start_pair = base + (run - run % 2) * width
        to = start_pair + own + (lo - first)
        merged = np.empty(n, np.int64)
        merged[to] = order
        order = merged
        width *= 2
    return order


def repeated_windows(data: list[bytes], anchor: np.ndarray, at: np.ndarray, windows: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For runs with bytes data[i], anchor gram at at[i] and `windows` windows: the first and the last window
    whose bytes another run of the same anchor has too (-1: none)."""
    n = len(data)
    lens = np.array([len(d) for d in data], np.int64)
    text = Slices(data)
    buf, begin = text.buf, text.begin
    by = np.argsort(anchor, kind="stable")
    order = by[suffix_order(text, anchor[by], (begin + at)[by], (begin + lens)[by])]
    a, s, e = anchor[order], (begin + at)[order], (begin + lens)[order]
    shared = np.zeros(n, np.int64)  # common extension with the suffix before
    pair = np.flatnonzero(a[1:] == a[:-1]) + 1
    shared[pair] = common_extension(text, s[pair - 1], s[pair], np.minimum((e - s)[pair - 1], (e - s)[pair]))
    b0, at_, w = begin[order], at[order], windows[order]
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for left in range(length - gram, -1, -1):  # bytes of the window before the anchor
        k = at_ - left  # the number of that window in its run
        ok = np.flatnonzero((k >= 0) & (k < w))
        if len(ok) < 2:
            continue
        segment = np.cumsum(shared < length - left)[ok].astype(np.uint64)
        key = mix(segment * _MUL + text.hash(s[ok] - left, s[ok]))
        by = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        if not len(same):
            continue
        x, y = ok[by[same]], ok[by[same + 1]]
        span, at_x, at_y = np.arange(length), (b0 + k)[x], (b0 + k)[y]
        real = np.concatenate([(buf[at_x[i : i + COMPARED][:, None] + span] == buf[at_y[i : i + COMPARED][:, None] + span]).all(axis=1) for i in range(0, len(x), COMPARED)])
        hit = np.unique(np.concatenate([x[real], y[real]]))
        last[hit] = np.maximum(last[hit], k[hit])
        first[hit] = np.where(first[hit] < 0, k[hit], np.minimum(first[hit], k[hit]))
    out = np.full((2, n), -1, np.int64)
    out[0, order], out[1, order] = first, last
    return out[0], out[1]


SPAN = "node long, twin long, s long, e long"
GROUP = "anchor long, node long, twin long, first long, at long, windows long, data binary"


def _sorted_spans(groups: DataFrame, length: int, gram: int) -> DataFrame:
    """(node, twin, s, e) from rows as GROUP has them, of bounded numbers for each anchor; at: where the anchor's gram begins."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        col = lambda c: t.column(c).to_numpy()
        a, b = repeated_windows([d.as_py() for d in t.column("data")], col("anchor"), col("at"), col("windows"), length, gram)
        ok = a >= 0
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (col("node")[ok], col("twin")[ok], (col("first") + a)[ok], (col("first") + b)[ok] + length))], ["node", "twin", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            anchors = batch.column(0).to_numpy()
            # Rows of an anchor stay together: a batch is cut where the anchor changes.
            ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(batch))
            if held and n >= FLUSH_RUNS and held[-1].column(0)[-1].as_py() != anchors[0]:
                yield flush(held)
                held, n = [], 0
            at = 0
            for end in ends.tolist():
                if n + end - at >= FLUSH_RUNS or end == len(batch):
                    held.append(batch.slice(at, end - at))
                    n, at = n + end - at, end
                    if n >= FLUSH_RUNS and end < len(batch):
                        yield flush(held)
                        held, n = [], 0
        if held:
            yield flush(held)

    return in_arrow(groups.select(*(f.split()[0] for f in GROUP.split(", "))).repartition("anchor").sortWithinPartitions("anchor"), run, SPAN)


def _strata(groups: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows as GROUP has them, of hot anchors: each run's windows by stratum; the anchor is a hash of all bytes that equal windows
    of the stratum share, and `at` is where these begin."""
    step = -(-(length - gram + 1) // STRATA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for anchor, node, twin, first, at, windows, data in zip(*(c.to_pylist() for c in batch.columns)):
                for j in range(STRATA):
                    # Windows with low <= left <= high bytes before the anchor; window k has at - k.
                    low, high = j * step, min((j + 1) * step - 1, length - gram)
                    k0, k1 = max(0, at - high), min(windows - 1, at - low)
                    if k0 > k1:
                        continue
                    begin, end = at - low, at - high + length  # in every one of these windows
                    own = hashlib.sha256(struct.pack("<qb", anchor, j) + data[begin:end]).digest()
                    for c, v in zip(out, (int.from_bytes(own[:8], "little", signed=True), node, twin, first + k0, begin - k0, k1 - k0 + 1, data[k0 : k1 + length])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], [f.split()[0] for f in GROUP.split(", ")])

    return in_arrow(groups.select(*(f.split()[0] for f in GROUP.split(", "))), run, GROUP)


def _counted_spans(groups: DataFrame, length: int) -> DataFrame:
    """(node, twin, s, e) from rows as GROUP has them: windows counted by their bytes."""
    window = F.explode(F.transform(F.sequence(F.lit(0), (F.col("windows") - 1).cast("int")), lambda k: F.struct(k.alias("k"), F.substring(F.col("data"), k + 1, F.lit(length)).alias("w"))))
    each = groups.select(*NODE, "first", window.alias("x")).select(*NODE, (F.col("first") + F.col("x.k")).alias("s"), F.col("x.w").alias("w"))
    again = each.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    return each.join(again, "w").select(*NODE, "s", (F.col("s") + length).alias("e"))


def _resolved(groups: DataFrame, length: int, gram: int, sorted_runs: int) -> DataFrame:
    """(node, twin, s, e) of the repeated windows of different runs (rows as GROUP has them), whatever their number by anchor."""
    over = lambda df: cut(df.groupBy("anchor").agg(F.count("*").alias("d")).where(F.col("d") > sorted_runs).select("anchor"))
    hot = over(groups)
    if hot.isEmpty():
        return _sorted_spans(groups, length, gram)
    found = _sorted_spans(groups.join(hot, "anchor", "left_anti"), length, gram)
    strata = cut(_strata(groups.join(hot, "anchor", "left_semi"), length, gram))
    # Equal slices of a group are repeated as a whole; one of them goes on.
    least = F.min(F.struct(*NODE, "first", "windows")).alias("r")
    slices = cut(strata.groupBy("anchor", "at", "data").agg(F.count("*").alias("c"), least))
    again = strata.join(slices.where("c > 1").select("anchor", "at", "data"), ["anchor", "at", "data"])
    found = found.unionByName(again.select(*NODE, F.col("first").alias("s"), (F.col("first") + F.col("windows") + length - 1).alias("e")))
    one = slices.select("anchor", "r.node", "r.twin", "r.first", "at", "r.windows", "data")
    still = over(one)
    found = found.unionByName(_sorted_spans(one.join(still, "anchor", "left_anti"), length, gram))
    return found if still.isEmpty() else found.unionByName(_counted_spans(one.join(still, "anchor", "left_semi"), length))


def spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, sorted_runs: int = SORTED_RUNS) -> DataFrame:
    """(node, twin, spans) for texts in which something is repeated, from rows (node, twin, __rv_text); spans may overlap."""
    rows = rows.select("__rv_text", *NODE).where(F.octet_length("__rv_text") >= length)

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        """Distinct texts, a piece's bytes, its runs, and the row and start in that row's text of the texts of the piece."""
        for batch in batches:
            part = distinct_texts(batch, 1, 2)
            for buf, offs, row, base in pieces(part.column(0), length - 1, STEP_BYTES):
                yield part, buf, runs(buf, offs, length, gram), row, base - offs[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, r, _, _ in found_in(batches):
            yield pa.RecordBatch.from_arrays([pa.array(r["anchor"].view(np.int64)), *map(pa.array, digests(buf, r, length))], ["anchor", "d1", "d2"])

    unlike = (F.min("d1") != F.max("d1")) | (F.min("d2") != F.max("d2"))
    met = cut(in_arrow(rows, count, "anchor long, d1 long, d2 long").groupBy("anchor").agg(F.count("*").alias("c"), unlike.alias("mixed")).where("c > 1").select("anchor", "mixed"))
    if met.isEmpty():
        return rows.sparkSession.createDataFrame([], "node long, twin long, spans array<struct<s:bigint,e:bigint>>")
    words = rows.sparkSession.sparkContext.broadcast(collected(bitmap(met, "anchor")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, r, row, base in found_in(batches):
            keep = has_bit(words.value, r["anchor"])
            r = {k: v[keep] for k, v in r.items()}
            own, first = pa.array(row[r["text"]]), r["first"] + base[r["text"]]
            # The first window, 16 bits of the number of windows and 16 of the anchor's place in the run.
            place = first << 32 | (r["last"] - r["first"] + 1) << 16 | r["at"] - r["first"]
            yield pa.RecordBatch.from_arrays([pa.array(r["anchor"].view(np.int64)), *map(pa.array, digests(buf, r, length)), part.column(1).take(own), part.column(2).take(own), pa.array(place)], ["anchor", "d1", "d2", *NODE, "place"])

    first, windows = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF))
    span = [*NODE, first.alias("s"), (first + windows + F.lit(length - 1)).alias("e")]
    met_runs = cut(in_arrow(rows, emit, "anchor long, d1 long, d2 long, node long, twin long, place long").join(met, "anchor"))
    equal = met_runs.where("not mixed").select(*span)
    key = ["anchor", "d1", "d2"]
    mixed = met_runs.where("mixed").drop("mixed")
    # The three come from one row: nothing is skipped, and all are taken in the same order.
    contents = cut(mixed.groupBy(*key).agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in (*NODE, "place"))))
    again = mixed.join(contents.where("c > 1").select(*key), key).select(*span)
    by_node = cut(contents.groupBy(*NODE).agg(F.collect_list(F.struct("anchor", "place")).alias("runs")))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield distinct_texts(batch, 1, 2)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for text, node, twin, found in zip(*(batch.column(c) for c in ("__rv_text", *NODE, "runs"))):
                if before == (node := (node.as_py(), twin.as_py())):  # copies of a text come one after another
                    continue
                before, raw = node, text.as_py().encode()
                for r in found.as_py():
                    s, n, a = r["place"] >> 32, r["place"] >> 16 & 0xFFFF, r["place"] & 0xFFFF
                    for c, v in zip(out, (r["anchor"], *node, s, a, n, raw[s : s + n + length - 1])):
                        c.append(v)
                    size += n + length
                if size >= 1 << 21:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], [f.split()[0] for f in GROUP.split(", ")])
                    out, size = [[] for _ in range(7)], 0
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], [f.split()[0] for f in GROUP.split(", ")])

    texts = in_arrow(with_bit(rows, "node", bitmap(by_node, "node"), "__rv_in").where("__rv_in").select("__rv_text", *NODE), single, "__rv_text string, node long, twin long")
    groups = cut(in_arrow(texts.join(by_node, NODE), slices, GROUP))
    found = equal.unionByName(again).unionByName(_resolved(groups, length, gram, sorted_runs))
    return found.distinct().groupBy(*NODE).agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def removed(n_bytes: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, min(e, n_bytes)) for s, e in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, sorted_runs: int = SORTED_RUNS, keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes)."""
    rows = docs.select(F.col(id_col).alias("__rv_id"), F.coalesce(F.col(text), F.lit("")).alias("__rv_text")).withColumns({"node": F.xxhash64("__rv_text"), "twin": F.xxhash64(F.lit(1), "__rv_text")})
    found = spans(rows, length, gram, sorted_runs)
    twice = rows.where(F.octet_length("__rv_text") >= length).groupBy(*NODE).agg(F.count("*").alias("c")).where("c > 1").select(*NODE, F.lit(True).alias("whole"))
    touched = cut(found.join(twice, NODE, "full").select(*NODE, "spans", "whole"))
    split = with_bit(rows, "node", bitmap(touched, "node"), "__rv_in")
    kept = [F.col("__rv_text").cast("binary").alias("kept")] if keep_text else []
    same = split.where("not __rv_in").select(F.col("__rv_id").alias(id_col), F.octet_length("__rv_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("__rv_text").cast("binary"), 256).alias("kept_sha256"), *kept)
    joined = split.where("__rv_in").drop("__rv_in").join(touched, NODE, "left").select("__rv_id", "__rv_text", "spans", "whole")
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.BinaryType())] * keep_text
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, "__rv_text"):
                out: list[list] = [[] for _ in range(5)]
                for t, found_, whole in zip(*(part.column(c).to_pylist() for c in ("__rv_text", "spans", "whole"))):
                    raw = t.encode()
                    gone = [(0, len(raw))] if whole else removed(len(raw), [(x["s"], x["e"]) for x in found_ or []])
                    cuts = [0, *(x for s in gone for x in s), len(raw)]
                    rest = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                    for c, v in zip(out, (len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest)):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))][: len(schema)], schema.names)

    return same.unionByName(in_arrow(joined, run, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
