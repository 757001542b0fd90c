"""Benchmark decontamination with suffix arrays.

A shard is a memory-bounded run of documents inside one task.  Its words are
hashed, and a suffix array of the shard is built by prefix doubling over the
suffixes that begin with a word pair of the benchmark (no other suffix can share
two words with a benchmark text, so leaving them out changes no result).  Every
benchmark suffix is then binary-searched in every shard: the interval of the
array that shares a whole window gives all places of that window, the neighbours
of the insertion point give the longest verbatim match.

The benchmark reaches the tasks in blocks of about BLOCK_BYTES (measured
first); a benchmark over that size is searched block after block, each in a pass of its own whose rows are
written to the checkpoint folder, so that neither the driver nor a task ever holds two blocks.  Nothing is
shuffled.  Words are compared by 64-bit hashes.

Defined results: null or empty text has no words and is clean; a text of any length is searched whole, as one shard if it
is longer than one; null or empty items have no windows; an item id given twice counts once, a null one is the empty id;
repeated documents get the same result each; an empty table gives an empty result, and an empty benchmark leaves all
documents clean; other columns are ignored by `scan` and kept by `remove_contaminated`, whatever their names (but for those
that begin with `__rv_`).  Where several items or places match alike, all of them count in `scan`; `longest_matches` says
which one it reports.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, byte_set, chunked, cut, in_arrow, lower_values, mix, prefix_hash, range_hash, read, utf8, word_bounds

#: Words of an item that make a window; a shorter item is one window.
WINDOW = 10
#: Bytes of benchmark text that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20

_WORD = byte_set([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_VALUES = lower_values(2)
_STEP = U64(0xD6E8FEB86659FD93)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each lower-cased word, and the number of each text's first word."""
    starts, ends, first = word_bounds(buf, offs, _WORD)
    return mix(range_hash(prefix_hash(_VALUES[buf]), starts, ends)), first


def grams(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the `size` (1 or 2) words at each place, and whether they lie in one text."""
    if size == 1:
        return words, np.ones(len(words), bool)
    key = words.copy()
    key[:-1] = mix(words[:-1] * _STEP + words[1:])
    inside = np.ones(len(words), bool)
    ends = first[1:][np.diff(first) > 0] - 1
    inside[ends] = False
    return key, inside


@dataclass(frozen=True)
class Block:
    """Benchmark texts as symbol numbers: symbol i is the word pair (or word) with hash keys[i]."""

    size: int
    keys: np.ndarray
    seen: np.ndarray
    symbols: np.ndarray
    left: np.ndarray  # symbols from here to the end of the item
    window: np.ndarray  # symbols of the window that starts here; 0: none starts here
    item: np.ndarray  # the item of each symbol
    word: np.ndarray  # the word number in that item
    ids: list[str]


def make_block(ids: list[str], texts: list[str | None], window: int = WINDOW) -> Block:
    buf, offs = utf8(pa.array(texts, pa.string()))
    words, first = word_hashes(buf, offs)
    lens = np.diff(first)
    size = 1 if (lens == 1).any() else 2
    key, inside = grams(words, first, size)
    item = np.repeat(np.arange(len(texts)), lens)
    word = np.arange(len(words)) - first[:-1][item] if len(words) else np.zeros(0, np.int64)
    width = np.minimum(window, lens)[item] if len(words) else word
    starts = np.where(lens[item] - word >= width, width - size + 1, 0) if len(words) else word
    keys, symbols = np.unique(key[inside], return_inverse=True)
    seen = np.zeros(1 << 22, bool)
    seen[(keys >> U64(42)).astype(np.int64)] = True
    return Block(size, keys, seen, symbols, (lens[item] - word - size + 1)[inside], starts[inside], item[inside], word[inside], ids)


def blocks(bench: DataFrame, item_col: str, text: str, window: int) -> Iterator[Block]:
    """The benchmark's blocks (one at least); each is fetched when its turn comes."""
    rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t is not null")
    n = -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES) or 1
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield make_block([r["i"] for r in got], [r["t"] for r in got], window)


@dataclass(frozen=True)
class Shard:
    """A suffix array: order lists entries; entry e has symbol symbols[e] and stands at word place[e]; run_end[e] ends its run."""

    symbols: np.ndarray
    place: np.ndarray
    run_end: np.ndarray
    order: np.ndarray


def suffix_array(symbols: np.ndarray, run_end: np.ndarray) -> np.ndarray:
    """Entries in the order of their suffixes, by prefix doubling; a suffix ends with its run."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    rank, h, longest = symbols.astype(np.int64) + 1, 1, int((run_end - np.arange(n)).max())
    at = np.arange(n)
    while True:
        key = rank * (n + len(symbols) + int(rank.max()) + 2)
        more = at + h < run_end
        key[more] += rank[at[more] + h]
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[1], np.diff(key[order]) != 0]).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = step
        h *= 2
        if step[-1] == n or h > longest:
            return order


def make_shard(words: np.ndarray, first: np.ndarray, block: Block) -> Shard:
    key, inside = grams(words, first, block.size)
    place = np.flatnonzero(block.seen[(key >> U64(42)).astype(np.int64)] & inside) if len(key) else np.zeros(0, np.int64)
    symbols = np.searchsorted(block.keys, key[place])
    ok = symbols < len(block.keys)
    ok[ok] = block.keys[symbols[ok]] == key[place[ok]]
    place, symbols = place[ok], symbols[ok]
    text = np.searchsorted(first, place, side="right")
    breaks = np.ones(len(place) + 1, bool)
    if len(place):
        breaks[1:-1] = (np.diff(place) != 1) | (np.diff(text) != 0)
    ends = np.flatnonzero(breaks)[1:]
    run_end = np.repeat(ends, np.diff(np.flatnonzero(breaks))) if len(place) else np.zeros(0, np.int64)
    return Shard(symbols, place, run_end, suffix_array(symbols, run_end))


def common_prefix(shard: Shard, entries: np.ndarray, block: Block, at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Symbols that suffix entries[i] of the shard shares with benchmark suffix at[i], up to most[i]."""
    out = np.zeros(len(at), np.int64)
    live = np.flatnonzero(most > 0)
    depth = 0
    while len(live):
        e = entries[live] + depth
        same = e < shard.run_end[entries[live]]
        same[same] = shard.symbols[e[same]] == block.symbols[at[live[same]] + depth]
        live = live[same]
        depth += 1
        out[live] = depth
        live = live[depth < most[live]]
    return out


def search(shard: Shard, block: Block, at: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
    """Binary search for benchmark suffixes cut to `length` symbols: where they stand before (after) equal ones."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(shard.order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        e = shard.order[mid]
        same = common_prefix(shard, e, block, at[open_], length[open_])
        whole = same == length[open_]
        ended = ~whole & (e + same >= shard.run_end[e])
        less = ended.copy()
        rest = np.flatnonzero(~whole & ~ended)
        less[rest] = shard.symbols[e[rest] + same[rest]] < block.symbols[at[open_[rest]] + same[rest]]
        less |= whole & after
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


def present(shard: Shard, block: Block) -> np.ndarray:
    """Benchmark places with a window all of whose symbols occur in the shard."""
    if not len(shard.symbols):
        return np.zeros(0, np.int64)
    here = np.zeros(len(block.keys), bool)
    here[shard.symbols] = True
    total = np.concatenate([[0], np.cumsum(here[block.symbols])])
    at = np.flatnonzero(block.window > 0)
    return at[total[at + block.window[at]] - total[at] == block.window[at]]


def occurrences(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(benchmark place, shard word) of every occurrence of a window; equal windows share an interval of the array."""
    at = present(shard, block)
    lo = search(shard, block, at, block.window[at], False)
    hi = search(shard, block, at, block.window[at], True)
    at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
    n = hi - lo
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), shard.place[shard.order[np.repeat(lo, n) + k]]


def hits(words: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hit, and the distinct (text, item) pairs."""
    shard = make_shard(words, first, block)
    at, place = occurrences(shard, block)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + block.window[at] + block.size - 1, -1)
    text = np.searchsorted(first, place, side="right") - 1
    pairs = np.unique(text * (len(block.ids) + 1) + block.item[at])
    return edge.cumsum()[:-1] > 0, np.stack(np.divmod(pairs, len(block.ids) + 1), axis=1)


_STATE = [T.StructField("__rv_hit", T.BinaryType()), T.StructField("__rv_items", T.ArrayType(T.StringType()))]


def _fold(rows: DataFrame, block: Block, fresh: bool) -> DataFrame:
    """Adds to each row (id, text[, state]) the words hit, as bits, and the items found, of one more block."""
    names = [rows.schema.names[0], "__rv_text", "__rv_hit", "__rv_items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, "__rv_text", SHARD_BYTES):
                words, first = word_hashes(*utf8(part.column(1)))
                hit, pairs = hits(words, first, block)
                bits, items = [], []
                found: list[list[str]] = [[] for _ in range(len(part))]
                for d, i in pairs.tolist():
                    found[d].append(block.ids[i])
                for d in range(len(part)):
                    new = hit[first[d] : first[d + 1]]
                    if not fresh:
                        new = new | np.unpackbits(np.frombuffer(part.column(2)[d].as_py(), np.uint8), count=len(new)).astype(bool)
                        found[d] += part.column(3)[d].as_py()
                    bits.append(np.packbits(new).tobytes())
                    items.append(sorted(set(found[d])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names)

    return in_arrow(rows, run, T.StructType([*rows.schema.fields[:2], *_STATE]))


def scan(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    schema = T.StructType(
        [rows.schema[0], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType()))]
    )
    found = blocks(bench, item_col, item_text, window)
    last, fresh = next(found), True
    for block in found:
        rows, last, fresh = cut(_fold(rows, last, fresh)), block, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, "__rv_text", SHARD_BYTES):
                words, first = word_hashes(*utf8(part.column(1)))
                hit, pairs = hits(words, first, last)
                items: list[set[str]] = [set() for _ in range(len(part))]
                for d, i in pairs.tolist():
                    items[d].add(last.ids[i])
                if not fresh:
                    for d in range(len(part)):
                        items[d] |= set(part.column(3)[d].as_py())
                        own = slice(first[d], first[d + 1])
                        hit[own] |= np.unpackbits(np.frombuffer(part.column(2)[d].as_py(), np.uint8), count=first[d + 1] - first[d]).astype(bool)
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[first[1:]] - total[first[:-1]]
                names = [sorted(x) for x in items]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                        pa.array(n_hit > 0, pa.bool_()),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    schema.names,
                )

    return in_arrow(rows, run, schema)


def remove_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    at = docs.schema.names.index(text)
    for k, block in enumerate(blocks(bench, item_col, item_text, window)):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunked(batch, at, SHARD_BYTES):
                    words, first = word_hashes(*utf8(part.column(at)))
                    hit, _ = hits(words, first, block)
                    total = np.concatenate([[0], np.cumsum(hit)])
                    yield part.filter(pa.array(total[first[1:]] == total[first[:-1]]))

        docs = in_arrow(cut(docs) if k else docs, run, docs.schema)
    return docs


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least: int = 2) -> DataFrame:
    """For each benchmark suffix that shares `least` words or more with a document: item_id, item_word,
    n_words of the longest verbatim match, and one place of it (id, doc_word): that with the smallest id (null first), of one
    document the first.  Beside the two neighbours of its place in a shard's array, all suffixes that share the
    whole match lie in one interval, which is searched for too."""
    out = None
    rows = docs.select(F.col(id_col).alias("__rv_id"), F.col(text).alias("__rv_text"))
    schema = f"item_id string, item_word long, n_words long, doc {rows.schema[0].dataType.simpleString()}, doc_word long"
    for block in blocks(bench, item_col, item_text, window):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunked(batch, "__rv_text", SHARD_BYTES):
                    words, first = word_hashes(*utf8(part.column(1)))
                    shard = make_shard(words, first, block)
                    here = np.zeros(len(block.keys) + 1, bool)
                    here[shard.symbols] = True
                    at = np.flatnonzero(here[block.symbols]) if len(shard.symbols) else np.zeros(0, np.int64)
                    spot = search(shard, block, at, block.left[at], False)
                    best = np.zeros(len(at), np.int64)
                    for near in (spot, spot - 1):
                        e = shard.order[np.clip(near, 0, max(0, len(shard.order) - 1))] if len(shard.order) else near
                        n = common_prefix(shard, e, block, at, block.left[at])
                        n[(near < 0) | (near >= len(shard.order))] = 0
                        best = np.maximum(best, n)
                    ok = np.flatnonzero(best + block.size - 1 >= max(least, block.size))
                    at, best = at[ok], best[ok]
                    lo, hi = search(shard, block, at, best, False), search(shard, block, at, best, True)
                    # Each document's first place of the match: of all places, sorted by document and word.
                    n = hi - lo
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    which, place = np.repeat(np.arange(len(at)), n), shard.place[shard.order[np.repeat(lo, n) + k]]
                    order = np.lexsort((place, which))
                    which, place = which[order], place[order]
                    d = np.searchsorted(first, place, side="right") - 1
                    new = np.ones(len(d), bool)
                    new[1:] = (which[1:] != which[:-1]) | (d[1:] != d[:-1])
                    at, best, d, place = at[which[new]], best[which[new]], d[new], place[new]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.ids[i] for i in block.item[at]], pa.string()), pa.array(block.word[at], pa.int64()), pa.array(best + block.size - 1, pa.int64()), part.column(0).take(pa.array(d, pa.int64())), pa.array(place - first[d], pa.int64())],
                        ["item_id", "item_word", "n_words", "doc", "doc_word"],
                    )

        found = in_arrow(rows, run, schema)
        out = found if out is None else out.unionByName(found)
    # The least of (-n_words, id, word): a struct orders its fields one after another.
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc", "doc_word"))
    return out.groupBy("item_id", "item_word").agg(F.max("n_words").alias("n_words"), best.alias("b")).select("item_id", "item_word", "n_words", F.col("b.doc").alias(id_col), F.col("b.doc_word").alias("doc_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")
