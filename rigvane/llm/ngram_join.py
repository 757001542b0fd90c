"""N-gram Jaccard join by vertical partitioning.

A document's set is that of its word n-grams, as 48-bit hashes.  The n-grams have
one global order: rarest first (by the number of distinct sets that hold them),
equals by hash; n-grams that a sample finds in very many sets come last.
Documents with equal sets are one node.

Candidates share an n-gram of their prefixes in that order (the first
n - ceil(t * n) + 1), which loses no pair of similarity t.  The order is cut into
fragments; overlaps are counted by fragment and summed per pair.  Since
only reachability counts, each n-gram's nodes are first compared with one centre;
after that, pairs that are not yet connected are compared, all of them, unless sizes,
numbers of unshared n-grams and bitmaps prove that they cannot be similar enough.

How the data moves: n-grams travel once, packed by range of hash (about five bytes
each), to find those that two nodes share; only these travel on.  No range holds
an n-gram of very many documents, as those are known beforehand and stay with
their node.  Nothing is collected but that bounded list.

Defined results: null texts and texts without words have the empty set, are linked with
nothing and are their own component; rows without an id take part, and a component
of such rows only has a null id; repeated rows are one node; texts of any length are cut into all their n-grams; of the ids
of a component the smallest is taken; an empty table gives an empty result; other
columns are ignored by `classes` and kept by `one_of_each`, whatever their names (but for those that begin with `__rv_`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bounded_sample, byte_set, chunked, cut, in_arrow, lower_values, mix, prefix_hash, range_hash, read, utf8, word_bounds
from .graph import components

#: Documents sampled to find very common n-grams: so many, or one of SAMPLE_EVERY if that is more; and the sets of the sample that
#: make one so.  An n-gram of more than about SAMPLE_EVERY * SAMPLE_SETS sets is one at any size of the input.
SAMPLE_DOCS, SAMPLE_EVERY, SAMPLE_SETS = 20_000, 5_000, 40
#: N-grams that a range of hashes holds, about; n-grams packed together.
RANGE_SIZE, PACK_SIZE = 400_000, 400_000
#: Ranges that packed n-grams are dealt to at once; if there are more, they are dealt to coarse ranges first.
FAN_OUT = 4_096
#: Where the global order is cut: numbers of sets (the last fragment has the very common n-grams).
PIVOTS = (3, 9, 65)
#: 64-bit words of a node's bitmap.
WORDS = 16
COMMON = 0x7FFF  # the order's class of very common n-grams

_WORD = byte_set([(0x20, 0x20), (0x09, 0x0D)], inverted=True)
_VALUES = lower_values(7)
_STEP = U64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams (48-bit hashes, ascending) of each text, one text after another, and n + 1 offsets."""
    buf, offs = utf8(texts)
    starts, ends, first = word_bounds(buf, offs, _WORD)
    h = mix(range_hash(prefix_hash(_VALUES[buf]), starts, ends))
    n_words = np.diff(first)
    gram = h.copy()
    for k in range(1, min(size, len(h))):
        gram[: len(h) - k] = gram[: len(h) - k] * _STEP + h[k:]
    text = np.repeat(np.arange(len(texts)), n_words)
    whole = np.arange(len(h)) + size <= first[1:][text] if len(h) else np.zeros(0, bool)
    grams, owner = mix(gram[whole]) >> U64(16), text[whole]
    for d in np.flatnonzero((n_words > 0) & (n_words < size)).tolist():  # the whole sequence is one n-gram
        x = np.full(1, n_words[d], np.uint64)
        for k in range(first[d], first[d + 1]):
            x = x * _STEP + h[k : k + 1]
        grams, owner = np.append(grams, mix(x) >> U64(16)), np.append(owner, d)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1))


def node_ids(grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal sets have equal ids."""
    total = np.concatenate([[U64(0)], np.cumsum(mix(grams + U64(1)))])
    n = np.diff(offs).astype(np.uint64)
    return mix(total[offs[1:]] - total[offs[:-1]] + n * _STEP).view(np.int64)


def pack(a: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 20_000):
            yield from chunked(batch.slice(at, 20_000), column)


def common_grams(rows: DataFrame, size: int, docs: int, sets: int) -> np.ndarray:
    """N-grams that `sets` or more of the sampled documents' distinct sets hold; at most sampled documents * mean size / sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 0):
            grams, offs = shingle_sets(part.column(0), size)
            nodes = np.repeat(node_ids(grams, offs), np.diff(offs))
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(nodes, pa.int64())], ["gram", "node"])

    # A sample by text has copies of a text together, and each text once.
    texts = rows.select("__rv_text").where("__rv_text is not null")
    sample = bounded_sample(texts, max(docs, texts.count() // SAMPLE_EVERY), "__rv_text")
    found = in_arrow(sample, run, "gram long, node long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= sets)
    return np.sort(np.array([r["gram"] for r in found.select("gram").collect()], np.uint64))


def membership(rows: DataFrame, size: int, common: np.ndarray) -> DataFrame:
    """(id, n_shingles, node, common): each row's node and the very common n-grams of its set."""
    schema = T.StructType([rows.schema[0], T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("common", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1):
            grams, offs = shingle_sets(part.column(1), size)
            n = np.diff(offs)
            hit = np.flatnonzero(np.isin(grams, common)) if len(common) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, offs), pa.int32()), pa.array(grams[hit].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node_ids(grams, offs), pa.int64(), mask=n == 0), lists], schema.names)

    return in_arrow(rows, run, schema)


PACKS = "range int, grams binary, owners binary, nodes binary"


def _split(held: list[tuple[np.ndarray, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """The n-grams and their nodes, packed by range of hash."""
    grams, nodes = (np.concatenate(x) for x in zip(*held))
    names, owner = np.unique(nodes, return_inverse=True)
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order].astype(np.uint32)
    if len(grams):  # sets that occur twice
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    # Range r begins at the hash r * 2**48 / ranges, rounded up; of those only the ranges that occur are looked at.
    number = np.unique(((grams >> U64(16)) * U64(ranges)) >> U64(32)) if len(grams) else np.zeros(0, np.uint64)
    at = np.searchsorted((grams >> U64(16)) * U64(ranges) >> U64(32), np.append(number, U64(ranges)))
    out: list[list] = [[], [], [], []]
    for r, a, b in zip(number.tolist(), at[:-1].tolist(), at[1:].tolist()):
        used, local = np.unique(owner[a:b], return_inverse=True)
        for c, v in zip(out, (r, pack(np.diff(grams[a:b], prepend=U64(0))), pack(local.astype(np.uint32)), names[used].tobytes())):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["range", "grams", "owners", "nodes"])


def _unpacked(part: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for g, o, n in zip(part.column("grams"), part.column("owners"), part.column("nodes")):
        yield np.cumsum(unpack(g.as_py(), np.uint64), dtype=np.uint64), np.frombuffer(n.as_py(), np.int64)[unpack(o.as_py(), np.uint32)]


def packed(rows: DataFrame, size: int, common: np.ndarray, ranges: int) -> DataFrame:
    """(range, grams, owners, nodes): all other n-grams with their nodes, packed by range of hash."""
    levels = [ranges]
    while levels[-1] > FAN_OUT:
        levels.append(-(-levels[-1] // FAN_OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in _parts(batches, 0):
            grams, offs = shingle_sets(part.column(0), size)
            nodes = np.repeat(node_ids(grams, offs), np.diff(offs))
            keep = ~np.isin(grams, common) if len(common) else slice(None)
            held.append((grams[keep], nodes[keep]))
            n += len(held[-1][0])
            if n >= PACK_SIZE:
                yield _split(held, levels[-1])
                held, n = [], 0
        if n:
            yield _split(held, levels[-1])

    out = in_arrow(rows.select("__rv_text"), run, PACKS)
    for finer in levels[-2::-1]:

        def deal(batches: Iterator[pa.RecordBatch], ranges: int = finer) -> Iterator[pa.RecordBatch]:
            held, n, own = [], 0, None
            for batch in batches:
                for i, r in enumerate(batch.column(0).to_pylist()):
                    if n and (r != own or n >= PACK_SIZE):
                        yield _split(held, ranges)
                        held, n = [], 0
                    held += _unpacked(batch.slice(i, 1))
                    own, n = r, n + len(held[-1][0])
            if n:
                yield _split(held, ranges)

        out = in_arrow(out.repartition("range").sortWithinPartitions("range"), deal, PACKS)
    return out


def shared(packs: DataFrame) -> DataFrame:
    """(node, key) of every n-gram that two or more nodes hold; key = its number of nodes (capped), then its hash."""

    def run(table: pa.Table) -> pa.Table:
        g, n = (np.concatenate(x) for x in zip(*_unpacked(table)))
        order = np.argsort(g)
        g, n = g[order], n[order]
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        keep = same[1:] | same[:-1]
        g, n = g[keep], n[keep]
        order = np.lexsort((n, g))
        g, n = g[order], n[order]
        if len(g):
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (n[1:] != n[:-1])
            g, n = g[new], n[new]
        _, at, count = np.unique(g, return_inverse=True, return_counts=True)
        count = count[at] if len(g) else count
        ok = count > 1
        key = (np.minimum(count[ok], COMMON - 1).astype(np.uint64) << U64(48)) | g[ok]
        return pa.table({"node": pa.array(n[ok], pa.int64()), "key": pa.array(key.astype(np.int64), pa.int64())})

    return packs.groupBy("range").applyInArrow(run, "node long, key long")


def with_bits(nodes: DataFrame) -> DataFrame:
    """Adds columns b0, b1, ...: a bitmap of the n-grams in `keys`."""
    schema = T.StructType([*nodes.schema, *(T.StructField(f"b{i}", T.LongType()) for i in range(WORDS))])
    at = nodes.schema.names.index("keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            bit = (mix(lists.flatten().to_numpy().view(np.uint64)) >> U64(20)).astype(np.int64) % (64 * WORDS)
            words = np.zeros((len(batch), WORDS), np.uint64)
            np.bitwise_or.at(words.reshape(-1), row * WORDS + bit // 64, U64(1) << (bit % 64).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(WORDS))], schema.names)

    return in_arrow(nodes, run, schema)


def _possible(percent: int, a: str, b: str) -> Column:
    """Whether two nodes can be similar enough: each one's overlap is at most its n n-grams, less the u held by no
    other node, less one for each bit that the other's bitmap lacks."""
    bits = lambda x, y: sum((F.bit_count(F.col(f"{x}b{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}b{i}")))) for i in range(WORDS)), F.lit(0))
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    plain = F.least(n_a - F.col(f"{a}u"), n_b - F.col(f"{b}u"))
    most = F.least(n_a - F.col(f"{a}u") - bits(a, b), n_b - F.col(f"{b}u") - bits(b, a))
    enough = lambda m: F.lit(100) * m >= F.lit(percent) * (n_a + n_b - m)
    return enough(plain) & enough(most)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches percent: overlaps are counted by fragment and summed."""
    cuts = [0, *(p << 48 for p in PIVOTS), COMMON << 48]
    piece = lambda i: F.filter("keys", lambda k: (k >= cuts[i]) & ((k < cuts[i + 1]) if i + 1 < len(cuts) else F.lit(True)))
    pieces = F.array(*[F.struct(F.lit(i).alias("f"), piece(i).alias("keys")) for i in range(len(cuts))])
    frags = nodes.select("node", F.explode(pieces).alias("p")).select("node", F.col("p.f").alias("f"), F.col("p.keys").alias("keys")).where(F.size("keys") > 0)
    left = pairs.join(frags.withColumnsRenamed({"node": "a", "keys": "keys_a"}), "a")
    both = left.join(frags.withColumnsRenamed({"node": "b", "keys": "keys_b"}), ["b", "f"])
    overlap = both.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("keys_a", "keys_b"))).alias("i"))
    sizes = nodes.select("node", "n")
    out = overlap.join(sizes.withColumnsRenamed({"node": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "n_b"}), "b")
    return out.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")


def links(rows: DataFrame, members: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame | None:
    """(node, root): connected components of the nodes that have a link; None if there is no candidate."""
    distinct = members.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.first("common").alias("common"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    grams = shared(packed(rows, size, common, max(1, -(-total // RANGE_SIZE)))).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    none = F.array().cast("array<bigint>")
    hot = F.transform("common", lambda g: g.bitwiseOR(F.lit(COMMON << 48)))
    nodes = distinct.join(grams, "node", "left").select("node", "n", F.concat(F.coalesce("keys", none), F.sort_array(hot)).alias("keys"))
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    nodes = nodes.withColumn("u", F.col("n") - F.size("keys")).withColumn("p", (prefix - F.col("u")).cast("int")).where("p > 0 and size(keys) > 0")
    nodes = cut(with_bits(nodes))
    bits = [f"b{i}" for i in range(WORDS)]
    entries = nodes.select("node", "n", "u", F.explode(F.slice("keys", 1, F.col("p"))).alias("key"))
    # N-grams that the same nodes hold (a shared passage has many) are one list.
    lists = entries.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.min(F.struct("u", "node", "n")).alias("centre")).where("c > 1")
    lists = cut(lists.groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.min("centre").alias("centre")).select("key", "centre"))
    if lists.isEmpty():
        return None
    of_list = cut(entries.join(lists, "key").select("key", "node", F.col("centre.node").alias("centre")))
    centre = nodes.select("n", "u", *bits, "node").toDF(*(f"c_{c}" for c in ("n", "u", *bits)), "centre")
    pairs = of_list.where("centre <> node").select("node", "centre").distinct()
    pairs = pairs.join(nodes.select("node", "n", "u", *bits), "node").join(centre, "centre").where(_possible(percent, "", "c_"))
    stars = cut(pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())
    linked = cut(verified(stars, nodes, percent))
    roots = components(linked)
    known = of_list.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = known.join(roots.toDF("centre", "centre_root"), "centre", "left").withColumn("centre_root", F.coalesce("centre_root", "centre"))
    known = known.select("key", "node", "root", (F.col("root") != F.col("centre_root")).alias("apart"))
    # Lists whose nodes are all connected have no open pair.
    open_keys = known.where("apart").select("key").distinct()
    known = cut(known.join(open_keys, "key", "left_semi").join(nodes.select("node", "n", "u", *bits), "node"))
    mine, other = known.where("apart").toDF(*(f"m_{c}" for c in known.columns)), known.toDF(*(f"o_{c}" for c in known.columns))
    once = ~F.col("o_apart") | (F.col("m_node") < F.col("o_node"))
    open_ = mine.join(other, (F.col("m_key") == F.col("o_key")) & (F.col("m_root") != F.col("o_root")) & once & _possible(percent, "m_", "o_"))
    rest = open_.select(F.least("m_node", "o_node").alias("a"), F.greatest("m_node", "o_node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = cut(verified(cut(rest), nodes, percent))
    return roots if more.isEmpty() else components(linked.unionByName(more))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    common = common_grams(rows, size, SAMPLE_DOCS, SAMPLE_SETS)
    members = cut(membership(rows, size, common))
    roots = links(rows, members, size, percent, common)
    ids = members.where("node is not null").groupBy("node").agg(F.min(id_col).alias("__rv_least"))
    if roots is not None:
        ids = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = ids.groupBy("root").agg(F.min("__rv_least").alias("__rv_first"))
        ids = ids.join(least, "root").select("node", F.col("__rv_first").alias("component_id"))
    else:
        ids = ids.select("node", F.col("__rv_least").alias("component_id"))
    out = members.select(id_col, "n_shingles", "node").join(ids, "node", "left")
    return out.select(id_col, "n_shingles", F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of which each component keeps the one with the smallest id.

    Rows without an id all stay.  Rows that share an id stay or go together, but of rows that agree in id and text
    one stays, whatever their other columns (which of them is not defined)."""
    found = classes(docs, id_col, text, size, percent)
    stay = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__rv_stay")).distinct()
    kept = docs.join(stay, F.col(id_col) == F.col("__rv_stay"), "left_semi")
    return kept.dropDuplicates([id_col, text]).select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
