"""Document fingerprints by winnowing.

All k-grams of code points are hashed; in each window of WINDOW consecutive
hashes (of 32 bits) the smallest is chosen, the rightmost one on ties, and kept with its
position.  Two texts that share GRAM + WINDOW - 1 code points share a chosen hash;
nothing shorter than GRAM is matched.  A text shorter than GRAM is one gram, one with fewer
grams than WINDOW is one window.

Defined results: null and empty texts have the empty fingerprint, and two empty
fingerprints are alike (1.0), an empty and a non-empty one are not (0.0).  For
neighbours, rows are ordered by id (null first), equal ids by text; a single row is its own
neighbour; a text of any length is fingerprinted whole; repeated rows are each other's neighbours; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, in_arrow, mix, prefix_hash, range_hash, read

GRAM, WINDOW = 20, 41


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def chosen(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the rightmost minima of all windows, by block-wise running minima."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    # A later place wins a tie: the place, counted down, is below the hash's upper half.
    key = (hashes & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    blocks = -(-n // window)
    pad = np.full(blocks * window, U64(0xFFFFFFFFFFFFFFFF))
    pad[:n] = key
    pad = pad.reshape(blocks, window)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - window + 1], ahead[window - 1 : n])
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (U64(0xFFFFFFFF) - (least & U64(0xFFFFFFFF))).astype(np.int64)


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(upper 32 bits of the hash, position) of each chosen k-gram."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(gram, n)
    prefix = prefix_hash(mix(points.astype(np.uint64) + U64(0x51ED)))
    at = np.arange(n - k + 1)
    # What is written decides: ties are ties of the upper half.
    h = mix(range_hash(prefix, at, at + k)) & U64(0xFFFFFFFF00000000)
    pos = chosen(h, window)
    return (h[pos] >> U64(32)).astype(np.int64), pos


def written(hashes: np.ndarray, pos: np.ndarray) -> str:
    return " ".join(f"{h:08x}:{p}" for h, p in zip(hashes.tolist(), pos.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of chosen hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """id, n_chars, fingerprint ("hash:position" of each chosen gram)."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                points = [code_points(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(p) for p in points], pa.int64()), pa.array([written(*winnow(p, gram, window)) for p in points], pa.string())], schema.names)

    return in_arrow(rows, run, schema)


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(__rv_part, id, __rv_text, __rv_mark): rows dealt to ranges of ids; the rows that begin a range are
    also in the range before it, marked 1, so that every row's successor is in its own range.

    Only the bounds of the ranges (one id for each) reach the driver."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.col(id_col).alias("i"))
    cuts = ids.agg(F.percentile_approx("i", [k / parts for k in range(1, parts)], 10_000).alias("c")).first()["c"] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    own = sum((F.when(F.col(id_col) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)) if len(cuts) <= 8 else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(id_col)))
    own = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(own)
    firsts = {r["p"]: (r["m"], r["z"]) for r in ids.withColumnRenamed("i", id_col).groupBy(own.alias("p")).agg(F.min(id_col).alias("m"), F.max(F.col(id_col).isNull()).alias("z")).collect()}
    full = sorted(firsts)
    out = rows.select(own.alias("__rv_part"), id_col, "__rv_text", F.lit(0).alias("__rv_mark"))
    borders = []
    for k, p in enumerate(full):
        least, has_null = firsts[p]
        borders.append((full[k - 1], None if has_null else least, has_null))
    pairs = docs.sparkSession.createDataFrame(borders, T.StructType([T.StructField("__rv_part", T.IntegerType()), T.StructField("__rv_key", rows.schema[0].dataType), T.StructField("__rv_null", T.BooleanType())]))
    first = rows.join(F.broadcast(pairs), F.col(id_col).eqNullSafe(F.col("__rv_key"))).select("__rv_part", id_col, "__rv_text", F.lit(1).alias("__rv_mark"))
    return out.unionByName(first)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """For each row: its fingerprint, that of the edited text (the second half replaced by the start of the
    next row's text), and their likeness; the next row is the one with the next id, after the last the first."""
    spark = docs.sparkSession
    rows = with_next(docs, id_col, text, parts)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Marked rows come after all others: the successor of a range's last row, and the first of them only.
    dealt = rows.repartitionById(n, F.col("__rv_part")).sortWithinPartitions("__rv_part", "__rv_mark", F.col(id_col).asc_nulls_first(), "__rv_text")
    schema = T.StructType(
        [rows.schema[id_col], T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, id, text, its hashes and positions) of the row that waits for its successor
        out: list[list] = [[] for _ in schema.names]
        size = 0
        for batch in batches:
            for i in range(len(batch)):
                part, own, t, mark = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or "", batch.column(3)[i].as_py()
                points = code_points(t)
                print_ = winnow(points, gram, window) if held is not None or not mark else None
                if held is not None and held[0] == part:
                    _, id_, old, old_print = held
                    half = len(old) // 2
                    edited = np.concatenate([old[: len(old) - half], points[:half]])
                    edit_print = winnow(edited, gram, window)
                    row = (id_, len(old), hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest(), written(*old_print), written(*edit_print), likeness(old_print[0], edit_print[0]), likeness(old_print[0], print_[0]))
                    for c, v in zip(out, row):
                        c.append(v)
                    size += len(old)
                    if size >= 1 << 20 or len(out[0]) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema.names)
                        out, size = [[] for _ in schema.names], 0
                held = None if mark else (part, own, points, print_)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return in_arrow(dealt, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "documents"))
