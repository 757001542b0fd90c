"""Quality classifier by importance resampling.

Hashed n-gram generative models (words and runs of marks, and pairs of neighbours) are counted for the raw
text (all documents) and for the target text (documents labelled good).  Every bucket counts by its smoothed
log ratio, whether the target favours or avoids it.  The log importance weight of a passage of PASSAGE words is
the sum of the log ratios of its n-grams, those of pairs times PAIR_SHARE as pairs repeat their words.  A document's
log weight is that of its least passage, so a few words that the target avoids show in a long text
too; half the log of the number of passages is added, as the least of many is lower by chance.

Gumbel noise is added to log weight / TEMPERATURE and the k largest keys are kept: a sample of k documents
without replacement in proportion to their tempered weights.  k is the number of documents, over all data,
whose weight reaches a threshold calibrated on the labelled rows, each weighed without its own
n-grams in the target counts, as if it had no label.  The models are fitted on all raw text and on
MAX_LABELS labelled documents at most, chosen by a hash of their id.

Defined results: null and empty texts have weight 0; the noise depends on text and id
only, so repeated rows are kept or dropped together, and ties at the cut are all
kept; a text of any length is weighed whole; without good labels everything is kept; an id labelled
twice is good if any of its labels is; other columns of the documents are kept by `resample`, whatever
their names (but for those that begin with `__rv_`), and ignored otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bounded_sample, chunked, cut, in_arrow, lower_values, mix, prefix_hash, range_hash, read, utf8

BITS = 18
SMOOTH = 1.0
#: Words of a passage, and what a pair of words counts beside a word.
PASSAGE, PAIR_SHARE = 32, 0.3
MAX_LABELS = 20_000
TEMPERATURE = 0.25
MIN_KEEP = 0.985

_CLASS = np.full(256, 2, np.int8)  # 0 space, 1 word, 2 mark
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_VALUES = lower_values(3)


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, passage) of every word or run of marks and of every pair of neighbours (in the passage of its first
    word); and the passage numbers at which texts begin, n + 1 of them."""
    kind = _CLASS[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] > 0 if len(buf) else np.zeros(0, bool)
    starts, ends = at[:-1][keep], at[1:][keep]
    h = mix(range_hash(prefix_hash(_VALUES[buf]), starts, ends))
    first = np.searchsorted(starts, offs)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    begin = np.concatenate([[0], np.cumsum(-(-np.diff(first) // PASSAGE))])
    passage = begin[text] + (np.arange(len(text)) - first[text]) // PASSAGE
    pair = mix(h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:])
    inside = text[1:] == text[:-1]
    shift = U64(64 - BITS)
    bucket = np.concatenate([(h >> shift).astype(np.int64), (pair[inside] >> shift).astype(np.int64) + (1 << BITS)])
    return bucket, np.concatenate([text, text[:-1][inside]]), np.concatenate([passage, passage[:-1][inside]]), begin


def least_passage(ratio: np.ndarray, passage: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The log weight of each text from the (scaled) log ratios of its n-grams."""
    total, n = np.bincount(passage, ratio, minlength=begin[-1]), np.diff(begin)
    out = np.zeros(len(n))
    if begin[-1]:
        out[n > 0] = np.minimum.reduceat(total, begin[:-1][n > 0]) + 0.5 * np.log(n[n > 0])
    return out


@dataclass(frozen=True)
class QualityModel:
    """Target count of each bucket and the count that the raw model expects; threshold: calibrated; cut: the k-th largest key."""

    target: np.ndarray
    expect: np.ndarray
    threshold: float = -np.inf
    cut: float = -np.inf

    def dense(self) -> np.ndarray:
        """What an n-gram of each bucket adds to a passage's log weight."""
        out = np.log((self.target + SMOOTH) / (self.expect + SMOOTH))
        out[len(out) // 2 :] *= PAIR_SHARE
        return out


def weights(dense: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weight, number of n-grams, and a hash of each text."""
    buf, offs = utf8(texts)
    bucket, text, passage, begin = grams(buf, offs)
    h = mix(range_hash(prefix_hash(_VALUES[buf]), offs[:-1], offs[1:]))
    return least_passage(dense[bucket], passage, begin), np.bincount(text, minlength=len(texts)), h


def held_out_weights(model: QualityModel, texts: pa.Array, good: np.ndarray) -> np.ndarray:
    """Log weights as if no text were in the target: a good one's own n-grams are taken from the target counts."""
    bucket, text, passage, begin = grams(*utf8(texts))
    _, own, times = np.unique(text * len(model.target) + bucket, return_inverse=True, return_counts=True)
    target = model.target[bucket] - np.where(good[text], times[own], 0)
    ratio = np.log((target + SMOOTH) / (model.expect[bucket] + SMOOTH))
    ratio[bucket >= len(model.target) // 2] *= PAIR_SHARE
    return least_passage(ratio, passage, begin)


def gumbel(h: np.ndarray, ids: list) -> np.ndarray:
    own, offs = utf8(pa.array([str(i) for i in ids], pa.string()))
    u = mix(h ^ range_hash(prefix_hash(_VALUES[own]), offs[:-1], offs[1:]))
    return -np.log(-np.log((u.astype(np.float64) + 0.5) / 2.0**64).clip(max=-1e-300))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, max_labels: int) -> DataFrame:
    """(id, __rv_text, __rv_good): all documents, with 1, 0 or null for good, bad or not in the sample of labels."""
    good = F.max(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("__rv_good")
    sample = bounded_sample(labels.where(F.col("quality").isNotNull()).select(F.col(id_col).alias("__rv_id"), "quality", "toxic").groupBy("__rv_id").agg(good), max_labels, "__rv_id")
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    return rows.join(F.broadcast(sample), F.col(id_col) == F.col("__rv_id"), "left").drop("__rv_id")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS, min_keep: float = MIN_KEEP) -> QualityModel:
    rows = labelled(docs, labels, id_col, text, max_labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 << BITS, np.int64), np.zeros(2 << BITS, np.int64)
        for batch in batches:
            for part in chunked(batch, "__rv_text"):
                bucket, text_, _, _ = grams(*utf8(part.column(0)))
                raw += np.bincount(bucket, minlength=len(raw))
                good = part.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
                target += np.bincount(bucket[good[text_]], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], ["bucket", "n_raw", "n_target"])

    counts = cut(rows.select("__rv_text", "__rv_good").transform(in_arrow, count, "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")))
    # There are 2 << BITS buckets whatever the input; both counts of all of them come to the driver.
    got = counts.toArrow()
    raw, target = np.zeros(2 << BITS), np.zeros(2 << BITS, np.int64)
    raw[got["bucket"].to_numpy()], target[got["bucket"].to_numpy()] = got["n_raw"].to_numpy(), got["n_target"].to_numpy()
    if not target.any():
        return QualityModel(np.zeros(2 << BITS, np.int64), np.zeros(2 << BITS))
    share = [target[s].sum() / max(1.0, raw[s].sum()) for s in (slice(0, 1 << BITS), slice(1 << BITS, None))]
    model = QualityModel(target, raw * np.repeat(share, 1 << BITS))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, "__rv_text"):
                good = part.column(1).to_numpy(zero_copy_only=False) == 1
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(held_out_weights(model, part.column(0), good))], ["good", "w"])

    seen = rows.where("__rv_good is not null").select("__rv_text", "__rv_good").transform(in_arrow, weigh, "good int, w double").toArrow()
    return replace(model, threshold=calibrated(seen["good"].to_numpy(), seen["w"].to_numpy(), min_keep))


def calibrated(good: np.ndarray, w: np.ndarray, min_keep: float) -> float:
    """The threshold with the best balanced accuracy of those that keep min_keep of the good rows."""
    if not (good == 1).any() or not (good == 0).any():
        return -np.inf
    best, out = -1.0, -np.inf
    values = np.unique(np.concatenate([[w.min() - 1], w]))
    a, b = np.sort(w[good == 1]), np.sort(w[good == 0])
    for low, high in zip(values[:-1], values[1:]):
        t = (low + high) / 2
        keep, reject = 1 - np.searchsorted(a, t) / len(a), np.searchsorted(b, t) / len(b)
        if keep >= min_keep and keep + reject > best:
            best, out = keep + reject, t
    return float(out)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """id, kept columns, n_grams, log_weight, sample_key (the tempered weight with Gumbel noise)."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"), *keep)
    schema = T.StructType([rows.schema[0], *rows.schema[2:], T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("sample_key", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in chunked(batch, "__rv_text"):
                w, n, h = weights(dense, part.column(1))
                key = w / TEMPERATURE + gumbel(h, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(key, pa.float64())], schema.names)

    return in_arrow(rows, run, schema)


def kth_largest(scored: DataFrame, k: int, column: str = "sample_key", bins: int = 4096) -> float:
    """The k-th largest value, by histograms of ever narrower ranges; a histogram is all that the driver gets."""
    r = scored.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count(column).alias("n")).first()
    if k <= 0 or not r["n"]:
        return np.inf
    if k >= r["n"]:
        return -np.inf
    lo, hi = r["a"], r["b"]
    while hi > lo:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        inside = scored.where(F.col(column).between(lo, hi))
        above = scored.where(F.col(column) > hi).count()
        slot = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        hist = {x["s"]: (x["n"], x["a"], x["b"]) for x in inside.groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for s in sorted(hist, reverse=True):
            n, a, b = hist[s]
            if above + n >= k:
                break
            above += n
        if (a, b) == (lo, hi):
            break
        lo, hi = a, b
    return float(lo)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> tuple[QualityModel, DataFrame]:
    """The model with its cut, and the scored rows it was found from."""
    model = train(docs, labels, id_col, text, **kw)
    scored = cut(score(docs, model, id_col, text))
    k = scored.where(F.col("log_weight") >= F.lit(model.threshold)).count()
    return replace(model, cut=kth_largest(scored, k)), scored


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The sampled documents, with all their columns."""
    model, _ = fit(docs, labels, id_col, text, **kw)
    at_id, at_text = docs.schema.names.index(id_col), docs.schema.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in chunked(batch, at_text):
                w, _, h = weights(dense, part.column(at_text))
                yield part.filter(pa.array(w / TEMPERATURE + gumbel(h, part.column(at_id).to_pylist()) >= model.cut))

    return in_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key, keep: every document and whether the sample has it."""
    model, scored = fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("keep", F.col("sample_key") >= F.lit(model.cut))
