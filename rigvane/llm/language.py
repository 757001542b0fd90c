"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows,
each filter keeps its maximum over the window, and a softmax layer gives the
languages.  Training is plain numpy (Adam on cross-entropy) over windows of a
bounded sample of labelled documents; a text's result joins all its windows.

Defined results: a null text, or one without a letter, is `und` with score 0, as
is everything if no labelled document exists.  A text of any length is read whole, in windows; of languages with
equal scores the first by name is taken.  Documents without an id are held
out.  Repeated rows get the same result each (and count once in training); other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, chunked, in_arrow, read, utf8

#: Bytes of a window; filter widths, and filters of each width; floats of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 5), 16, 8
#: Labelled documents that training looks at, about, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 3000, 4


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray  # [256, EMBED]
    conv: np.ndarray  # [max width * EMBED, filters]; narrower filters have zeros
    bias: np.ndarray
    out: np.ndarray  # [filters, languages]
    out_bias: np.ndarray


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows, zero-padded: bytes [n, WINDOW], each window's text, each window's length."""
    lens = np.diff(offs)
    n = -(-lens // WINDOW)
    text = np.repeat(np.arange(len(lens)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = offs[text] + k * WINDOW
    size = np.minimum(WINDOW, offs[text + 1] - at)
    idx = at[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, buf[np.minimum(idx, max(0, len(buf) - 1))], 0).astype(np.uint8), text, size


def pooled(net: ByteNet, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maxima of the filters [n, filters], where they are, and the embedded bytes by place."""
    wide = max(WIDTHS)
    e = net.embed[np.pad(x, ((0, 0), (0, wide - 1)))].reshape(len(x), -1)
    cols = np.lib.stride_tricks.sliding_window_view(e, wide * EMBED, axis=1)[:, ::EMBED]
    cols = np.ascontiguousarray(cols, dtype=np.float32)
    h = (cols.reshape(-1, wide * EMBED) @ net.conv).reshape(len(x), x.shape[1], -1)
    top = h.max(axis=1)
    return np.maximum(top + net.bias, 0), h, cols


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def scores(net: ByteNet, x: np.ndarray, rows: int = 128) -> np.ndarray:
    """Log-probabilities of each window."""
    out = [log_softmax(pooled(net, x[i : i + rows])[0] @ net.out + net.out_bias) for i in range(0, len(x), rows)]
    return np.concatenate(out) if out else np.zeros((0, len(net.langs)), np.float32)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 3) -> ByteNet:
    """Adam on cross-entropy; in every other batch windows are cut to a random length, as texts may be short."""
    rng, wide, nf = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    f32 = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    net = ByteNet(langs, f32(256, EMBED) * 0.5, f32(wide * EMBED, nf) * 0.15 * mask, np.zeros(nf, np.float32), f32(nf, len(langs)) * 0.1, np.zeros(len(langs), np.float32))
    params = [net.embed, net.conv, net.bias, net.out, net.out_bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows, step = order[at : at + batch], step + 1
            part = x[rows].copy()
            if step % 2:
                part[np.arange(WINDOW) >= rng.integers(8, WINDOW, len(part))[:, None]] = 0
            p, h, cols = pooled(net, part)
            g = np.exp(log_softmax(p @ net.out + net.out_bias))
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            gp = (g @ net.out.T) * (p > 0)
            peak = h.argmax(axis=1)
            patch = cols[np.arange(len(rows))[:, None], peak]  # [n, filters, wide * EMBED]
            g_conv = np.einsum("nfk,nf->kf", patch, gp) * mask
            g_cols = gp[:, :, None] * (net.conv * mask).T[None]
            g_embed = np.zeros_like(net.embed)
            padded = np.pad(part, ((0, 0), (0, wide - 1)))
            bytes_at = padded[np.arange(len(rows))[:, None, None], peak[:, :, None] + np.arange(wide)]
            np.add.at(g_embed, bytes_at.ravel(), g_cols.reshape(-1, EMBED))
            for q, grad, m in zip(params, (g_embed, g_conv, gp.sum(axis=0), p.T @ g, g.sum(axis=0)), moments):
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad * grad
                q -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(rows: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = TRAIN_DOCS) -> ByteNet | None:
    """Fits the network to about max_docs rows at most that have a text and a language; None if there are none."""
    rows = rows.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t <> '' and l is not null")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, doc, _ = windows(*utf8(batch.column(0)))
            first = np.searchsorted(doc, np.arange(len(batch)))
            n = np.bincount(doc, minlength=len(batch))
            take = np.unique(np.concatenate([first + n * k // TRAIN_WINDOWS for k in range(TRAIN_WINDOWS)])) if len(x) else first[:0]
            yield pa.RecordBatch.from_arrays([pa.array([x[i].tobytes() for i in take], pa.binary()), batch.column(1).take(pa.array(doc[take], pa.int64()))], ["x", "l"])

    got = sorted((r["l"], bytes(r["x"])) for r in in_arrow(bounded_sample(rows, max_docs, "t", "l"), pick, "x binary, l string").collect())
    if not got:
        return None
    langs = sorted({g[0] for g in got})
    x = np.frombuffer(b"".join(g[1] for g in got), np.uint8).reshape(-1, WINDOW)
    return fit(x, np.array([langs.index(g[0]) for g in got]), langs)


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score (the probability of lang_pred from the mean log-probabilities of all windows)."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__rv_letter"))
    schema = T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if net is None:
        return rows.select(F.col(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, "__rv_text"):
                x, doc, size = windows(*utf8(part.column(1)))
                total = np.zeros((len(part), len(net.langs)))
                np.add.at(total, doc, scores(net, x) * size[:, None])
                p = np.exp(log_softmax(total / np.maximum(1, np.bincount(doc, size, minlength=len(part)))[:, None]))
                best, letter = p.argmax(axis=1), part.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([net.langs[b] if ok else "und" for b, ok in zip(best, letter)], pa.string()), pa.array(np.where(letter, p.max(axis=1), 0.0), pa.float64())], schema.names
                )

    return in_arrow(rows, run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = train(docs.where(~held_out()))
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
