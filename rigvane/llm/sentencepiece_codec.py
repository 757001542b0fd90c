"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

The pieces come from a SentencePiece model file, whose path is a parameter.  If
the file holds merge ranks instead of log-probabilities, the score of a piece is
the log of a Zipf law over its rank.  Characters without a piece fall back to
bytes.  The white-space marker of the pieces stands for a space, and texts get
one in front; a marker character in the text itself is encoded as bytes, so
decoding gives back every text exactly.

No piece of a usual model has a marker after another character; then the best
segmentation of a text is that of its words, one after another, and each distinct
word of a chunk is segmented once, all of one length together.  For other models
the text is one word.  A word of more than LONG bytes is cut further where no piece
has its two neighbouring characters side by side: no piece can reach over such a place.

Defined results: a null text has null ids and decodes to null; an empty text has
no ids; texts of any length are encoded whole; of segmentations with equal scores the one whose last
pieces are the longest is taken (the first of the best found for each place, beginnings in ascending order), up to rounding; repeated rows get the same result each; other columns are kept by
`encode` and `decode` (a column named like an output is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, in_arrow, read

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Bytes of a word that is not cut further; words of one length that are worth a vectorised step.
LONG, TOGETHER = 48, 12
_WORD = re.compile(" *[^ ]+| +")


def fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Pieces:
    """base, check, value: the double array over UTF-8 bytes; value is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    bytes_of: list[bytes]
    byte_id: np.ndarray
    unknown: float
    longest: int
    by_word: bool
    side_by_side: frozenset[str]  # pairs of characters that a piece has

    @cached_property
    def walk(self) -> tuple[list[int], list[int], list[int], list[float]]:
        """The double array and the scores as lists, for single steps."""
        return self.base.tolist(), self.check.tolist(), self.value.tolist(), self.score.tolist()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "walk"}


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State s moves by byte c to base[s] + c, if check of that place is s.  Children are placed first-fit."""
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for key, i in keys.items():
        node = 0
        for c in key:
            if (n := children[node].get(c)) is None:
                n = children[node][c] = len(children)
                children.append({})
                ids.append(-1)
            node = n
        ids[node] = i
    size = 4 * len(children) + 1024
    base, check, value, used = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64), bytearray(size)
    place, queue, start = {0: 0}, [0], 1
    used[0], check[0] = 1, -2
    for node in queue:
        own = sorted(children[node])
        if not own:
            continue
        p = used.find(0, max(1 if len(own) == 1 else start, own[0] + 1))
        first, tried = p, 0
        while any(used[p + c - own[0]] for c in own[1:]):
            p, tried = used.find(0, p + 1), tried + 1
        if tried > 50 and tried > (p - first) // 20:  # too full for families: begin later next time
            start = p
        s = place[node]
        base[s] = p - own[0]
        for c in own:
            t, child = p - own[0] + c, children[node][c]
            check[t], value[t], place[child], used[t] = s, ids[child], t, 1
            queue.append(child)
    return base, check, value


def load(path: str = MODEL_PATH) -> Pieces:
    with open(path, "rb") as f:
        data = f.read()
    rows, model_type = [], 1
    for number, _, value in fields(data):
        if number == 1:
            got = {k: v for k, _, v in fields(value)}
            rows.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == 2:
            model_type = {k: v for k, _, v in fields(value)}.get(3, 1)
    return make(rows, ranks=model_type != 1)


def make(rows: list[tuple[str, float, int]], ranks: bool = False) -> Pieces:
    """rows: (piece, score, type) by id.  ranks: the scores are minus the ranks of merges."""
    score = np.array([s for _, s, _ in rows])
    if ranks:
        score = -np.log(1.0 - np.minimum(score, 0.0))
        score -= np.log(np.exp(score).sum())
    keys, byte_id, out = {}, np.full(256, -1, np.int64), []
    for i, (piece, _, kind) in enumerate(rows):
        raw = piece.replace(MARKER, " ").encode()
        if kind == BYTE:
            byte_id[int(piece[3:5], 16)] = i
            raw = bytes([int(piece[3:5], 16)])
        elif kind in (NORMAL, USER_DEFINED):
            keys[raw] = i
        else:
            raw = b""
        out.append(raw)
    if (byte_id < 0).any():
        raise ValueError("the model has no byte pieces")
    normal = [score[i] for i in keys.values()]
    base, check, value = double_array(keys)
    by_word = not any(re.search(rb"[^ ] ", k) for k in keys)
    pairs = frozenset(t[i : i + 2] for t in (k.decode("utf-8", "replace") for k in keys) for i in range(len(t) - 1))
    return Pieces(base, check, value, score, out, byte_id, float(min(normal)) - UNKNOWN_PENALTY, max(map(len, keys)), by_word, pairs)


def cut_word(word: str, p: Pieces) -> list[str]:
    """The parts of a word that no piece can join."""
    at = [0, *(i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in p.side_by_side), len(word)]
    return [word[a:b] for a, b in zip(at, at[1:])]


def segment(words: list[bytes], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of each word: piece ids, one word after another, and n + 1 offsets."""
    lens = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lens, kind="stable")
    per_word: list[np.ndarray | None] = [None] * len(words)
    counts = np.zeros(len(words), np.int64)
    at = 0
    while at < len(order):
        length = int(lens[order[at]])
        end = int(np.searchsorted(lens[order], length, side="right"))
        end = min(end, at + max(1, (1 << 19) // max(1, length)))
        rows, at = order[at:end], end
        if len(rows) < TOGETHER:
            for i in rows.tolist():
                per_word[i] = _segment_one(words[i], p)
                counts[i] = len(per_word[i])
            continue
        flat, n = _segment_same(np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(len(rows), length), p)
        counts[rows] = n
        for i, ids in zip(rows.tolist(), np.split(flat, np.cumsum(n)[:-1])):
            per_word[i] = ids
    offs = np.concatenate([[0], np.cumsum(counts)])
    return np.concatenate([np.zeros(0, np.int64), *per_word]), offs


def _segment_one(word: bytes, p: Pieces) -> np.ndarray:
    """The same Viterbi for one word: the trie is walked from each place that a segmentation can reach."""
    base, check, value, score = p.walk
    n = len(word)
    best, size, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        own = best[i]
        if own == -math.inf:
            continue
        lead = word[i]
        chars = 1 if lead < 0x80 else 0 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        single, state = False, 0
        for j in range(i, n):
            to = base[state] + word[j]
            if check[to] != state:
                break
            state = to
            if (v := value[to]) >= 0:
                single = single or j + 1 - i == chars
                if own + score[v] > best[j + 1]:
                    best[j + 1], size[j + 1], piece[j + 1] = own + score[v], j + 1 - i, v
        if not single and own + p.unknown > best[i + chars]:
            best[i + chars], size[i + chars], piece[i + chars] = own + p.unknown, chars, -1
    out, at = [], n
    while at:
        k = size[at]
        out += [piece[at]] if piece[at] >= 0 else [int(p.byte_id[b]) for b in reversed(word[at - k : at])]
        at -= k
    return np.array(out[::-1], np.int64)


def _segment_same(text: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi for words of one length, all at once."""
    n, length = text.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    size, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int64)
    chars = np.select([text < 0x80, text < 0xC0, text < 0xE0, text < 0xF0], [1, 0, 2, 3], 4)
    for i in range(length):
        rows = np.flatnonzero(best[i] > -np.inf)
        single = np.zeros(n, bool)
        state, own = np.zeros(len(rows), np.int64), best[i][rows]
        live = rows
        for j in range(i, min(length, i + p.longest)):
            to = p.base[state] + text[live, j]
            ok = p.check[to] == state
            if not ok.all():
                live, to, own = live[ok], to[ok], own[ok]
            if not len(live):
                break
            state = to
            v = p.value[state]
            end = np.flatnonzero(v >= 0)
            if len(end):
                r = live[end]
                single[r[chars[r, i] == j + 1 - i]] = True
                s = own[end] + p.score[v[end]]
                better = s > best[j + 1][r]
                r, e = r[better], end[better]
                best[j + 1][r], size[j + 1][r], piece[j + 1][r] = s[better], j + 1 - i, v[e]
        rows = rows[~single[rows]]
        if len(rows):
            to = i + chars[rows, i]
            s = best[i][rows] + p.unknown
            better = s > best[to, rows]
            r, to = rows[better], to[better]
            best[to, r], size[to, r], piece[to, r] = s[better], chars[r, i], -1
    ids = np.zeros((length + 1, n), np.int64)
    count, at, live = np.zeros(n, np.int64), np.full(n, length, np.int64), np.arange(n) if length else np.zeros(0, np.int64)
    while len(live):
        k, to = size[at[live], live], at[live]
        v = piece[to, live]
        known = live[v >= 0]
        ids[count[known], known] = v[v >= 0]
        count[known] += 1
        for r in live[v < 0].tolist():  # bytes, last first, as all is turned round below
            for b in text[r, at[r] - size[at[r], r] : at[r]][::-1].tolist():
                ids[count[r], r] = p.byte_id[b]
                count[r] += 1
        at[live] -= k
        live = live[at[live] > 0]
    col = np.repeat(np.arange(n), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return ids[count[col] - 1 - k, col], count


def encode_texts(texts: list[str | None], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and n + 1 offsets."""
    index: dict[str, int] = {}
    numbers, n_words = [], []
    for t in texts:
        words = [] if not t else _WORD.findall(" " + t) if p.by_word else [" " + t]
        if any(len(w) > LONG for w in words):
            words = [x for w in words for x in (cut_word(w, p) if len(w) > LONG else (w,))]
        numbers += [index.setdefault(w, len(index)) for w in words]
        n_words.append(len(words))
    flat, offs = segment([w.encode() for w in index], p)
    w = np.array(numbers, np.int64)
    n = (offs[1:] - offs[:-1])[w]
    ends = np.cumsum(n)
    k = np.arange(n.sum()) - np.repeat(ends - n, n)
    ids = flat[np.repeat(offs[w], n) + k]
    total = np.concatenate([[0], ends])
    return ids, total[np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)]


class Decoder:
    """Joins the bytes of pieces and takes the space in front away."""

    def __init__(self, p: Pieces):
        self.offs = np.concatenate([[0], np.cumsum([len(b) for b in p.bytes_of])])
        self.data = np.frombuffer(b"".join(p.bytes_of), np.uint8)

    def __call__(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        n = self.offs[ids + 1] - self.offs[ids]
        ends = np.cumsum(n)
        k = np.arange(n.sum()) - np.repeat(ends - n, n)
        raw = self.data[np.repeat(self.offs[ids], n) + k].tobytes()
        cut = np.concatenate([[0], ends])[offs]
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = raw[a:b]
            out.append((own[1:] if own[:1] == b" " else own).decode("utf-8", "replace"))
        return out


def _with(batch: pa.RecordBatch, names: list[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    have = dict(zip(batch.schema.names, batch.columns))
    return pa.RecordBatch.from_arrays([(columns | {k: v for k, v in have.items() if k not in columns})[n] for n in names], names)


def _schema(df: DataFrame, *more: T.StructField) -> T.StructType:
    new = {f.name for f in more}
    return T.StructType([*(f for f in df.schema if f.name not in new), *more])


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", out: str = "ids", round_trip: str | None = None) -> DataFrame:
    """The documents with their piece ids in column `out`; in column `round_trip`, if named, whether they decode to the text."""
    more = [T.StructField(round_trip, T.BooleanType())] if round_trip is not None else []
    schema = _schema(docs, T.StructField(out, T.ArrayType(T.IntegerType())), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for batch in batches:
            for part in chunked(batch, text):
                col = part.column(text)
                texts = col.to_pylist()
                ids, offs = encode_texts(texts, pieces)
                more = {out: pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()), mask=col.is_null())}
                if round_trip is not None:
                    more[round_trip] = pa.array([b == (t or "") for b, t in zip(decoder(ids, offs), texts)], pa.bool_())
                yield _with(part, schema.names, more)

    return in_arrow(docs, run, schema)


def decode(docs: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The documents with the text of their ids in column `out`."""
    schema = _schema(docs, T.StructField(out, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for batch in batches:
            for at in range(0, len(batch), 50):
                part = batch.slice(at, 50)
                lists = [x or [] for x in part.column(ids).to_pylist()]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                texts = decoder(np.array([i for x in lists for i in x], np.int64), offs)
                null = part.column(ids).is_null().to_pylist()
                yield _with(part, schema.names, {out: pa.array([None if z else t for t, z in zip(texts, null)], pa.string())})

    return in_arrow(docs, run, schema)


def encode_checked(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_byte_tokens, ids, decoded_sha256, round_trip: encoded, decoded again and compared, in one pass."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("n_byte_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([rows.schema[0], *more])
    is_byte = np.zeros(len(pieces.bytes_of) + 1, np.int64)
    is_byte[pieces.byte_id] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for batch in batches:
            for part in chunked(batch, "__rv_text"):
                col = part.column(1)
                texts = col.to_pylist()
                ids, offs = encode_texts(texts, pieces)
                back = decoder(ids, offs)
                nb = np.concatenate([[0], np.cumsum(is_byte[ids])])[offs]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(offs), pa.int64()),
                        pa.array(np.diff(nb), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()), mask=col.is_null()),
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
                        pa.array([b == (t or "") for b, t in zip(back, texts)], pa.bool_()),
                    ],
                    schema.names,
                )

    return in_arrow(rows, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(read(spark, sf_dir, "documents"), load())
