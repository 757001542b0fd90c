"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field's labels are `O` and the four kinds.  It is trained from a small
labelled table (one row for each token) by gradient ascent on the exact
log-likelihood, and decoded by Viterbi for many stretches at once in numpy.
A stretch is a run of tokens that lie at most REACH tokens from a token with a
digit or an @; tokens elsewhere are O, as no kind can do without such a token.
Spans of the patterns stay; spans of the field are added where they overlap none.

A token's features are a fine and a coarse shape and, for runs of digit groups with 13 to 19 digits together, whether
these pass the Luhn check; so the field tells card numbers from other long numbers in notations that the patterns miss.

Defined results: null and empty texts have no spans (a null text stays null when
masked); a text of any length is read whole, long tokens in pieces; labels of equal score go to the first of
O, email, ip, card, phone; spans that begin together are ordered by kind; repeated rows get the same result each; rows
without an id are read as all others; an empty table gives an empty
result; other columns are ignored by `scan` and kept by `mask`, whatever their names (but for those that begin with `__rv_`).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, read

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
REACH = 3

# Fixed patterns of the contract.  The email pattern is applied from each @ outwards and the
# address pattern at starts of digit runs only: the same matches, in linear time.
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ANCHOR = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
LONG = 64
PIECE = re.compile(r"[0-9A-Za-z@.+()\-:/_]+|[^\W\d_]+")
_EDGE = ".,;:!?\"'[]{}<>|#$%&*="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        s = at
        while s > last and t[s - 1] in EMAIL_LEFT:
            s -= 1
        if s < at and (m := EMAIL_RIGHT.match(t, at + 1)):
            out.append((s, m.end()))
            last = m.end()
        at = t.find("@", max(at + 1, last))
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then by kind."""
    if not ANCHOR.search(t):
        return []
    out = [(s, 0, e) for s, e in emails(t)]
    for m in IP.finditer(t):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


# --- word shapes -----------------------------------------------------------------------------

# Words whose own form tells something, beside their shape.
CUE_WORDS = ("at", "dot", "phone", "tel", "call", "fax", "mobile", "card", "visa", "account", "ip", "host", "server", "email", "mail", "contact", "order", "invoice", "version", "page", "year", "usd", "total", "ext")


@lru_cache(maxsize=200_000)
def shapes(token: str) -> tuple[str, str]:
    """A fine shape (runs collapsed, digit runs with their length) and a coarse one."""
    bare = token.strip(_EDGE)
    low = bare.lower()
    if low in CUE_WORDS:
        return f"w:{low}", "w"
    fine, digits, kinds = [], 0, set()
    for m in re.finditer(r"[0-9]+|[A-Z]+|[^\W\d_]+|[\s\S]", bare):
        c = m[0][0]
        if c in "0123456789":
            digits += len(m[0])
            fine.append(f"d{len(m[0])}" if len(m[0]) < 5 else "dL" if len(m[0]) < 14 else "dXL" if len(m[0]) < 20 else "dXXL")
        elif c.isalpha():
            kinds.add("a")
            if not fine or fine[-1] != "a":
                fine.append("a")
        else:
            kinds.add(c if c in "@.+()-:/" else "?")
            fine.append(c if c in "@.+()-:/" else "?")
    size = "0" if not digits else "1" if digits < 7 else "2" if digits < 14 else "3" if digits < 20 else "4"
    return "".join(fine), size + "".join(sorted(kinds))


@dataclass(frozen=True)
class Field:
    """Weights of the shapes (fine, coarse) at the token before, at the token, and after it; and of label pairs."""

    names: dict[str, int]
    weights: np.ndarray  # [3, features, labels]
    pairs: np.ndarray  # [label, next label]
    first: np.ndarray


DIGITS = re.compile(r"[0-9][0-9./-]*")
PARTS = 3


def checks(tokens: list[str]) -> list[str]:
    """Of each token: `l1` (`l0`) if it is in a run of digit groups, alone or side by side, with 13 to 19 digits that pass (fail) the Luhn check."""
    out, i = [""] * len(tokens), 0
    while i < len(tokens):
        j, digits = i, ""
        while j < len(tokens) and DIGITS.fullmatch(bare := tokens[j].strip(_EDGE)):
            digits += re.sub("[^0-9]", "", bare)
            j += 1
        if 13 <= len(digits) <= 19:
            out[i:j] = ["l1" if luhn(digits) else "l0"] * (j - i)
        i = max(j, i + 1)
    return out


def features(tokens: list[str], names: dict[str, int]) -> np.ndarray:
    """[n, PARTS] feature numbers; 0 is an unseen shape."""
    return np.array([[names.get("f" + f, 0), names.get("c" + c, 0), names.get(x, 0)] for (f, c), x in zip(map(shapes, tokens), checks(tokens))], dtype=np.int64).reshape(len(tokens), PARTS)


def emissions(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """ids [batch, length, PARTS], 0 beyond the ends -> [batch, length, labels]."""
    own, pad = weights[1][ids].sum(axis=2), np.zeros((len(ids), 1, PARTS), np.int64)
    before = weights[0][np.concatenate([pad, ids[:, :-1]], axis=1)].sum(axis=2)
    after = weights[2][np.concatenate([ids[:, 1:], pad], axis=1)].sum(axis=2)
    return own + before + after


def viterbi(score: np.ndarray, lens: np.ndarray, field: Field) -> np.ndarray:
    """The best label sequence of each padded row of scores [batch, length, labels]."""
    n, length, _ = score.shape
    best, back = score[:, 0] + field.first, np.zeros((length, n, len(LABELS)), np.int8)
    for t in range(1, length):
        step = best[:, :, None] + field.pairs
        back[t] = step.argmax(axis=1)
        live = (lens > t)[:, None]
        best = np.where(live, step.max(axis=1) + score[:, t], best)
    out = np.zeros((n, length), np.int8)
    label = best.argmax(axis=1)
    for t in range(length - 1, -1, -1):
        out[:, t] = label
        moved = back[t][np.arange(n), label]
        label = np.where(lens > t, moved, label) if t else label
    return out


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def train(rows: DataFrame, max_rows: int = 200_000, steps: int = 120, rate: float = 0.15, decay: float = 0.02) -> Field:
    """Fits the field to a labelled table (seq, pos, token, label) of at most max_rows rows."""
    got = rows.select("seq", "pos", "token", "label").where("token is not null").orderBy("seq", "pos").limit(max_rows).collect()
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r["seq"], []).append((r["token"], LABELS.index(r["label"])))
    return fit(list(seqs.values()), steps, rate, decay)


def fit(seqs: list[list[tuple[str, int]]], steps: int, rate: float, decay: float) -> Field:
    k = len(LABELS)
    names: dict[str, int] = {"": 0}
    for s in seqs:
        for f, c in (shapes(x) for x, _ in s):
            names.setdefault("f" + f, len(names))
            names.setdefault("c" + c, len(names))
    names["l0"], names["l1"] = len(names), len(names) + 1
    n, length = len(seqs), max(map(len, seqs), default=1)
    lens = np.array([len(s) for s in seqs])
    ids, gold = np.zeros((n, length, PARTS), np.int64), np.zeros((n, length), np.int64)
    for i, s in enumerate(seqs):
        ids[i, : len(s)] = features([x for x, _ in s], names)
        gold[i, : len(s)] = [y for _, y in s]
    live = np.arange(length) < lens[:, None]
    w, pairs, first = np.zeros((3, len(names), k)), np.zeros((k, k)), np.zeros(k)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, pairs, first)]
    one = np.eye(k)[gold] * live[:, :, None]
    real_pairs = np.einsum("bti,btj->ij", one[:, :-1], one[:, 1:])
    pad = np.zeros((n, 1, PARTS), np.int64)
    shifted = [np.concatenate([pad, ids[:, :-1]], axis=1), ids, np.concatenate([ids[:, 1:], pad], axis=1)]
    for step in range(1, steps + 1):
        e = emissions(ids, w)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + first
        for t in range(1, length):
            alpha[:, t] = np.where(live[:, t, None], _logsum(alpha[:, t - 1, :, None] + pairs, 1) + e[:, t], alpha[:, t - 1])
        total = _logsum(alpha[:, -1], 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], _logsum(pairs + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        p = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        q = np.exp(alpha[:, :-1, :, None] + pairs + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
        gap, grad_w = one - p, np.zeros_like(w)
        for j, x in enumerate(shifted):
            for side in range(PARTS):
                np.add.at(grad_w[j], x[:, :, side].ravel(), gap.reshape(-1, k))
        for x, g, m in zip((w, pairs, first), (grad_w, real_pairs - q.sum(axis=(0, 1)), gap[:, 0].sum(axis=0)), moments):
            g = g / n - decay / n * x
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        w[:, 0] = 0
    return Field(names, w, pairs, first)


# --- the labelled table ----------------------------------------------------------------------


def labelled_sequences(n: int = 900, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Token sequences with labels, made by rule: personal data in several notations, and look-alikes."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(2, 9)))
    plain = lambda: r.choice([word, word, word, lambda: word().title(), lambda: word() + r.choice([",", ".", "!!", "$$$", "###"]), lambda: word().upper(), lambda: "|"])()
    octet = lambda: str(r.randint(0, 255))

    def email() -> list[str]:
        name = r.choice([f"{word()}.{word()}", word(), f"{word()}.{r.randint(1, 99)}", f"{word()}_{word()}", f"{word()}+{word()}"])
        host = r.choice([f"{word()}.com", f"{word()}.example.org", f"mail{r.randint(1, 9)}.{word()}.net"])
        return r.choice([[f"{name}@{host}"], [f"{name}@{host}"], [f"<{name}@{host}>"], [name, "@", host], [f"{name}@", host], [name, f"@{host}"]])

    def long_number(valid: bool) -> list[str]:
        """16 or 15 digits that pass the Luhn check or fail it, in several notations."""
        sizes = r.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5)])
        digits = num(sum(sizes) - 1)
        check = next(c for c in "0123456789" if luhn(digits + c))
        digits += check if valid else r.choice([c for c in "0123456789" if c != check])
        g = [digits[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes))]
        return r.choice([[digits], g, ["-".join(g)], [".".join(g)], ["/".join(g)]])

    def card() -> list[str]:
        return long_number(True)

    def phone() -> list[str]:
        a, b, c = num(3), num(3), num(4)
        return r.choice([[f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{r.randint(1, 99)}-{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{r.randint(1, 9)}{a}{b}{c}"], [f"+{r.randint(1, 99)}", a, b, c], [f"({a}){b}-{c}"]])

    def ip() -> list[str]:
        a = ".".join(octet() for _ in range(4))
        return r.choice([[a], [a], [f"{a}:{r.randint(1, 65535)}"], [f"{a}/{r.randint(8, 32)}"], [f"({a})"]])

    def other() -> list[str]:
        return r.choice(
            [
                long_number(False), long_number(False),
                [str(r.randint(1900, 2040))], [f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}"], [f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"], [f"${r.randint(1, 999)}.{num(2)}"], [f"{r.randint(1, 99)}.{r.randint(0, 99)}"],
                ["version", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}"], [f"{r.randint(1, 23)}:{num(2)}"], [f"{r.randint(1, 100)}%"], [f"{r.randint(1, 9)},{num(3)},{num(3)}"], ["order", f"#{num(r.randint(5, 9))}"], ["page", str(r.randint(1, 900))],
                [f"{word()}{r.randint(0, 99)}"], [f"@{word()}"], [num(r.randint(1, 6))], [num(r.randint(20, 30))], [num(3), num(3)], [f"{word()}-{r.randint(1, 99)}"], [word() + " ".join(""), f"{num(2)}x{num(2)}"], ["".join(r.choice("0123456789abcdef") for _ in range(32))], [f'"{num(10)}{word()}{num(6)}"'],
            ]
        )

    makers = {"email": email, "card": card, "phone": phone, "ip": ip, "O": other}
    out = []
    for _ in range(n):
        seq: list[tuple[str, str]] = [(plain(), "O") for _ in range(r.randint(0, 4))]
        kind = r.choice(["email", "card", "phone", "ip", "O", "O", "O", "O"])
        tokens = makers[kind]()
        if r.random() < 0.3:
            tokens[-1] += r.choice([".", ",", ";", "***", "&&&", "%%%", "!!"])
        seq += [(x, kind) for x in tokens]
        seq += [(plain(), "O") for _ in range(r.randint(0, 4))]
        out.append(seq)
    return out


def labelled_table(spark: SparkSession, n: int = 900, seed: int = 11) -> DataFrame:
    """(seq, pos, token, label), one row for each token."""
    rows = [(i, j, x, y) for i, s in enumerate(labelled_sequences(n, seed)) for j, (x, y) in enumerate(s)]
    return spark.createDataFrame(rows, "seq long, pos long, token string, label string")


# --- application -----------------------------------------------------------------------------


def tokens_of(t: str) -> list[tuple[int, int]]:
    """Spans of the words; one of over LONG characters (rows or texts without blanks) is cut at its separators and changes of script."""
    out = []
    for m in TOKEN.finditer(t):
        if m.end() - m.start() <= LONG:
            out.append(m.span())
        else:
            out += [x.span() for x in PIECE.finditer(t, m.start(), m.end())] or [m.span()]
    return out


def stretches(t: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens, as spans, near a token with a digit or an @."""
    anchors = [m.start() for m in ANCHOR.finditer(t)]
    if not anchors:
        return []
    tokens = tokens_of(t)
    starts = np.array([s for s, _ in tokens])
    at = np.unique(np.searchsorted(starts, anchors, side="right") - 1)
    groups = np.split(at, np.flatnonzero(np.diff(at) > 2 * REACH) + 1)
    return [tokens[max(0, g[0] - REACH) : g[-1] + REACH + 1] for g in groups]


def decode(texts: list[str], field: Field, rows: int = 4096) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text; stretches of like length are decoded together."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    todo = [(len(s), i, s) for i, t in enumerate(texts) for s in stretches(t)]
    todo.sort(key=lambda x: x[0])
    at = 0
    while at < len(todo):
        most = max(todo[at][0], 1)
        end = at
        while end < len(todo) and end - at < rows and todo[end][0] <= most + most // 4:
            end += 1
        part, at = todo[at:end], end
        lens = np.array([n for n, _, _ in part])
        ids = np.zeros((len(part), int(lens.max()), PARTS), np.int64)
        for k, (n, i, s) in enumerate(part):
            ids[k, :n] = features([texts[i][a:b] for a, b in s], field.names)
        labels = viterbi(emissions(ids, field.weights), lens, field)
        for k in np.flatnonzero((labels * (np.arange(labels.shape[1]) < lens[:, None])).any(axis=1)):
            n, i, s = part[k]
            j = 0
            while j < n:
                y, first = labels[k, j], j
                while j < n and labels[k, j] == y:
                    j += 1
                if y:
                    a, b = s[first][0], s[j - 1][1]
                    own = texts[i][a:b]
                    a, b = a + len(own) - len(own.lstrip(_EDGE)), b - len(own) + len(own.rstrip(_EDGE))
                    if a < b and ANCHOR.search(texts[i], a, b):
                        out[i].append((LABELS[y], a, b))
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(spans of the patterns, all spans) of each text."""
    out = []
    for t, more in zip(texts, decode(texts, field)):
        base = base_spans(t)
        added = [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]
        out.append((base, sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0]))) if added else base))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(t: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind in angle brackets."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [t[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, t[at:]])


def _batches(column: pa.Array, rows: int = 100) -> Iterator[tuple[int, list[str | None]]]:
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, counts of the pattern spans by kind, base_sha256 (of these), spans (all; kind:start:end, code points, end exclusive) and
    n_added (spans of the field)."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    schema = T.StructType([rows.schema[0], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _batches(batch.column(1)):
                found = all_spans([t or "" for t in texts], field)
                counts = [[sum(x[0] == k for x in base) for base, _ in found] for k in KINDS]
                sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([joined(s) for _, s in found], pa.string()), pa.array([len(s) - len(base) for base, s in found], pa.int64())], schema.names)

    return in_arrow(rows, run, schema)


def mask(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The documents, with all their columns, and personal data in `text` masked."""
    at_col = docs.schema.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _batches(batch.column(at_col)):
                found = all_spans([t or "" for t in texts], field)
                new = [t if t is None else masked(t, spans) for t, (_, spans) in zip(texts, found)]
                part = batch.slice(at, len(texts))
                yield part.set_column(at_col, part.schema.field(at_col), pa.array(new, part.schema.field(at_col).type))

    return in_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), train(labelled_table(spark)))
