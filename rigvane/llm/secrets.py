"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

`train` learns the transition tables of random strings and of ordinary
identifiers (names, paths, numbered and dated ones, long words of the documents) from four fifths of the labelled samples, and the threshold from the
rest.  `scan` looks at each token of LEAST or more characters: the stretch of it whose steps have the greatest sum of log-likelihood ratios (with one for whether it holds a digit) is a
secret if the sum passes the threshold, so ordinary names before and after it in a path, an address or a file name do not
outweigh it.  It is widened to the separators (/ _ -) around it, loses parts between separators at its ends that are ordinary by themselves, and reported as kind `markov` if it then has LEAST characters or more and touches no span of
a fixed pattern; what is left of the token on both sides is looked at in the same way.  Parts
whose form says that they are public (UUIDs, numbers, dates) are no part of a stretch, as their characters are as random as a secret's.

Defined results: null and empty texts have no spans; a text of any length is scanned whole; of stretches with the same sum the first to end is taken, and of
these the longest; where spans begin together they are ordered by kind; a repeated row gives a
repeated result; rows without an id are scanned as all others; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, cut, in_arrow, read

# Fixed patterns of the contract, letters of the keywords in either case.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters that a token, and a stretch that is reported, have at least.
LEAST = 16
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
#: Forms of public identifiers, and numbers, as parts of tokens.
PUBLIC = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]+Z?|[0-9]+)(?![A-Za-z0-9])")
SEPARATORS = "/_-"
#: Mean ratio of a step below which a part at an end of a stretch, of NAME characters or more between separators, is a name beside the secret.
EDGE, NAME = 0.8, 4
#: Share of the steps of ordinary names that are as random as a secret's, so that a pair of letters that no sample has counts 3 nats at most.
FOREIGN = 0.05
#: Letters of an ordinary word in a document that is long enough to learn from.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{8,}(?![A-Za-z0-9+/_=-])")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_LUT = np.zeros(256, dtype=np.int64)
_LUT[[ord(c) for c in SYMBOLS]] = np.arange(1, len(SYMBOLS) + 1)
N_STATES = len(SYMBOLS) + 1

# Words that make up the labelled identifiers; they are joined by rule in `identifier_samples`.
IDENTIFIER_WORDS = """account action active address agent amount array async attribute author balance batch block buffer
build button cache call category channel check child class client close cluster code collection color column command
comment commit config connection container content context controller convert count create current customer data
database date default delete description detail device dialog directory display document driver element email encode
engine entry error event example execute export expression factory field file filter find first folder format forward
frame function general generate global group handler header height helper history image import index information input
insert instance integer interface internal item iterator kernel label language latest layout length level library limit
line link list listener loader local location login manager mapping matrix memory message method migration model module
monitor name network node notification number object offset operation option order output package page parameter parent
parse partition path pattern payment performance person pipeline player policy position previous primary process product
profile program project property protocol provider query queue random reader record reference register release remote
render report request resource response result return router schema score screen search section select sender sequence
server service session setting shape signal simple size source stack standard start state statistic status storage
stream string style subject summary support switch system table target task template test thread time timestamp title
token total transaction transfer transform tree trigger type update upload user utility validate value variable vector
version video view visible volume warning weight width window worker wrapper writer""".split()


@dataclass(frozen=True)
class SecretModel:
    """llr[a, b]: how much likelier b follows a in random strings than in identifiers, in nats; digit: the same for a stretch without and with a digit."""

    llr: np.ndarray
    digit: tuple[float, float]
    threshold: float


def identifier_samples(n: int = 2000, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled samples made by rule: (text, 1) random strings, (text, 0) ordinary identifiers."""
    rng = random.Random(seed)
    out: list[tuple[str, int]] = []
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for _ in range(n):
        alphabet = rng.choice(["0123456789abcdef", SYMBOLS[:62], SYMBOLS[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", SYMBOLS[26:62]])
        out.append(("".join(rng.choice(alphabet) for _ in range(rng.randint(16, 48))), 1))
        words = [rng.choice(IDENTIFIER_WORDS) for _ in range(rng.randint(2, 5))]
        style = rng.randrange(12)
        if style < 5:
            word = ["_".join(words), "-".join(words), "".join(w.title() for w in words), "/".join(words), "_".join(words).upper()][style]
            word += str(rng.randint(0, 2030)) if rng.random() < 0.2 else ""
        elif style == 5:  # versions and numbered parts
            word = "-".join([*words[:2], f"v{rng.randint(0, 12)}", str(rng.randint(0, 40))])
        elif style == 6:  # dated files
            word = f"{words[0]}_{words[1]}_{rng.randint(1990, 2030)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
        elif style == 7:  # paths
            word = "/".join([words[0], f"{words[1]}{rng.randint(1, 9)}", f"part-{number(5)}", words[-1]])
        elif style == 9:  # long paths and addresses
            parts = [rng.choice(IDENTIFIER_WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.2 else "") for _ in range(rng.randint(4, 10))]
            word = rng.choice(["", "/"]) + "/".join(parts) + rng.choice(["", f"/{rng.randint(1, 99999)}", f"/v{rng.randint(1, 4)}"])
        elif style == 10:  # names, some of them with a short digest
            word = "-".join([*words[:2], "".join(rng.choice("0123456789abcdef") for _ in range(7))] if rng.random() < 0.3 else words)
        elif style == 11:  # long names in camel case with a suffix
            word = "".join(w.title() for w in words) + rng.choice(["Impl", "Test", "V2", "DTO", "JSON", "Id", "URL"])
        else:  # numbered records
            word = rng.choice([f"{words[0].upper()}-{number(rng.randint(6, 10))}-{words[1]}", f"{words[0]}_id_{number(rng.randint(5, 12))}", f"{words[0]}{number(3)}{words[1]}{number(2)}"])
        out.append((word, 0))
    return out


def labelled_samples(docs: DataFrame, text: str = "text", bound: int = 2000) -> DataFrame:
    """(text, label): the samples by rule, and from about `bound` documents the words of 8 or more letters and the long tokens
    without a digit as ordinary (0) and the values that fixed patterns match as random (1)."""

    def weak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(CANDIDATE % LEAST)
        for batch in batches:
            got: list[tuple[str, int]] = []
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                base = base_spans(t)
                got += [(v, 1) for _, s, e in base for v in token.findall(t[s:e]) if any(c.isdigit() for c in v)]
                taken = [(s, e) for _, s, e in base]
                ordinary = [m for m in token.finditer(t) if not any(c.isdigit() for c in m[0])]
                got += [(m[0], 0) for m in [*ordinary, *WORD.finditer(t)] if not any(s < m.end() and m.start() < e for s, e in taken)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.int32())], ["text", "label"])

    rows = bounded_sample(docs.select(F.col(text).alias("text")), bound, "text")
    made = docs.sparkSession.createDataFrame(identifier_samples(), "text string, label int")
    return made.unionByName(in_arrow(rows, weak, "text string, label int"))


def train(samples: DataFrame, least_llr: float = 3.0) -> SecretModel:
    """Transition tables from (text, label), of four fifths of the samples by hash; the counts are summed on the cluster, at most
    2 * 69**2 + 4 of them reach the driver.  The threshold is the 99.9 % quantile of the held-out
    identifiers' ratios, found from a histogram of whole nats, and at least least_llr.  Null texts and other labels are left out."""
    samples = cut(samples.select("text", "label", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, digits = np.zeros((2, N_STATES, N_STATES), dtype=np.int64), np.zeros((2, 2), dtype=np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and y in (0, 1):
                    c = codes(t)
                    np.add.at(total[y], (c[:-1], c[1:]), 1)
                    digits[y, int(any(x.isdigit() for x in t))] += 1
        cells = np.append(total.ravel(), digits.ravel())
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells[at], pa.int64())], ["cell", "n"])

    rows = in_arrow(samples.where("not held"), pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.full(2 * N_STATES * N_STATES + 4, 0.5)
    for r in rows:
        counts[r["cell"]] += r["n"]
    digits = counts[-4:].reshape(2, 2) / counts[-4:].reshape(2, 2).sum(axis=1, keepdims=True)
    digit = tuple(np.log(digits[1] / digits[0]).tolist())
    counts = counts[:-4].reshape(2, N_STATES, N_STATES)
    p = counts / counts.sum(axis=2, keepdims=True)
    llr = np.log(p[1] / ((1 - FOREIGN) * p[0] + FOREIGN * p[1]))

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [int(np.floor(max(-1.0, secret_in(t, steps(llr, t), digit, 0, len(t))[0]))) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and y == 0]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], ["nats"])

    hist = sorted((r["nats"], r["n"]) for r in in_arrow(samples.where("held"), ratios, "nats long").where("nats >= 0").groupBy("nats").agg(F.count("*").alias("n")).collect())
    seen, allowed, threshold = 0, samples.where("held and label = 0").count() / 1000, least_llr
    for nats, n in reversed(hist):
        seen += n
        if seen > allowed:
            threshold = max(least_llr, nats + 1.0)
            break
    return SecretModel(llr, digit, threshold)


def codes(text: str) -> np.ndarray:
    return _LUT[np.frombuffer(b"\0" + text.encode("ascii", "replace"), dtype=np.uint8)]


def steps(llr: np.ndarray, token: str) -> np.ndarray:
    """The ratio of each step into a character; public parts can be in no stretch."""
    c = codes(token)
    out = llr[c[:-1], c[1:]]
    for m in PUBLIC.finditer(token):
        out[m.start() : m.end()] = -np.inf
    return out


def best_stretch(step: np.ndarray) -> tuple[float, int, int]:
    """(sum, start, end) of the stretch with the greatest sum, which is minus infinity if there is none."""
    best = (-np.inf, 0, 0)
    open_ = np.flatnonzero(np.isfinite(step))
    for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
        total = np.append(0.0, np.cumsum(step[part]))
        gain = total[1:] - np.minimum.accumulate(total[:-1])
        j = int(np.argmax(gain))
        if gain[j] > best[0]:
            best = (float(gain[j]), int(part[0]) + int(np.argmin(total[: j + 1])), int(part[0]) + j + 1)
    return best


def secret_in(token: str, step: np.ndarray, digit: tuple[float, float], lo: int, hi: int) -> tuple[float, int, int]:
    """(ratio, start, end) of the best stretch of token[lo:hi], widened to the separators around it and without ordinary names at its ends."""
    total, a, b = best_stretch(step[lo:hi])
    a, b = a + lo, b + lo
    while a > lo and token[a - 1] not in SEPARATORS:
        a -= 1
    while b < hi and token[b] not in SEPARATORS:
        b += 1
    while parts := [i for i in range(a, b) if token[i] in SEPARATORS]:
        ends = [(step[x:y].mean(), x) for x, y in ((a, parts[0]), (parts[-1] + 1, b)) if y - x >= NAME]
        mean, at = min(ends, default=(EDGE, 0))
        if mean >= EDGE:
            break
        a, b = (parts[0] + 1, b) if at == a else (a, parts[-1])
    total = min(total, float(step[a:b].sum())) if b > a else -np.inf
    return total + digit[any(c.isdigit() for c in token[a:b])], a, b


def stretches(model: SecretModel, token: str, least: int = LEAST) -> list[tuple[int, int]]:
    """Start and end of all secrets in a token, in order."""
    step, out, todo = steps(model.llr, token), [], [(0, len(token))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= least:
            total, a, b = secret_in(token, step, model.digit, lo, hi)
            if total >= model.threshold:
                out += [(a, b)] if b - a >= least else []
                todo += [(lo, a), (b, hi)]
    return sorted(out)


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then by kind."""
    out: list[tuple[int, int, str, int]] = []
    low = t.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in t:
        out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(t)]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def all_spans(t: str, model: SecretModel, least: int = LEAST) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(t)
    more = []
    for m in re.finditer(CANDIDATE % least, t):
        more += [("markov", m.start() + a, m.start() + b) for a, b in stretches(model, m[0], least)]
    more = [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]
    return base, sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0]))) if more else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")] + [T.StructField("n_markov", T.LongType())]
)


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """id, counts by kind, base_sha256 and spans (kind:start:end, code points, end exclusive) of every text; secrets beside the
    fixed patterns have `least` characters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, spans = all_spans(t.as_py() or "", model, least)
                kinds = [k for k, _, _ in spans]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), kinds.count("markov")))
            cols = [pa.array([r[i] for r in rows], pa.string() if i in (3, 4) else pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *SCHEMA.names])

    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    return in_arrow(rows, run, T.StructType([rows.schema[0], *SCHEMA]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, train(labelled_samples(docs)))
