"""Scores of texts by a class-based bigram model of words (Brown classes, found by exchange).

P(w | v) = P(class of w | class of v) * P(unit of w | class of w) * P(w | unit of w).  A text's tokens are its words, lower-cased in A-Z, then one
end; the end also stands before the first word and has a class of its own.

* `word_counts`: how often each word occurs in the training texts, over all of them, by a 64-bit hash of the word.
* Units: a word with at least one of UNIT_SHARE training tokens is a unit of its own (so there are no more than UNIT_SHARE of them, however
  large the input); all rarer and all unseen words are 16 units by their form (length, digits, letters beyond ASCII).  Within such a unit a word has (count + 1) /
  (tokens + types + 1), from its exact count.
* `exchange`: units are moved between classes while the likelihood of the class bigrams grows.  The CORE most frequent units are exchanged one after
  another, on a matrix of at most CORE**2 counts.  Then every task walks through its units, each with all its neighbours, and proposes the
  best class for each; a round of proposals that does not raise the likelihood, which is computed anew over all bigrams, is halved, and taken back if that does not help.
* Transitions are smoothed by classes' shares (weight SMOOTH), emissions by 0.5 for each unit.

Scoring needs each token's exact count.  Words with at least one of KNOWN_SHARE tokens lie in a table of bounded size that all tasks
have; the others are joined with the counts, each text's words once.  No such word can be a hot key: it has less than one of KNOWN_SHARE tokens.

Defined results: null and empty texts have the end as their only token; a null id is held out; ids that repeat are scored row by row; a text of any
length is scored whole; of units with one count the smaller hash is first, of classes with one gain the first is taken; without training texts all
counts are 0 and scores are those of the smoothing; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, byte_set, chunked, cut, in_arrow, lower_values, mix, prefix_hash, range_hash, read, utf8, word_bounds

CLASSES, CORE, ROUNDS = 48, 600, 6
UNIT_SHARE, KNOWN_SHARE = 1 << 16, 1 << 21
SMOOTH, EMIT = 20.0, 0.5
#: Rounds end when one raises the log-likelihood by less than this share.
LEAST_GAIN = 3e-5
FORMS = 16
END_UNIT, FIRST_WORD = FORMS, FORMS + 1
#: Keys that a task gathers before it hands on sums, and buckets that sums are dealt out in.
HELD, BUCKETS = 1 << 20, 4096

_IS_WORD = byte_set([(0x20, 0x20), (0x09, 0x0D)], inverted=True)
_VALUES = lower_values(29)
_END = np.int64(0x5EED0E7D)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, form, n + 1 offsets) of the tokens of each text; the last token of a text is the end, whose form is END_UNIT."""
    buf, offs = utf8(column)
    starts, ends, first = word_bounds(buf, offs, _IS_WORD)
    n = len(first) - 1
    h = mix(range_hash(prefix_hash(_VALUES[buf]), starts, ends)).view(np.int64)
    size = ends - starts
    has = lambda a: (c := np.concatenate([[0], np.cumsum(a)]))[ends] > c[starts]
    form = np.searchsorted([3, 6, 10], size) * 4 + 2 * has((buf >= 0x30) & (buf <= 0x39)) + has(buf >= 0x80)
    at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))
    out, shape = np.full(len(h) + n, _END), np.full(len(h) + n, END_UNIT)
    out[at], shape[at] = h, form
    return out, shape, first + np.arange(n + 1)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def by_runs(of: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """The values of `of`, of which equal ones lie side by side, once each, with the lists of what goes with them."""
    at = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, int)
    ends = pa.array(at.astype(np.int32))
    return of[at[:-1]], [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]


def tallied(texts: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], bucket_of: Callable[[np.ndarray], np.ndarray], give: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """How often each 64-bit key occurs: give(keys in order, counts) of each bucket.

    A task sums its own texts, and hands on one row for each bucket, with lists of keys and counts, which are dealt out by bucket, in BUCKETS of them, and summed
    again.  A task holds HELD keys and, in the second step, those of one bucket; the shuffle moves no single key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> pa.RecordBatch:
            key, n = summed(keys, counts)
            bucket = bucket_of(key) % BUCKETS
            order = np.argsort(bucket, kind="stable")
            bucket, lists = by_runs(bucket[order], key[order], n[order])
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *lists], ["bucket", "keys", "counts"])

        keys, counts, held = [], [], 0
        for batch in batches:
            for part in chunked(batch, "text"):
                key, n = np.unique(keys_of(part.column(0)), return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held >= HELD:
                    yield dealt()
                    keys, counts, held = [], [], 0
        if held:
            yield dealt()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, counts = None, [], []
        for batch in batches:
            flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[1:]]
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != bucket and keys:
                    yield give(*summed(keys, counts))
                    keys, counts = [], []
                bucket = b
                for to, (v, o) in zip((keys, counts), flat):
                    to.append(v[o[i] : o[i + 1]])
                if sum(map(len, keys)) >= HELD:
                    keys, counts = ([x] for x in summed(keys, counts))
        if keys:
            yield give(*summed(keys, counts))

    rows = in_arrow(texts, run, "bucket int, keys array<long>, counts array<long>")
    return in_arrow(rows.repartition("bucket").sortWithinPartitions("bucket"), total, schema)


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, form, n) of every token of the texts, ends included, written once; the form is in the key's lowest five bits."""

    def give(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(by_runs(np.zeros(len(key)), key, n)[1], ["key", "n"])

    lists = cut(tallied(texts, lambda column: formed(*tokens(column)[:2]), lambda key: (key >> np.int64(5)) & np.int64((1 << 58) - 1), give, "key array<long>, n array<long>"))
    return lists.select(F.inline(F.arrays_zip("key", "n"))).select("key", F.col("key").bitwiseAND(F.lit(31)).cast("int").alias("form"), "n")


def formed(h: np.ndarray, form: np.ndarray) -> np.ndarray:
    """A token's key: its hash, with the form in the lowest five bits."""
    return (h & np.int64(-32)) | form.astype(np.int64)


@dataclass
class Vocabulary:
    """Keys of frequent words in order, with count and unit (or form), and the tokens and types of each unit by form."""

    total: int
    types: int
    keys: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    n_units: int
    rare: np.ndarray
    known_share: int

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def units_of(self, keys: np.ndarray) -> np.ndarray:
        at, there = self.find(keys)
        form = keys & np.int64(31)
        return np.where(there, self.units[at], form) if len(self.keys) else form


def vocabulary(counts: DataFrame, unit_share: int = UNIT_SHARE, known_share: int = KNOWN_SHARE) -> Vocabulary:
    """At most known_share words reach the driver, and at most unit_share of them are units."""
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = counts.where(F.col("n") * F.lit(known_share) >= F.lit(total)).select("key", "n").toArrow()
    key, n = known.column("key").to_numpy(), known.column("n").to_numpy()
    word = n * unit_share >= total
    word &= (key & 31) != END_UNIT
    order = np.lexsort((key[word], -n[word]))
    units = key & 31
    units[np.flatnonzero(word)[order]] = FIRST_WORD + np.arange(len(order))
    rare = np.zeros((FORMS, 2), np.int64)
    for r in counts.where((F.col("n") * F.lit(unit_share) < F.lit(total)) & (F.col("form") != END_UNIT)).groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect():
        rare[r["form"]] = r["n"], r["t"]
    by = np.argsort(key)
    return Vocabulary(int(total), int(types), key[by], n[by], units[by], FIRST_WORD + len(order), rare, known_share)


def neighbours(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(unit, side, others, counts), written once: how often each unit follows (side 0) and precedes (1) a unit, over all texts, by unit.  The end stands
    before each first word.  A unit has at most as many of either as there are units."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def pairs(column: pa.Array) -> np.ndarray:
        h, form, offs = tokens(column)
        unit = shared.value.units_of(formed(h, form))
        u = before(unit, offs)
        return np.concatenate([(u << 21) | unit, (unit << 21) | (1 << 20) | u])

    def give(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        head, lists = by_runs(key >> 20, (key & ((1 << 20) - 1)).astype(np.int32), n)
        return pa.RecordBatch.from_arrays([pa.array((head >> 1).astype(np.int32)), pa.array((head & 1).astype(np.int32)), *lists], ["unit", "side", "others", "counts"])

    spread = lambda key: mix((key >> 21).view(np.uint64)).view(np.int64) & np.int64((1 << 62) - 1)
    return cut(tallied(texts, pairs, spread, give, "unit int, side int, others array<int>, counts array<long>"))


def before(unit: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """What stands before each token; before the first one of a text, the end."""
    prev = np.empty_like(unit)
    prev[1:] = unit[:-1]
    prev[offs[:-1]] = END_UNIT
    return prev


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(unit, [(followers, counts), (predecessors, counts)]) of rows in the order of units."""
    unit, held = None, ([], [])

    def done():
        return unit, [(np.concatenate([o for o, _ in x] or [np.zeros(0, int)]), np.concatenate([c for _, c in x] or [np.zeros(0, int)])) for x in held]

    for batch in batches:
        flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3))]
        for i, (u, side) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if u != unit:
                if unit is not None:
                    yield done()
                unit, held = u, ([], [])
            held[side].append(tuple(v[o[i] : o[i + 1]] for v, o in flat))
    if unit is not None:
        yield done()


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


class Exchange:
    """Bigram counts of classes (the end's class is the last one), and what moving a unit changes.  A unit without a class has -1."""

    def __init__(self, table: np.ndarray, classes: np.ndarray):
        self.table, self.classes, self.k = table.astype(float), classes.copy(), len(table) - 1

    def likelihood(self) -> float:
        """Log-likelihood of the class bigrams but for the units' own counts, which no exchange changes."""
        return float(xlogx(self.table).sum() - xlogx(self.table.sum(axis=1)).sum() - xlogx(self.table.sum(axis=0)).sum())

    def context(self, unit: int, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Followers and predecessors of a unit by class, without itself, and how often it follows itself."""
        out, own = [], 0.0
        for other, n in sides:
            c = self.classes[other]
            use = (c >= 0) & (other != unit)
            out.append(np.bincount(c[use], n[use], self.k + 1))
            own = float(n[other == unit].sum())
        return out[0], out[1], own

    def shift(self, c: int, right: np.ndarray, left: np.ndarray, own: float, by: int) -> None:
        self.table[c, :] += by * right
        self.table[:, c] += by * left
        self.table[c, c] += by * own

    def gains(self, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
        """How much the likelihood grows if a unit that has no class joins each of them, but for what is the same for all classes."""
        k, t = self.k, self.table
        r, l = np.flatnonzero(right), np.flatnonzero(left)
        rows = xlogx(t[:k, r] + right[r]) - xlogx(t[:k, r])
        cols = xlogx(t[l, :k] + left[l, None]) - xlogx(t[l, :k])
        total = rows.sum(axis=1) + cols.sum(axis=0)
        c = np.arange(k)
        d = t[c, c]
        total += xlogx(d + right[:k] + left[:k] + own) - xlogx(d) - (xlogx(d + right[:k]) - xlogx(d)) - (xlogx(d + left[:k]) - xlogx(d))
        out, into = t.sum(axis=1)[:k] + left[:k], t.sum(axis=0)[:k] + right[:k]
        return total - (xlogx(out + right.sum() + own) - xlogx(out)) - (xlogx(into + left.sum() + own) - xlogx(into))

    def move(self, unit: int, sides: list[tuple[np.ndarray, np.ndarray]]) -> bool:
        """Puts a unit into its best class; whether that is another one.  A unit that meets no unit with a class stays."""
        if unit == END_UNIT:
            return False
        right, left, own = self.context(unit, sides)
        old = int(self.classes[unit])
        if not right.any() and not left.any():
            return False
        if old >= 0:
            self.shift(old, right, left, own, -1)
        g = self.gains(right, left, own)
        new = int(np.argmax(g))
        if old >= 0 and g[new] <= g[old] + 1e-9:
            new = old
        self.shift(new, right, left, own, 1)
        self.classes[unit] = new
        return new != old


def core_classes(near: DataFrame, n_units: int, classes: int = CLASSES, core: int = CORE, rounds: int = 10) -> np.ndarray:
    """Classes of the first units, exchanged one after another on their own bigrams (core**2 counts at most); -1 for the others."""
    core = min(core, n_units)
    rows = near.where(f"side = 0 and unit < {core}").select(F.col("unit").alias("u"), F.inline(F.arrays_zip(F.col("others").alias("v"), F.col("counts").alias("n")))).where(f"v < {core}").toArrow()
    m = np.zeros((core, core))
    m[rows.column("u").to_numpy(), rows.column("v").to_numpy()] = rows.column("n").to_numpy()
    found = np.full(n_units, -1)
    found[:core] = np.arange(core) % classes
    found[END_UNIT] = classes
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (found[:core, None], found[None, :core]), m)
    x, every = Exchange(table, found), np.arange(core)
    for _ in range(rounds):
        if not sum(x.move(u, [(every, m[u]), (every, m[:, u])]) for u in range(core)):
            break
    return x.classes


def class_table(near: DataFrame, found: np.ndarray, classes: int) -> np.ndarray:
    """Bigram counts of classes over all bigrams whose units have one; a task gives (classes + 1)**2 sums at most."""
    shared = near.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total = shared.value, np.zeros((classes + 1, classes + 1), np.int64)
        for unit, sides in gathered(batches):
            if c[unit] >= 0:
                to = c[sides[0][0]]
                total[c[unit]] += np.bincount(to[to >= 0], sides[0][1][to >= 0], classes + 1).astype(np.int64)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], ["cell", "n"])

    table = np.zeros((classes + 1) ** 2)
    for r in near.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r["cell"]] = r["n"]
    return table.reshape(classes + 1, classes + 1)


def proposals(near: DataFrame, x: Exchange) -> np.ndarray:
    """Classes after every task has moved its own units, given where all units were."""
    shared = near.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Exchange(shared.value.table, shared.value.classes)
        moved = [(u, int(own.classes[u])) for u, sides in gathered(batches) if own.move(u, sides)]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in moved], pa.int32()), pa.array([c for _, c in moved], pa.int32())], ["unit", "c"])

    out = x.classes.copy()
    got = near.mapInArrow(run, "unit int, c int").toArrow()
    out[got.column("unit").to_numpy()] = got.column("c").to_numpy()
    return out


def exchange(near: DataFrame, n_units: int, classes: int = CLASSES, core: int = CORE, rounds: int = ROUNDS) -> tuple[Exchange, list[float]]:
    """The classes of all units, with their bigram counts, and the log-likelihood after each round."""
    found = core_classes(near, n_units, classes, core)
    x = Exchange(class_table(near, found, classes), found)
    if (found < 0).any():  # units that are not in the core join it
        found = proposals(near, x)
        found[found < 0] = np.flatnonzero(found < 0) % classes
        x = Exchange(class_table(near, found, classes), found)
    said = [x.likelihood()]
    for _ in range(rounds):
        new, better = proposals(near, x), None
        for part in (1, 2):  # all proposals, or every second one
            tried = np.where(np.arange(n_units) % part == 0, new, x.classes)
            y = Exchange(class_table(near, tried, classes), tried)
            if y.likelihood() > said[-1]:
                better = y
                break
        if better is None:
            break
        x = better
        said.append(x.likelihood())
        if said[-1] - said[-2] < LEAST_GAIN * abs(said[-1]):
            break
    return x, said


@dataclass
class Model:
    """Log10 of transitions between classes, of each unit in its class, and what a word of a unit by form loses beside its own count."""

    vocab: Vocabulary
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    form_total: np.ndarray

    @property
    def base_loss(self) -> float:
        """What the base score takes from each token: log10 of tokens + types + 1."""
        return float(np.log10(self.vocab.total + self.vocab.types + 1))


def train(texts: DataFrame, classes: int = CLASSES, unit_share: int = UNIT_SHARE, known_share: int = KNOWN_SHARE) -> tuple[Model, DataFrame]:
    """The model of texts (column text), and the counts of all their words."""
    texts = texts.select(F.col("text"))
    counts = word_counts(texts)
    vocab = vocabulary(counts, unit_share, known_share)
    x, _ = exchange(neighbours(texts, vocab), vocab.n_units, classes)
    n = np.zeros(vocab.n_units)
    n[vocab.units[vocab.units >= FIRST_WORD]] = vocab.counts[vocab.units >= FIRST_WORD]
    n[:FORMS] = vocab.rare[:, 0]
    n[END_UNIT] = x.table[:, classes].sum()
    of_class, size = np.bincount(x.classes, n, classes + 1), np.bincount(x.classes, minlength=classes + 1)
    share = (of_class + 1) / (of_class.sum() + classes + 1)
    transition = (x.table + SMOOTH * share) / (x.table.sum(axis=1, keepdims=True) + SMOOTH)
    emission = (n + EMIT) / (of_class + EMIT * size)[x.classes]
    return Model(vocab, x.classes, np.log10(transition), np.log10(emission), np.log10(vocab.rare.sum(axis=1) + 1.0)), counts


SUMS = "n_tokens long, n_known long, loss double, part double, tail_key array<long>, tail_n array<int>"


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep, n_tokens, n_known, train_tokens, base_score and score of every row."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    schema = T.StructType([*rows.schema[:-1], *T._parse_datatype_string(SUMS)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for part in chunked(batch, "text"):
                h, form, offs = tokens(part.column(part.num_columns - 1))
                key, n = formed(h, form), len(part)
                doc = np.repeat(np.arange(n), np.diff(offs))
                at, there = m.vocab.find(key)
                unit = m.vocab.units_of(key)
                c = m.classes[unit]
                logs = m.transition[m.classes[before(unit, offs)], c] + m.emission[unit]
                rare = unit < FORMS
                logs[rare] -= m.form_total[unit[rare]]
                own = np.zeros(len(key))
                own[there] = np.log10(m.vocab.counts[at[there]] + 1.0)
                logs[rare] += own[rare]
                # Words that are not in the table: each of a text's once, to be joined with the counts.
                tail = np.flatnonzero(~there)
                order = tail[np.lexsort((key[tail], doc[tail]))]
                new = np.append(True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])) if len(order) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(order)))
                ends = pa.array(np.searchsorted(doc[order][first], np.arange(n + 1)).astype(np.int32))
                tails = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (key[order][first], times.astype(np.int32))]
                sums = [np.diff(offs), np.bincount(doc, there, n).astype(np.int64), np.bincount(doc, own, n), np.bincount(doc, logs, n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(s) for s in sums), *tails], schema.names)

    parts = cut(in_arrow(rows, run, schema)).withColumn("row", F.monotonically_increasing_id())
    tails = parts.select("row", F.explode(F.arrays_zip("tail_key", "tail_n")).alias("t")).select("row", F.col("t.tail_key").alias("key"), F.col("t.tail_n").alias("times"))
    # Only words that the table of frequent ones leaves out are asked for.
    left = counts.where(F.col("n") * F.lit(model.vocab.known_share) < F.lit(model.vocab.total)).select("key", "n")
    met = tails.join(left, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("loss") + zero("logs") - F.col("n_tokens") * F.lit(model.base_loss)
    return parts.join(met, "row", "left").select(
        F.col("id").alias(id_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"),
        F.lit(model.vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("part") + zero("logs")).alias("score"),
    )


def perplexity(scored: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Per-token perplexity of groups of scored rows."""
    return scored.groupBy(*by).agg(F.pow(F.lit(10.0), -F.sum(value) / F.sum("n_tokens")).alias("perplexity"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    model, counts = train(docs.where(~F.col("held_out")))
    return score(docs, model, counts, keep=("held_out",))
