"""Conversation repair, filter audit and class-based scores against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rigvane.llm import brown, conversations, filter_audit

# --- 11: conversations -----------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\f\r"


def plain_damage(rows):
    """Rows by conversation after damage; conversations that lose all rows stay."""
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        x = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if x:
            text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            out[c] += [(t, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def plain_faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        end = text.rstrip(WS)[-1:]
        out.append("b" if not end else "d" if (role, text) in seen else "" if end in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(turns):
    """Every way to edit, by trying all of them: two insertions in each place at most (one, of three turns)."""
    marks, best = plain_faults(turns), None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u"), ("u", "u"), ("a", "a")][: 7 if len(turns) < 3 else 3]
    edits = [[("D", None), *([] if m in ("b", "d") else [("K", r), ("R", "user"), ("R", "assistant")])] for m, (_, r, _) in zip(marks, turns)]
    for chosen in itertools.product(*edits):
        for gaps in itertools.product(inserts, repeat=len(turns) + 1):
            audit, cost, said = "", 0, []
            for i, gap in enumerate(gaps):
                audit, cost = audit + "I" * len(gap), cost + 3 * len(gap)
                said += [("user" if g == "u" else "assistant", "") for g in gap]
                if i < len(turns):
                    e, role = chosen[i]
                    audit, cost = audit + e, cost + {"K": 0, "R": 3, "D": 4}[e] + (3 if e != "D" and marks[i] == "t" else 0)
                    said += [(role, turns[i][2])] if e != "D" else []
            if (best is None or (cost, audit) < best[:2]) and all(r for r, _ in said) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said)):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return best


def plain_counts(turns):
    marks, known = plain_faults(turns), [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, marks.count("b"), marks.count("d"), marks.count("t"), bad


def small_conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Fine.", "Fine.", "no end", "", " \t", None, "Why?", "é ", "x.\n"]
    return [(c if c else None, rng.choice([None, 1, 2, 3, 7, -2]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(n) for _ in range(rng.randint(1, most))]


def test_repairs_equal_brute_force(spark):
    rows = small_conversations(3, 250, 3)
    turns = plain_damage(rows)
    assert any(not v for v in turns.values()) and any(len(v) > 2 for v in turns.values())
    df = spark.createDataFrame(rows, CONV).withColumn("alive", F.lit("clash")).withColumn("fault", F.lit(1))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(conversations.damage(df), alive="alive").collect()}
    small = {c: v for c, v in turns.items() if len(v) <= 3}
    assert set(got) == set(turns) and len(small) > 40
    for c, v in small.items():
        assert got[c] == (*plain_counts(v), *plain_repair(v)), (c, v)
    assert conversations.repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows_, lane", [(7, 3), (64, 64), (5, 200)])
def test_lanes_and_blocks_change_nothing(spark, monkeypatch, rows_, lane):
    """Wherever long conversations are cut, in blocks or lanes, the repairs are those of a single recursion."""
    rng = random.Random(8)
    rows = [(c, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"{rng.randrange(40)}{rng.choice(['.', '', '!'])}") for c in range(4) for i in range(rng.choice([1, 30, 90]))]
    ready = conversations.faults(spark.createDataFrame(rows, CONV).coalesce(1)).coalesce(1).sort("id", "turn", "role", "text").toArrow()
    want = sorted(tuple(r) for r in conversations.repair(spark.createDataFrame(rows, CONV)).collect())
    monkeypatch.setattr(conversations, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(conversations, "LANE", lane)
    con, current, got = duckdb.connect(), None, []
    con.register("moves", conversations.moves())
    for block, last in conversations.blocks(iter(ready.to_batches(max_chunksize=3))):
        done, current = conversations.advance(con, block, current)
        got += done + ([current.row()] if last else [])
    assert sorted(got) == want


def test_extreme_turns_wrap(spark):
    rows = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B.")]
    assert conversations.repair(spark.createDataFrame(rows, CONV)).first()["gaps"] == -2


# --- 12: filters -----------------------------------------------------------------------------


def test_audit_equals_filtering_one_by_one(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "x|y", "delta", "omega.", "ETA"]

    def text():
        w = [rng.choice(words[: rng.randint(1, 7)]) + str(rng.randrange(rng.choice([1, 500]))) for _ in range(rng.choice([0, 3, 199, 200, 260]))]
        return rng.choice([" ", "\n", "\t "]).join(w)

    pool = [text() for _ in range(25)] + [None, "", " ", "same"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(pool), rng.choice(["a", "b", None, ""])) for _ in range(150)]
    rows += rows[:6]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(50), *range(10), 999]] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("n", F.lit(9))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("other"))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append({f for f in bad if bad[f]})
    want = Counter()
    for order in itertools.permutations("ABCDE"):
        left = list(range(len(rows)))
        for k, f in enumerate(order):
            here = [r for r in left if f in fails[r]]
            left = [r for r in left if f not in fails[r]]
            for part in {r[2] or "" for r in rows}:
                of = lambda x: [r for r in x if (rows[r][2] or "") == part]
                ever = of([r for r in range(len(rows)) if f in fails[r]])
                want[part, "".join(order), k + 1] = (len(of(left)), len(of(here)), len(ever) - len(of(here)), sum(fails[r] == {f} for r in ever), sum(rows[r][0] in good for r in of(here)), sum(rows[r][0] in toxic for r in of(here)))
    shapley = defaultdict(int)
    for (part, order, k), v in want.items():
        shapley[part, order[k - 1]] += v[1]
    out = filter_audit.audit(docs, known).collect()
    assert len(out) == len(want) == 600 * 3
    for r in out:
        assert tuple(r)[3:9] == want[r["part"], r["filter_order"], r["step"]] and r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]
    assert filter_audit.audit(docs.limit(0), known).count() == 0
    assert filter_audit.audit(docs, known.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


# --- 13: class-based scores ------------------------------------------------------------------


def corpus(seed=5, n=140):
    """Two languages that never mix, numbers, rare words, and odd rows."""
    rng = random.Random(seed)
    nouns, verbs = [["kuna", "miko", "tapu", "Loma"], ["strz", "pryk", "wolt"]], [["sees", "eats"], ["widzi", "zna", "ÄÖ"]]
    rows = []
    for i in range(n):
        g = rng.randrange(2)
        rows.append((i, " ".join(f"{rng.choice(nouns[g])} {rng.choice(verbs[g])}" + (f" {rng.randrange(10**rng.randint(1, 6))}" if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 30)))))
    return rows + [(None, "kuna sees miko"), (9001, None), (9002, ""), (9003, "\t x\x0b\x0cY "), (3, "kuna"), (3, "kuna"), (9004, "zna " * 20_000)]


def low(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_scores_equal_plain_sums(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("held_out", brown.held_out()).withColumn("row", F.lit("clash")).withColumn("n_tokens", F.lit("x"))
    model, counts = brown.train(docs.where("not held_out"), classes=4, unit_share=300, known_share=3000)
    out = brown.score(docs, model, counts, keep=("held_out",))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    n = Counter(w for i, t in rows if not held(i) for w in [*low(t), None])
    total, v = model.vocab, len(n)
    assert (total.total, total.types) == (sum(n.values()), v) and len(total.keys) < v and total.n_units < brown.FIRST_WORD + len(total.keys)
    want = []
    for i, t in rows:
        h, form, offs = brown.tokens(pa.array([t], pa.string()))
        ws, unit = [*low(t), None], total.units_of(brown.formed(h, form))
        assert len(ws) == len(h)
        base = sum(math.log10((n[w] + 1) / (sum(n.values()) + v + 1)) for w in ws)
        s, prev = 0.0, brown.END_UNIT
        for w, u in zip(ws, unit):
            s += model.transition[model.classes[prev], model.classes[u]] + model.emission[u]
            if u < brown.FORMS:
                s += math.log10((n[w] + 1) / (total.rare[u].sum() + 1))
            prev = u
        want.append((i, held(i), len(ws), sum(n[w] > 0 for w in ws), sum(n.values()), base, s))
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted((tuple(r) for r in out.collect()), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert brown.score(docs.limit(0), model, counts).count() == 0
    p = {r["held_out"]: r["perplexity"] for r in brown.perplexity(out, ["held_out"]).collect()}
    b = {r["held_out"]: r["perplexity"] for r in brown.perplexity(out, ["held_out"], "base_score").collect()}
    assert p[True] < 0.8 * b[True] and p[False] < 0.8 * b[False]


def test_probabilities_sum_to_one(spark):
    """Over all units, and within a unit by form over its words and one unseen word."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    model, counts = brown.train(docs, classes=4, unit_share=300)
    share = np.zeros((5, len(model.classes)))
    for c in range(5):
        share[c] = 10 ** (model.transition[c, model.classes] + model.emission)
    empty = 1 - sum(10 ** model.transition[:, c] for c in range(5) if not (model.classes == c).any())
    assert share.sum(axis=1) == pytest.approx(empty if isinstance(empty, np.ndarray) else np.ones(5))
    rare = counts.where((F.col("n") * 300 < model.vocab.total) & (F.col("form") != brown.END_UNIT)).collect()
    for u in {r["form"] for r in rare}:
        assert sum(r["n"] + 1 for r in rare if r["form"] == u) + 1 == pytest.approx(10 ** model.form_total[u])


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model, counts = brown.train(docs.limit(0))
    got = {r["doc_id"]: r for r in brown.score(docs, model, counts).collect()}
    assert [got[i]["n_tokens"] for i in (1, 2)] == [3, 1] and got[1]["n_known"] == got[1]["train_tokens"] == 0
    assert got[1]["base_score"] == 0.0 and math.isfinite(got[1]["score"]) and got[1]["score"] < got[2]["score"] < 0


def test_gain_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(2)
    n_units, k = 30, 4
    m = rng.integers(0, 6, (n_units, n_units)) * (rng.random((n_units, n_units)) < 0.4)
    classes = rng.integers(0, k, n_units)
    classes[brown.END_UNIT] = k

    def table(c):
        t = np.zeros((k + 1, k + 1))
        np.add.at(t, (c[:, None], c[None, :]), m)
        return t

    every = np.arange(n_units)
    for u in (0, 3, 20, 29):
        x = brown.Exchange(table(classes), classes)
        right, left, own = x.context(u, [(every, m[u]), (every, m[:, u])])
        x.shift(classes[u], right, left, own, -1)
        all_ = []
        for c in range(k):
            moved = classes.copy()
            moved[u] = c
            all_.append(brown.Exchange(table(moved), moved).likelihood())
        assert np.diff(x.gains(right, left, own)) == pytest.approx(np.diff(all_))
    x, before = brown.Exchange(table(classes), classes), brown.Exchange(table(classes), classes).likelihood()
    for u in range(n_units):
        x.move(u, [(every, m[u]), (every, m[:, u])])
        assert np.array_equal(x.table, table(x.classes)) and x.likelihood() >= before - 1e-9
        before = x.likelihood()


def test_rounds_raise_the_likelihood_and_part_the_languages(spark):
    docs = spark.createDataFrame(corpus(7, 300), "doc_id long, text string")
    texts = docs.select("text")
    vocab = brown.vocabulary(brown.word_counts(texts), 300)
    near = brown.neighbours(texts, vocab)
    x, said = brown.exchange(near, vocab.n_units, classes=6, core=20)
    assert said == sorted(said) and x.likelihood() == said[-1]
    assert np.array_equal(x.table, brown.class_table(near, x.classes, 6))
    of = lambda w: x.classes[vocab.units_of(brown.formed(*brown.tokens(pa.array([w]))[:2]))[0]]
    assert {of("kuna"), of("miko"), of("tapu")}.isdisjoint({of("strz"), of("pryk"), of("wolt")})
