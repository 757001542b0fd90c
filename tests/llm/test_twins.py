"""The operators' own rows against plain twins, and the defined results of odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from test_text_operators import docs, prose  # noqa: E402, F401

import corpus_pipeline  # noqa: E402
from rigvane.llm import common, contamination, fingerprints, graph, language, licenses, ngram_join, pii, quality, secrets, sentencepiece_codec, substring_dedup  # noqa: E402


def sha(parts) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in parts).encode()).hexdigest()


# --- 1 ---------------------------------------------------------------------------------------


def plain_secrets(token, model):
    """All stretches are tried; the best one is widened, and what is left on both sides is looked at again."""
    codes = [0, *(secrets.SYMBOLS.index(c) + 1 for c in token)]
    step = [model.llr[x, y] for x, y in zip(codes, codes[1:])]
    for m in secrets.PUBLIC.finditer(token):
        step[m.start() : m.end()] = [-math.inf] * (m.end() - m.start())

    def look(lo, hi):
        if hi - lo < 16:
            return []
        total, b, a = max((t, -j, -i) for i in range(lo, hi) for j, t in enumerate(itertools.accumulate(step[i:hi]), i + 1))
        a, b = -a, -b
        while a > lo and token[a - 1] not in "/_-":
            a -= 1
        while b < hi and token[b] not in "/_-":
            b += 1
        while cuts := [i for i in range(a, b) if token[i] in "/_-"]:
            parts = [(sum(step[x:y]) / (y - x), x) for x, y in ((a, cuts[0]), (cuts[-1] + 1, b)) if y - x >= secrets.NAME]
            if not parts or min(parts)[0] >= secrets.EDGE:
                break
            a, b = (cuts[0] + 1, b) if min(parts)[1] == a else (a, cuts[-1])
        total = min(total, sum(step[a:b])) if b > a else -math.inf
        if total + model.digit[any(c in "0123456789" for c in token[a:b])] < model.threshold:
            return []
        return look(lo, a) + ([(a, b)] if b - a >= 16 else []) + look(b, hi)

    return look(0, len(token))


def test_secret_scan_equals_plain_patterns(spark):
    rng = random.Random(21)
    hexes, mixed = "0123456789abcdef", secrets.SYMBOLS[:62]
    make = [
        lambda: f"{rng.choice(['password', 'API_KEY', 'apikey', 'Secret', 'token', 'passwd'])}{rng.choice([' = ', ':', '=', ': '])}{rng.choice(['', chr(34)])}{''.join(rng.choice(mixed) for _ in range(rng.randint(3, 12)))}",
        lambda: "AKIA" + "".join(rng.choice(mixed[:26]) for _ in range(rng.randint(10, 20))),
        lambda: "".join(rng.choice(hexes) for _ in range(rng.randint(20, 30))),
        lambda: "".join(rng.choice(mixed) for _ in range(rng.randint(12, 40))),
        lambda: "-".join(rng.choice(secrets.IDENTIFIER_WORDS) for _ in range(4)),
        lambda: "/".join(rng.choice([rng.choice(secrets.IDENTIFIER_WORDS), "".join(rng.choice(mixed) for _ in range(20)), "123e4567-e89b-12d3-a456-426614174000", "20240115"]) for _ in range(4)),
        lambda: rng.choice(["plain", "words", "é你", "\n", "1234567890123456789"]),
    ]
    rows = [(i, " ".join(rng.choice(make)() for _ in range(rng.randint(0, 9)))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.train(secrets.labelled_samples(df))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = {}
    for d, t in rows:
        t = t or ""
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", t):
            more += [(m.start() + x, 3, "markov", m.start() + y) for x, y in plain_secrets(m[0], model) if not any(s < m.start() + y and m.start() + x < e for s, _, _, e in base)]
        of = lambda x: [(k, s, e) for s, _, k, e in sorted(x)]
        kinds = Counter(k for *_, k, _ in base + more)
        want[d] = (*(kinds[k] for k in secrets.KINDS[:3]), sha(of(base)), ",".join(f"{k}:{s}:{e}" for k, s, e in of(base + more)), kinds["markov"])
    got = {r["doc_id"]: tuple(r)[1:] for r in secrets.scan(df, model).collect()}
    assert got == want and sum(w[-1] for w in want.values()) > 5


def test_secret_recall_by_kind(spark):
    model = secrets.train(spark.createDataFrame(secrets.identifier_samples(), "text string, label int"))
    rng = random.Random(33)
    found = lambda make: np.mean([any(k == "markov" for k, _, _ in secrets.all_spans(make(), model)[1]) for _ in range(300)])
    of = lambda alphabet, n: lambda: "".join(rng.choice(alphabet) for _ in range(n))
    assert found(of("abcdefghijklmnopqrstuvwxyz0123456789", 32)) > 0.97 and found(of(secrets.SYMBOLS[:62], 24)) > 0.97
    assert found(of("0123456789abcdef", 20)) > 0.8
    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    model = secrets.train(secrets.labelled_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    # In paths, addresses and file names a secret is found by itself, whatever stands around it, with its whole length.
    names = "users documents reports archive downloads staging annual summary backup".split()
    path = lambda n: "/".join(rng.choice(names) for _ in range(n))
    around = [lambda x: f"{path(4)}/{x}", lambda x: f"{path(9)}/{x}/{path(3)}", lambda x: f"https://www.example.com/{path(2)}/{x}?id=3", lambda x: f"{path(1)}-{x}.json", lambda x: f"{path(2)}_{x}_{path(1)}"]
    for put in around:
        for alphabet in (secrets.SYMBOLS[:62], "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
            hits = 0
            for _ in range(100):
                x = of(alphabet, 20)()
                t = put(x)
                hits += any(k == "markov" and s <= t.index(x) + 2 and t.index(x) + 18 <= e and e - s <= 32 for k, s, e in secrets.all_spans(t, model)[1])
            assert hits >= 90
    assert found(lambda: path(rng.randint(3, 14))) < 0.01
    # Public forms and names are left alone.
    uuid = lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))
    word = lambda: "_".join(rng.choice(secrets.IDENTIFIER_WORDS) for _ in range(4))
    assert found(uuid) == 0 and found(of("0123456789", 24)) == 0 and found(word) < 0.01


# --- 2 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [1 << 20, 60])
def test_longest_matches_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(contamination, "SHARD_BYTES", shard)
    rng = random.Random(3)
    line = lambda n: [rng.choice("abcd") for _ in range(n)]
    rows = [(i, line(rng.randint(0, 14))) for i in range(14)]
    rows += [(20 + i, rows[5][1]) for i in range(4)] + [(None, line(6)), (40, None)]
    items = [(i, line(rng.randint(0, 9))) for i in range(5)]
    df = spark.createDataFrame([(d, " ".join(w) if w is not None else None) for d, w in rows], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = {}
    for i, w in items:
        for k in range(len(w)):
            best = (0,)
            for d, t in rows:
                for p in range(len(t or ())):
                    n = 0
                    while k + n < len(w) and p + n < len(t) and w[k + n] == t[p + n]:
                        n += 1
                    best = max(best, (n, d is None, -(d or 0), -p))
            if best[0] >= 2:
                want[str(i), k] = (best[0], None if best[1] else -best[2], -best[3])
    got = {(r["item_id"], r["item_word"]): (r["n_words"], r["doc_id"], r["doc_word"]) for r in contamination.longest_matches(df, bench).collect()}
    assert got == want


# --- 3 ---------------------------------------------------------------------------------------


def test_quality_equals_plain_counts(spark):
    """Weights from counts of strings, the threshold's k, and the k largest noisy keys."""
    rng = random.Random(12)
    fine, poor = ["sun", "moon", "tree", "river", "Stone", "été"], ["sun", "moon", "buy", "click", "###", "!"]
    rows = [(i, " ".join(rng.choice(fine if i % 3 else poor) for _ in range(rng.randint(0, 120)))) for i in range(90)] + [(200, None), (201, ""), (202, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int")

    def tokens(t):
        return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\s]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))

    of = {d: tokens(t) for d, t in rows}
    good = {i for i in range(0, 90, 2) if i % 3}
    grams = lambda w: [(x,) for x in w] + list(zip(w, w[1:]))
    raw, target = Counter(g for w in of.values() for g in grams(w)), Counter(g for d in good for g in grams(of[d]))
    share = {n: sum(c for g, c in target.items() if len(g) == n) / sum(c for g, c in raw.items() if len(g) == n) for n in (1, 2)}

    def weight(w, own=Counter()):
        parts = [0.0] * -(-len(w) // quality.PASSAGE)
        for n in (1, 2):
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                parts[i // quality.PASSAGE] += (1 if n == 1 else quality.PAIR_SHARE) * math.log((target[g] - own[g] + quality.SMOOTH) / (raw[g] * share[n] + quality.SMOOTH))
        return min(parts) + 0.5 * math.log(len(parts)) if parts else 0.0

    model, scored = quality.fit(df, labels)
    got = {r["doc_id"]: (r["n_grams"], r["log_weight"], r["sample_key"]) for r in scored.collect()}
    assert {d: n for d, (n, _, _) in got.items()} == {d: len(grams(w)) for d, w in of.items()}
    assert all(got[d][1] == pytest.approx(weight(w), abs=1e-9) for d, w in of.items())
    ids = [i for i in range(0, 90, 2)]
    held = [weight(of[i], Counter(grams(of[i])) if i in good else Counter()) for i in ids]
    assert model.threshold == pytest.approx(quality.calibrated(np.array([int(i in good) for i in ids]), np.array(held), quality.MIN_KEEP), abs=1e-9)
    k = sum(w >= model.threshold for _, w, _ in got.values())
    keys = sorted((key for *_, key in got.values()), reverse=True)
    kept = {d for d, (*_, key) in got.items() if key >= keys[k - 1]}
    assert {r["doc_id"] for r in quality.resample(df, labels).collect()} == kept
    noise = np.array([key - w / quality.TEMPERATURE for _, w, key in got.values()])
    assert abs(noise.mean() - 0.577) < 0.5 and noise.std() > 0.5


def test_gumbel_noise_is_gumbel():
    h = common.mix(np.arange(20_000, dtype=np.uint64))
    z = quality.gumbel(h, list(range(20_000)))
    assert abs(z.mean() - 0.5772) < 0.03 and abs(z.std() - math.pi / math.sqrt(6)) < 0.03


# --- 4 ---------------------------------------------------------------------------------------


def test_long_words_are_cut_without_loss():
    from test_text_operators import best_score, small_pieces

    rows, p = small_pieces()
    rng = random.Random(2)
    texts = ["".join(rng.choice(alphabet) for _ in range(400)) for alphabet in ("ab", "abx", "é你a", "ab\U0001f600") for _ in range(4)]
    ids, offs = sentencepiece_codec.encode_texts(texts, p)
    assert sentencepiece_codec.Decoder(p)(ids, offs) == texts
    bytes_ = set(p.byte_id.tolist())
    for t, a, b in zip(texts, offs, offs[1:]):
        own, total, k = ids[a:b].tolist(), 0.0, 0
        while k < len(own):
            if own[k] in bytes_:
                lead = p.bytes_of[own[k]][0]
                k, total = k + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4), total + p.unknown
            else:
                k, total = k + 1, total + p.score[own[k]]
        assert total == pytest.approx(best_score(t, p, rows))


def test_one_word_alone_and_many_together_agree():
    from test_text_operators import small_pieces

    _, p = small_pieces()
    rng = random.Random(4)
    words = ["".join(rng.choice("abé x▁") for _ in range(9)).encode() for _ in range(40)]
    flat, offs = sentencepiece_codec.segment(words, p)
    for w, a, b in zip(words, offs, offs[1:]):
        assert flat[a:b].tolist() == sentencepiece_codec._segment_one(w, p).tolist()


# --- 5 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return pii.fit([[(x, pii.LABELS.index(y)) for x, y in q] for q in pii.labelled_sequences(900, 11)], 120, 0.15, 0.02)


def test_pii_scan_equals_a_plain_decoder(spark, field):
    rng = random.Random(8)
    seqs = pii.labelled_sequences(200, seed=51)
    rows = [(i, " ".join(" ".join(x for x, _ in rng.choice(seqs)) + " " + prose(rng, 0, 12) for _ in range(rng.randint(0, 4)))) for i in range(80)] + [(500, None), (501, "")]

    def plain(t):
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        near = [i for i, (s, e) in enumerate(spans) if re.search("[0-9@]", t[s:e])]
        ok = sorted({j for i in near for j in range(max(0, i - pii.REACH), min(len(spans), i + pii.REACH + 1))})
        out, at = [], 0
        while at < len(ok):
            end = at
            while end + 1 < len(ok) and ok[end + 1] == ok[end] + 1:
                end += 1
            run, at = [spans[i] for i in ok[at : end + 1]], end + 1
            ids = pii.features([t[s:e] for s, e in run], field.names)
            e = [[sum(field.weights[1][f][y] + (field.weights[0][ids[i - 1][j]][y] if i else 0) + (field.weights[2][ids[i + 1][j]][y] if i + 1 < len(run) else 0) for j, f in enumerate(ids[i])) for y in range(5)] for i in range(len(run))]
            best, back = [field.first[y] + e[0][y] for y in range(5)], []
            for i in range(1, len(run)):
                prev = [max(range(5), key=lambda x: (best[x] + field.pairs[x][y], -x)) for y in range(5)]
                best, back = [best[prev[y]] + field.pairs[prev[y]][y] + e[i][y] for y in range(5)], [*back, prev]
            y = max(range(5), key=lambda x: (best[x], -x))
            labels = [y]
            for prev in reversed(back):
                y = prev[y]
                labels.insert(0, y)
            i = 0
            while i < len(run):
                j = i
                while j + 1 < len(run) and labels[j + 1] == labels[i]:
                    j += 1
                if labels[i]:
                    a, b = run[i][0], run[j][1]
                    own = t[a:b]
                    a, b = a + len(own) - len(own.lstrip(pii._EDGE)), b - (len(own) - len(own.rstrip(pii._EDGE)))
                    if a < b and re.search("[0-9@]", t[a:b]):
                        out.append((pii.LABELS[labels[i]], a, b))
                i = j + 1
        return out

    want, added = {}, 0
    for d, t in rows:
        base = pii.base_spans(t or "")
        more = [x for x in plain(t or "") if not any(s < x[2] and x[1] < e for _, s, e in base)]
        added += len(more)
        kinds = Counter(k for k, _, _ in base)
        both = sorted(base + more, key=lambda x: (x[1], pii.KINDS.index(x[0])))
        want[d] = (*(kinds[k] for k in pii.KINDS), sha(base), ",".join(f"{k}:{s}:{e}" for k, s, e in both), len(more))
    got = {r["doc_id"]: tuple(r)[1:] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    assert got == want and added > 20


def test_numbers_that_fail_the_check_are_no_cards(field):
    rng = random.Random(5)
    wrong = right = 0
    for _ in range(300):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        check = next(c for c in "0123456789" if pii.luhn(digits + c))
        bad = rng.choice([c for c in "0123456789" if c != check])
        sep = rng.choice([".", "/", " "])
        show = lambda c: "paid with " + sep.join((digits + c)[i : i + 4] for i in range(0, 16, 4)) + " today"
        wrong += any(k == "card" for k, _, _ in pii.all_spans([show(bad)], field)[0][1])
        right += any(k == "card" for k, _, _ in pii.all_spans([show(check)], field)[0][1])
    assert wrong <= 6 and right >= 290


# --- 8 ---------------------------------------------------------------------------------------


def test_language_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(2)
    wide, nf, e = max(language.WIDTHS), language.FILTERS * len(language.WIDTHS), language.EMBED
    mask = np.concatenate([np.repeat(np.arange(wide) < w, e)[:, None].repeat(language.FILTERS, 1) for w in language.WIDTHS], axis=1)
    f32 = lambda *s: rng.normal(size=s).astype(np.float32)
    net = language.ByteNet(["p", "q", "r"], f32(256, e), f32(wide * e, nf) * mask, f32(nf), f32(nf, 3), f32(3))
    rows = [(1, "abc def"), (2, "x" * 700), (3, "é" * 130), (4, "12 34"), (5, None), (6, "")]
    want = {}
    for d, t in rows:
        raw = (t or "").encode()
        total = np.zeros(3)
        for at in range(0, len(raw), language.WINDOW):
            own = raw[at : at + language.WINDOW]
            padded = [*own, *[0] * (language.WINDOW - len(own) + wide - 1)]
            top = np.array([max(sum(net.embed[padded[p + i // e]][i % e] * net.conv[i, f] for i in range(wide * e)) for p in range(language.WINDOW)) for f in range(0, nf, 7)])
            full = np.array([max(np.dot(net.embed[padded[p : p + wide]].ravel(), net.conv[:, f]) for p in range(language.WINDOW)) for f in range(nf)])
            assert np.allclose(full[::7], top, atol=1e-3)
            z = np.maximum(full + net.bias, 0) @ net.out + net.out_bias
            total += len(own) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        letter = any(c.isalpha() for c in t or "")
        p = np.exp(total / max(1, len(raw)))
        p /= p.sum()
        want[d] = (net.langs[int(p.argmax())], float(p.max())) if letter else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    assert {d: x for d, (x, _) in got.items()} == {d: x for d, (x, _) in want.items()}
    assert all(got[d][1] == pytest.approx(s, abs=1e-3) for d, (_, s) in want.items())


# --- 9 ---------------------------------------------------------------------------------------

WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at apache org licenses."""


def test_wrapped_and_unseen_licences(spark):
    model = licenses.train(licenses.labelled_table(spark))
    rows = [(1, f"Some words.\n\n{WRAPPED}\n\nmore words"), (2, f"{HEADER}\n\nCode follows."), (3, "Released under the Artistic License 2.0."), (4, "Available under the Quokka Software License, version 3.1"), (5, "Sie ging mit ihm."), (6, f"{HEADER}\n \nReleased under the MIT License.")]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert (out[1]["families"], out[1]["confirmed"], out[1]["n_licenses"], out[1]["n_unknown"]) == ("mit", "mit", 1, 0)
    assert (out[2]["families"], out[2]["confirmed"], out[2]["n_licenses"]) == ("apache", "apache", 1)
    assert [(out[i]["families"], out[i]["n_unknown"]) for i in (3, 4, 5)] == [("", 1), ("", 1), ("", 0)]
    assert out[6]["confirmed"] == "apache,mit" and [p["paragraph"] for p in out[6]["paragraphs"]] == [0, 1]


#: Written by hand, apart from the rows that the model is trained on.
NAMED = [
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED AS IS"), ("mit", "SPDX-License-Identifier: MIT"),
    ("agpl", "This file is part of Foo, which is free software: you can redistribute it under the terms of the GNU Affero General Public License, version 3"), ("mit", "Der Quelltext ist unter der MIT-Lizenz veröffentlicht."),
    ("apache", "Copyright 2019 The Authors. Use of this source is governed by the Apache License 2.0 that can be found in the LICENSE file."), ("gpl", "foo is distributed under the GPL (v2 or later)"), ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"), ("mpl", "This file is licensed under MPL 2.0, see the Mozilla Public License"), ("lgpl", "libfoo is covered by the GNU Lesser GPL"), ("cc-by", "Content licensed under CC BY 4.0 unless noted"),
    ("apache", "// SPDX-License-Identifier: Apache-2.0"), ("public-domain", "The author dedicates this work to the public domain"), ("boost", "Use, modification and distribution are subject to the Boost Software License, Version 1.0"),
    ("epl", "All rights reserved. This program is made available under the terms of the Eclipse Public License v2.0"), ("mit", "Licensed under MIT"), ("gpl", "Ce programme est un logiciel libre sous licence GNU GPL version 3"), ("zlib", "This library is under the zlib/libpng license"),
    ("proprietary", "Alle Rechte. (c) 2014 Example GmbH. All rights reserved."), ("cc-by-nc", "Images: CC BY-NC 4.0, Creative Commons"),
]
NOT_NAMED = """a driving licence under the new law|the terms of the software license agreement|She lost her pilot's license after the accident.|The MIT Press published the book.|An apache warrior rode by|The gnu is a large antelope
He holds a master's degree from MIT and a fishing licence.|license plates were stolen in the public car park|The creative commons room is open to all.|Permission was granted to enter the source of the river|Le permis de conduire et la licence de droit sont distincts
Lizenzspieler dürfen nicht wechseln|The public license office opens at nine|Copyright law in the European Union was reformed|the lesser of two evils|all rights of passage were reserved for ships|Redistribution of income is a political question.
the software was distributed freely in the 1980s|We discussed the boost in sales and the eclipse of the sun|the domain name is public""".replace("\n", "|").split("|")


def test_licences_of_another_origin(spark):
    model = licenses.train(licenses.labelled_table(spark))
    rows = [(i, t) for i, t in enumerate([t for _, t in NAMED] + NOT_NAMED)]
    out = {r["doc_id"]: r["families"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum(f in out[i] for i, (f, _) in enumerate(NAMED)) >= 0.8 * len(NAMED)
    assert sum(out[len(NAMED) + i] != [""] for i in range(len(NOT_NAMED))) <= 1


def test_labelled_rows_are_chosen_by_hash_from_all_families(spark):
    model = licenses.train(licenses.labelled_table(spark), max_rows=600, steps=20)
    assert set(model.classes) >= {"apache", "mit", "public-domain", "proprietary", "unknown", "none"}


def test_licences_equal_a_plain_scorer(spark):
    model = licenses.train(licenses.labelled_table(spark))
    rng = random.Random(6)
    pool = [r["text"] for r in licenses.labelled_table(spark, 6, seed=91).collect()] + ["", "und mit dem Zug", *WRAPPED.split("\n")]
    rows = [(i, "".join(rng.choice(pool) + rng.choice(["\n", "\n", "\n\n", "\n \t\n", ". "]) for _ in range(rng.randint(0, 7)))) for i in range(60)] + [(100, None), (101, "")]

    def words(t):
        return [w for w in re.sub(r"[\W_]+", " ", t.lower()).split(" ") if w]

    def plain(t):
        out = []
        for k, p in enumerate(re.split(r"\n[ \t\r]*\n", t or "")):
            lines = []
            for i, line in enumerate([p] * ("\n" in p) + p.split("\n"), -int("\n" in p)):
                w = words(line)
                f = {x for x in w if x not in licenses.COMMON and not re.fullmatch("[0-9]+", x)} | {f"{a} {b}" for a, b in zip(w, w[1:]) if not (a in licenses.COMMON and b in licenses.COMMON)}
                z = (np.array(model.bias) + sum((np.array(model.weights[x]) for x in f if x in model.weights), np.zeros(len(model.bias)))) / model.temperature
                e = np.exp(z - z.max())
                y = model.classes[int(e.argmax())]
                if y != "none":
                    q = round(float(1 / e.sum()), 6)
                    lines.append((y if 1 / e.sum() >= model.threshold else "unknown", q, i))
            own = set(words(p))
            best = {}
            for y, q, i in lines:
                if y not in best or (i >= 0, q) > (best[y][1] >= 0, best[y][0]):
                    best[y] = (q, i)
            like = {y: max((len(own & set(licenses._words(s))) / len(set(licenses._words(s))) for s in licenses.known_texts(y) if y != "unknown"), default=0.0) for y in best}
            sure = {y for y in best if y != "unknown" and like[y] >= 0.7}
            out += [(k, i, y, y in sure) for y, (q, i) in best.items() if y != "unknown" or not sure]
        return sorted(out)

    got = {r["doc_id"]: sorted((x["paragraph"], x["line"], x["family"], x["confirmed"]) for x in r["paragraphs"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {d: plain(t) for d, t in rows} and sum(len(x) for x in got.values()) > 40


# --- 10 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprints_equal_plain_windows(spark, parts):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abé\U0001f600 ") for _ in range(rng.choice([0, 1, 10, 19, 20, 21, 60, 61, 200])))) for i in range(40)] + [(50, None), (51, "a" * 300)]
    gram, window = fingerprints.GRAM, fingerprints.WINDOW
    one = lambda g: int(fingerprints.winnow(fingerprints.code_points(g))[0][0])

    def plain(t):
        h = [one(t[i : i + gram]) for i in range(max(1, len(t) - gram + 1))] if t else []
        places = {s + max(i for i, x in enumerate(h[s : s + window]) if x == min(h[s : s + window])) for s in range(max(1, len(h) - window + 1))} if h else set()
        return [(h[p], p) for p in sorted(places)]

    like = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / len({h for h, _ in a} | {h for h, _ in b}) if a or b else 1.0
    text = lambda f: " ".join(f"{h:08x}:{p}" for h, p in f)
    want = {}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, n = plain(t), plain(edited), plain(after)
        want[d] = (text(a), text(b), like(a, b), like(a, n))
    got = {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprints.neighbours(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()}
    assert got == want


# --- shared parts ----------------------------------------------------------------------------


def test_pieces_cover_every_stretch_once():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 5, 30, 64, 65, 400]))) for _ in range(40)] + [None]
    seen = Counter()
    for buf, offs, row, base in common.pieces(pa.array(texts, pa.string()), 9, 64):
        for d in range(len(row)):
            own = buf[offs[d] : offs[d + 1]].tobytes()
            raw = (texts[row[d]] or "").encode()
            assert raw[base[d] : base[d] + len(own)] == own
            seen.update((int(row[d]), int(base[d]) + k) for k in range(len(own) - 9))
    assert seen == Counter((i, k) for i, t in enumerate(texts) for k in range(len((t or "").encode()) - 9))


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(900, 901), (901, 900)], "a long, b long")
    got = dict(tuple(r) for r in graph.components(edges).collect())
    assert got == {i: 0 for i in range(200)} | {900: 900, 901: 900}
    assert graph.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("fan_out", [2, 3])
def test_ngrams_are_dealt_in_levels(spark, monkeypatch, fan_out):
    rows = spark.createDataFrame([(" ".join(f"w{(i * 7 + j) % 90}" for j in range(30)),) for i in range(40)] + [(None,)], "__rv_text string")
    read = lambda df: sorted((int(g), int(n)) for r in df.collect() for g, n in zip(np.cumsum(ngram_join.unpack(r["grams"], np.uint64), dtype=np.uint64), np.frombuffer(r["nodes"], np.int64)[ngram_join.unpack(r["owners"], np.uint32)]))
    none = np.zeros(0, np.uint64)
    want = ngram_join.packed(rows, 4, none, 1)
    monkeypatch.setattr(ngram_join, "FAN_OUT", fan_out)
    got = ngram_join.packed(rows, 4, none, 11)
    assert set(read(got)) == set(read(want))
    by = {}
    for r in got.collect():
        for g in np.cumsum(ngram_join.unpack(r["grams"], np.uint64), dtype=np.uint64):
            assert by.setdefault(int(g), r["range"]) == r["range"]
    assert len(set(by.values())) > 5


OPERATORS = {
    "secrets": lambda s, d: secrets.scan(d, secrets.train(secrets.labelled_samples(d))),
    "contamination": lambda s, d: contamination.scan(d, s.createDataFrame([(1, "mi lo ka"), (None, "ka ka lo"), (2, None)], "item_id long, text string")),
    "quality": lambda s, d: quality.score(d, quality.train(d, s.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int"))),
    "sentencepiece": lambda s, d: sentencepiece_codec.encode_checked(d, sentencepiece_codec.load()),
    "pii": lambda s, d: pii.scan(d, pii.train(pii.labelled_table(s, 100), steps=5)),
    "substrings": lambda s, d: substring_dedup.dedup(d),
    "ngrams": lambda s, d: ngram_join.classes(d),
    "language": lambda s, d: language.predict(d, language.train(d.withColumn("lang", F.lit("x")))),
    "licenses": lambda s, d: licenses.scan(d, licenses.train(licenses.labelled_table(s, 4), steps=20)),
    "fingerprints": lambda s, d: fingerprints.neighbours(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, docs, name):  # noqa: F811
    """Nulls, repeats, an empty table, very long texts, and columns that are named like outputs or helpers."""
    rng = random.Random(1)
    long = [(801, " ".join(rng.choice(["lo", "mika", "ro", "12", "a@b.cd"]) for _ in range(60_000))), (802, "".join(rng.choice("lomikaro") for _ in range(30_000))), (803, "\U0001f600" * 9_000)]
    odd = docs.select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string"))
    for c in ("n_chars", "spans", "ids", "node", "score", "component_id", "lang_pred", "paragraphs", "n_words", "log_weight", "quality", "data"):
        odd = odd.withColumn(c, F.lit("clash"))
    out = OPERATORS[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    twins = {}
    for r in out:
        if name not in ("ngrams", "fingerprints") and r["doc_id"] == 3:
            twins.setdefault(tuple(map(str, r)), 0)
    assert len(twins) <= 1
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, clashing names, no n_chars, and empty tables."""
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven"), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(1, "a fine text of some words that stands here", "en", 3), (1, "a fine text of some words that stands here", None, None), (None, "mail bob@example.com now", None, None), (4, None, "x", None), (5, "", "x", 0)]
    rows += [(6, "x one two three four five six seven eight nine ten y", "x", 1), (8, "mail bob@example.com now and then, as one does", "x", 1)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for df in (docs_, docs_.drop("n_chars")):
        out = {name: f(spark, df, sf) for name, f in stages.items()}
        assert all(out[n].columns == df.columns for n in list(stages)[:-1])
        assert out["quality classifier"].count() <= len(rows)
        assert Counter(r["doc_id"] for r in out["n-gram jaccard join"].collect()) == {1: 1, None: 1, 4: 1, 5: 1, 6: 1, 8: 1}
        assert {r["doc_id"] for r in out["benchmark decontamination"].collect()} == {1, None, 4, 5, 8}
        masked = {r["doc_id"]: r["text"] for r in out["pii"].collect()}
        assert masked[8].startswith("mail <EMAIL> now") and masked[4] is None and masked[None] == "mail <EMAIL> now"
        coded = {r["doc_id"]: (r["piece_ids"], r["n_pieces"], r["round_trip"]) for r in out["sentencepiece"].collect()}
        assert coded[4] == (None, None, True) and coded[5] == ([], 0, True) and all(x[2] for x in coded.values())
        assert all(f(spark, df.limit(0), sf).count() == 0 for f in stages.values())


def test_shared_folder_is_asked_for(spark, monkeypatch):
    """On a cluster without spark.checkpoint.dir there is an error, not a folder of one machine."""

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isEmpty():
            return True

    class Frame:
        class sparkSession:
            sparkContext = Context
            conf = {"spark.checkpoint.dir": None}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.cut(Frame)
