"""Licence scans with a trained paragraph classifier, in DataFrame functions only.

A text is cut into paragraphs at blank lines; a paragraph is classified as a whole, as a notice may be wrapped over many lines, and
line by line, as a licence may be a line of its own in running text.  Sparse binary features of either, the word 1- and
2-grams, go into a multinomial logistic regression over licence families, `unknown` (a
licence of another family) and `none` (no licence).  A family is reported if its calibrated
probability reaches the threshold; less sure licence lines are `unknown`.
Comparison of the whole paragraph with the family's templates then confirms a prediction or not, and a family counts once
in a paragraph, on whichever of its lines it is found; `unknown` counts where the paragraph has no confirmed family.

Scoring is one expression for each row: no join, no shuffle.  Only lines
with a cue word are scored; the cues are derived from the weights so that no
other line can be anything but `none` (see `cues`).  Training uses a small
labelled table; features of it are made by the same expression.

Defined results: null and empty texts have no paragraphs; texts of any length are scanned whole; of families with equal
probabilities the first by name is taken (`none` last); labelled rows with a null text have no features, those with a null
family are left out; repeated rows get the same result each; rows without an id are scanned as all others; an empty table
gives an empty result; other columns are ignored, whatever their names (but for those that begin with `__rv_`).
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# Short public licence phrases, by family.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License; you may obtain a copy of the License at apache org licenses"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "See accompanying file LICENSE or copy at boost org LICENSE"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Distributed under the BSD 3-Clause License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "epl": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "Copyright 2020. All rights reserved.", "No part of this publication may be reproduced without prior written permission"],
    "public-domain": ["This work has been released into the public domain.", "CC0 1.0 Universal Public Domain Dedication", "This is free and unencumbered software released into the public domain"],
    "zlib": ["Subject to the terms of the zlib license.", "This software is provided as is, without any express or implied warranty; in no event will the authors be held liable for any damages arising from the use of this software"],
    "unknown": ["Licensed under the European Union Public Licence.", "Distributed under the Artistic License 2.0.", "Use is subject to the license agreement.", "Licensed under the Open Data Commons license."],
}
# Short identifiers and names of the licences.
IDENTIFIERS = {
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "apache": ["Apache-2.0"], "boost": ["BSL-1.0"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "epl": ["EPL-2.0"],
    "gpl": ["GPL-3.0-or-later", "GPL-2.0-only"], "isc": ["ISC"], "lgpl": ["LGPL-2.1-only", "LGPL-3.0-or-later"], "mit": ["MIT"], "mpl": ["MPL-2.0"], "public-domain": ["CC0-1.0", "Unlicense"], "zlib": ["Zlib"],
}
NAMES = {
    "agpl": ["GNU AGPL", "AGPL v3", "GNU Affero GPL"], "apache": ["Apache", "Apache 2.0"], "boost": ["Boost Software", "Boost"], "bsd": ["BSD", "3-Clause BSD", "New BSD"], "cc-by": ["Creative Commons Attribution", "CC BY"], "cc-by-nc": ["Creative Commons Attribution NonCommercial", "CC BY-NC"],
    "cc-by-sa": ["Creative Commons Attribution ShareAlike", "CC BY-SA"], "epl": ["Eclipse Public", "EPL"], "gpl": ["GNU GPL", "GPL v3", "GNU General Public"], "isc": ["ISC"], "lgpl": ["GNU LGPL", "LGPL", "GNU Lesser General Public"], "mit": ["MIT"], "mpl": ["Mozilla Public", "MPL 2.0"], "zlib": ["zlib"],
}
# How licences are named in four languages, and ordinary uses of the word.
SAID = "Released under the {} License.|This project is licensed under the terms of the {} license.|License: {}|{} Licensed|The code is available under the {} licence.|Veröffentlicht unter der {}-Lizenz.|Lizenziert unter der {} Lizenz.|Dieses Werk steht unter der {}-Lizenz.|Publié sous licence {}.|Ce logiciel est distribué sous la licence {}.|Publicado bajo la licencia {}.|Este programa se distribuye bajo licencia {}.".split("|")
NAMED = "{} was mentioned in the talk|we met {} people at the fair|the {} building is large|she works with {} every day|the {} team won again|a story about {} and the sea|they saw the {} from the hill|an old {} stood there".split("|")
KINDS_OF_PERMIT = "driving fishing hunting gun marriage liquor taxi broadcasting pilot export trading dog television mining".split()
USES = "a {} {} under the new law|her {} {} was revoked by the court|the {} {} costs ten euros a year|they applied for a {} {} in the city|no {} {} is needed to work here|the {} {} expired and the terms were discussed|the office grants a {} {} to any person".split("|")
# Longer public licence notices, which are training rows and templates as a whole, and rows as wrapped lines.
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. See the GNU Affero General Public License for more details."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https www eclipse org legal epl-2.0"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. See the GNU Lesser General Public License for more details."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla org MPL 2.0."],
}
# Ordinary sentences in which licence words occur, or nothing of them does.
ORDINARY = """She renewed her driving license last year.|The fishing license costs ten dollars.|He went to MIT to study physics.|An Apache helicopter flew over the river.|The gnu grazed near the water.
All rights and duties follow from the contract.|The committee reserved the room for noon.|Creative people work in commons and parks.|The version of the story was new.|The software was released in spring.
Permission to land was granted at once.|Public transport was free of charge.|The general spoke in public.|They share alike in the work.|The copyright law was debated in parliament.
No part of the bridge was open.|Source and binary numbers were printed.|Attribution of the painting is unclear.|The domain of the function is open to the public.|Redistribution of land was slow.
Er kam mit dem Zug und mit der Bahn.|Sie geht mit ihm in die Stadt.|Wir reisen mit Freunden.|Sa maison est belle et sa mère aussi.|A person made a copy of the form.|Use the data in other forms.|The program came with software.|The terms of the international treaty were subject to change.
They modify the engine except on Sunday.|Food was provided and distributed to the domain.|A creative person will obtain a copy.|The book was released by a publication house.|Women fought for equal rights.|The rights of way were reserved for carts.|All seats and rights were kept in reserve.|Cc the mail to the boss.|Nc and sa are short forms.|Boost the engine and use the data.
The lesser evil was permitted.|The European Union met in spring.|Lunar eclipse in spring, an attribution error in the data.|The form was reproduced in the program.|He was obtaining a modification of the software.""".replace("\n", "|").split("|")
# Words of which a wrapped line of a notice must have two to be a training row.
_TELLING = set("license licensed gnu general lesser public apache mozilla redistribution redistributions redistribute binary source permission granted charge person obtaining copy software sublicense merge conditions copyright warranties warranty".split())
# Words that are no feature alone.
COMMON = "a an and any are as at be by can for from has have in into is it its may not of on or that the this to under was were with you your".split()


@dataclass(frozen=True)
class LicenseModel:
    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def features_of(words: Column) -> Column:
    """Distinct content words, and pairs of neighbours with a content word, as 'a b'."""
    common = F.array(*map(F.lit, COMMON))
    single = F.filter(words, lambda w: ~F.array_contains(common, w) & ~w.rlike("^[0-9]+$"))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull() & ~(F.array_contains(common, a) & F.array_contains(common, b)), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(single, F.array_compact(pairs)))


def labelled_table(spark: SparkSession, n: int = 40, seed: int = 7) -> DataFrame:
    """(text, family): the templates and ordinary sentences, varied by rule."""
    r = random.Random(seed)
    filler = "project code book dataset page text river model data note article house story image music public open free work".split()
    rows = []
    for family, templates in TEMPLATES.items():
        rows += [(t, family) for t in templates]
        for i, said in enumerate(SAID * (family in NAMES)):
            rows += [(said.format(name), family) for name in NAMES[family] for _ in range(2 if i < 2 else 1)]
        for name in IDENTIFIERS.get(family, ()):
            rows += [(f"{mark}SPDX-License-Identifier: {name}", family) for mark in ("", "// ", "# ")] + [(f"License: {name}", family), (f"license = {name}", family)]
        for notice in NOTICES.get(family, ()):
            words = notice.split()
            rows += [(notice, family)] * 3
            for width in (7, 9, 11, 13):  # wrapped lines that name something
                rows += [(line, family) for i in range(0, len(words), width) if len(set((line := " ".join(words[i : i + width])).lower().split()) & _TELLING) >= 2]
        for _ in range(n):
            w = r.choice(templates).split()
            w = [x if not any(c.isdigit() for c in x) else f"{r.randint(1, 4)}.{r.randint(0, 1)}" for x in w]
            if len(w) > 8:
                a = r.randint(0, len(w) - 8)
                w = w[a : a + r.randint(8, len(w))]
            w = [r.choice(filler) for _ in range(r.randint(0, 3))] + w + [r.choice(filler) for _ in range(r.randint(0, 3))]
            t = " ".join(w)
            rows.append((t.replace("icense", "icence") if r.random() < 0.1 else t, family))
    # Licences of names that no family has.
    name = lambda: "".join(r.choice(["ar", "ben", "cor", "del", "em", "fin", "gal", "hor", "il", "jun", "kel", "lum"]) for _ in range(r.randint(2, 3))).title()
    for _ in range(3 * n):
        verb, noun = r.choice(["Released", "Licensed", "Distributed", "Available", "Provided", "Published"]), r.choice(["License", "License", "Public License", "Software License", "Licence"])
        rows.append((f"{verb} under the {name()} {noun}{r.choice(['', '.', f' {r.randint(1, 4)}.{r.randint(0, 9)}.', f', version {r.randint(1, 4)}.{r.randint(0, 9)}.'])}", "unknown"))
    for use in USES:
        rows += [(use.format(kind, word), "none") for kind in KINDS_OF_PERMIT for word in ("licence", "license")]
    for word in ("Lizenz", "Fahrlizenz", "licence de chasse", "licence de pêche", "licencia de conducir", "licencia de caza"):
        rows += [(said.format(word), "none") for said in ("Er verlor seine {} im Sommer.", "Elle a perdu sa {}.", "La {} cuesta diez euros.", "Ohne {} darf er nicht spielen.")]
    for said in ("the terms of the {} agreement were discussed for hours", "they signed the {} agreement in spring", "a {} fee is paid each year", "the {} server was down", "the board renewed the {} contract"):
        rows += [(said.format(x), "none") for x in ("software license", "license", "software licence", "music licensing", "patent license", "franchise licence")]
    for name in ("MIT", "Apache", "Boost", "boost", "Eclipse", "eclipse", "Mozilla", "GNU", "BSD", "Unlicense", "CC"):
        rows += [(use.format(name), "none") for use in NAMED]
    for t in ORDINARY:
        rows += [(t, "none"), (f"{t} {' '.join(r.choice(filler) for _ in range(4))}", "none")]
    for _ in range(2 * n):
        rows.append((f"{' '.join(r.choice(filler) for _ in range(r.randint(0, 3)))} {r.choice(ORDINARY)}", "none"))
    rows += [(" ".join(r.choice(filler + COMMON) for _ in range(r.randint(1, 12))), "none") for _ in range(4 * n)]
    return spark.createDataFrame(rows, "text string, family string")


def train(rows: DataFrame, max_rows: int = 20_000, steps: int = 400, rate: float = 3.0, sparsity: float = 8e-4, lead: float = 1.0, least: int = 3) -> LicenseModel:
    """Fits the regression to a labelled table (text, family) of at most max_rows rows or so, chosen by hash; every fifth row
    (by hash) is held back to calibrate the temperature."""
    rows = rows.where("family is not null").select(F.coalesce("text", F.lit("")).alias("text"), "family").groupBy("text", "family").agg(F.count("*").alias("n"))
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("text", "family"), F.lit(1 << 30)) < F.lit((1 << 30) * max_rows // total))
    got = rows.select(features_of(words_of(F.coalesce("text", F.lit("")))).alias("f"), "family", "text", "n", (F.pmod(F.xxhash64("text", "family"), F.lit(5)) == 0).alias("held")).collect()
    got = sorted(got, key=lambda r: (r["family"], r["text"]))
    classes = sorted({r["family"] for r in got} - {"none"}) + ["none"]
    counts: dict[str, int] = {}
    for r in got:
        for f in r["f"]:
            counts[f] = counts.get(f, 0) + r["n"]
    names = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    x = np.zeros((len(got), len(names)), np.float32)
    for i, r in enumerate(got):
        x[i, [names[f] for f in r["f"] if f in names]] = 1
    y = np.array([classes.index(r["family"]) for r in got])
    held = np.array([r["held"] for r in got])
    one = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    times = np.array([r["n"] for r in got], float)
    share = (one * times[:, None])[~held].sum(axis=0)
    cost = (times / np.sqrt(np.maximum(share, 1))[y])[~held]  # between equal rows and equal classes
    cost /= cost.sum()
    seen, want, cost = x[~held], one[~held], cost.astype(np.float32)[:, None]
    for _ in range(steps):
        g = (softmax(seen @ w + b) - want) * cost
        w -= rate * (seen.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)  # proximal step of the absolute-value penalty
        b -= rate * g.sum(axis=0)
    used = np.abs(w).sum(axis=1) > 0
    names, x, w = {f: k for k, f in enumerate(f for f, i in names.items() if used[i])}, x[:, used], w[used]
    b[-1] += lead  # no licence is the usual case
    z = x[held] @ w + b if held.any() else x @ w + b
    yz = y[held] if held.any() else y
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(softmax(z / t)[np.arange(len(yz)), yz] + 1e-12).mean())
    p = softmax(z / temperature)
    wrong = p[np.arange(len(p)), p.argmax(axis=1)][p.argmax(axis=1) != yz]
    threshold = float(min(0.7, max(0.5, np.quantile(wrong, 0.9) if len(wrong) else 0.5)))
    return LicenseModel(classes, {f: [round(float(v), 4) for v in w[i]] for f, i in names.items()}, [round(float(v), 4) for v in b], temperature, threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cues(model: LicenseModel) -> list[str]:
    """Words of which a paragraph needs one to be anything but `none`.

    For every class, the gains over `none` of all features without a cue sum to less than the
    lead that `none` has by its bias; features are binary, so no text without a cue gets further."""
    lead = np.array(model.bias[-1]) - np.array(model.bias[:-1])
    gain = {f: np.maximum(0, np.array(w[:-1]) - w[-1]) for f, w in model.weights.items()}
    rest, out = dict(gain), []
    while (over := sum(rest.values(), np.zeros(len(lead))) - lead).max() >= 0:
        worst = int(over.argmax())
        by_word: dict[str, float] = {}
        for f, g in rest.items():
            for w in set(f.split()) - set(COMMON):
                by_word[w] = by_word.get(w, 0.0) + g[worst]
        word = max(sorted(by_word), key=by_word.get)
        out.append(word)
        rest = {f: g for f, g in rest.items() if word not in f.split()}
    return out


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text: str = "text", confirm: float = 0.7) -> DataFrame:
    """id, n_licenses (families found, in each paragraph), families (found), confirmed (families whose templates agree), n_unknown and
    paragraphs (an array of paragraph, line in it, family, probability, template likeness, confirmed)."""
    # A cue is a whole word: what stands beside it is no letter or digit (other than ASCII ones may, which only scores more lines).
    cue = r"(?:^|[^a-z0-9])(?:" + "|".join(sorted(cues(model))) + r")(?![a-z0-9])"
    has_cue = lambda t: F.lower(t).rlike(cue)
    names = F.array(*map(F.lit, model.classes))
    vocabulary = F.array(*map(F.lit, model.weights))
    table = F.create_map(*[x for f, w in model.weights.items() for x in (F.lit(f), F.array(*map(F.lit, w)))])
    templates = {c: [sorted(set(_words(t))) for t in known_texts(c)] for c in model.classes}
    rows = docs.select(F.col(id_col), F.col(text).alias("__rv_text"))
    scored = lambda lines: F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.array_intersect(features_of(words_of(x["p"])), vocabulary).alias("f")))
    logits = lambda f: F.aggregate(f, F.array(*map(F.lit, model.bias)), lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
    # A paragraph as a whole is line -1, if it has several lines.
    parts = lambda p: F.concat(F.when(F.contains(p, F.lit("\n")), F.array(p)).otherwise(F.array().cast("array<string>")), F.split(p, "\n"))
    cue_lines = lambda p: F.filter(F.transform(parts(p), lambda t, i: F.struct((i - F.when(F.contains(p, F.lit("\n")), 1).otherwise(0)).cast("long").alias("line"), t.alias("p"))), lambda x: has_cue(x["p"]))
    cut = F.filter(F.transform(F.split(F.col("__rv_text"), r"\n[ \t\r]*\n"), lambda p, i: F.struct(i.cast("long").alias("k"), p.alias("p"))), lambda x: has_cue(x["p"]))
    none = F.array().cast("array<struct<k:bigint,p:string>>")
    # Each step is a column of its own, so that no expression is evaluated anew for each use.
    step = lambda df, old, new, f: df.select(id_col, F.transform(old, f).alias(new))
    rows = rows.select(id_col, F.when(has_cue(F.col("__rv_text")), cut).otherwise(none).alias("__rv_a"))
    rows = step(rows, "__rv_a", "__rv_b", lambda x: F.struct(x["k"].alias("k"), x["p"].alias("p"), scored(cue_lines(x["p"])).alias("l")))
    each = lambda x, f: F.struct(x["k"].alias("k"), x["p"].alias("p"), F.transform(x["l"], f).alias("l"))
    rows = step(rows, "__rv_b", "__rv_c", lambda x: each(x, lambda y: F.struct(y["line"].alias("line"), F.transform(logits(y["f"]), lambda v: v / model.temperature).alias("z"))))
    rows = step(rows, "__rv_c", "__rv_d", lambda x: each(x, lambda y: F.struct(y["line"].alias("line"), F.transform(y["z"], lambda v: F.exp(v - F.array_max(y["z"]))).alias("e"))))
    prob = lambda y: F.lit(1.0) / F.aggregate(y["e"], F.lit(0.0), lambda a, b: a + b)
    best = lambda y: F.element_at(names, F.array_position(y["e"], F.lit(1.0)).cast("int"))
    rows = step(rows, "__rv_d", "__rv_e", lambda x: each(x, lambda y: F.struct(y["line"].alias("line"), best(y).alias("best"), prob(y).alias("p"))))
    told = lambda y: F.struct(y["line"].alias("line"), F.when(y["p"] >= model.threshold, y["best"]).otherwise("unknown").alias("family"), F.round(y["p"], 6).alias("p"))
    rows = step(rows, "__rv_e", "__rv_f", lambda x: F.struct(x["k"].alias("k"), x["p"].alias("p"), F.transform(F.filter(x["l"], lambda y: y["best"] != "none"), told).alias("l")))
    # Only paragraphs in which something was found are compared with templates, as a whole.
    rows = rows.select(id_col, F.transform(F.filter("__rv_f", lambda x: F.size(x["l"]) > 0), lambda x: F.struct(x["k"].alias("k"), F.array_distinct(words_of(x["p"])).alias("w"), x["l"].alias("l"))).alias("__rv_g"))

    def likeness(family: Column, words: Column) -> Column:
        out = F.lit(0.0)
        for c, sets in templates.items():
            if sets and c not in ("unknown", "none"):
                out = F.when(family == c, F.greatest(*[F.size(F.array_intersect(words, F.array(*map(F.lit, s)))) / F.lit(float(len(s))) for s in sets], F.lit(0.0))).otherwise(out)
        return out

    # A family's line with the highest probability speaks for it in a paragraph (the first such line), the whole paragraph only where no line does.
    whole = lambda y: y["line"] < 0
    ahead = lambda o, y: (~whole(o) & whole(y)) | ((whole(o) == whole(y)) & ((o["p"] > y["p"]) | ((o["p"] == y["p"]) & (o["line"] < y["line"]))))
    lead = lambda x, y: ~F.exists(x["l"], lambda o: (o["family"] == y["family"]) & ahead(o, y))
    rows = step(rows, "__rv_g", "__rv_h", lambda x: F.struct(x["k"].alias("k"), x["w"].alias("w"), F.filter(x["l"], lambda y: lead(x, y)).alias("l")))
    shown = lambda x, y: F.struct(x["k"].alias("paragraph"), y["line"].alias("line"), y["family"].alias("family"), y["p"].alias("probability"), F.round(likeness(y["family"], x["w"]), 6).alias("likeness"))
    rows = rows.select(id_col, F.transform("__rv_h", lambda x: F.transform(x["l"], lambda y: shown(x, y))).alias("__rv_i"))
    sure = lambda y: (y["family"] != "unknown") & (y["likeness"] >= confirm)
    rows = rows.select(id_col, F.flatten(F.transform("__rv_i", lambda l: F.filter(l, lambda y: (y["family"] != "unknown") | ~F.exists(l, sure)))).alias("__rv_j"))
    rows = rows.select(id_col, F.transform("__rv_j", lambda y: F.struct(*[y[c].alias(c) for c in ("paragraph", "line", "family", "probability", "likeness")], sure(y).alias("confirmed"))).alias("paragraphs"))
    known = F.filter("paragraphs", lambda x: x["family"] != "unknown")
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["family"]))), ",")
    return rows.select(
        id_col,
        F.size(known).cast("long").alias("n_licenses"),
        (F.size("paragraphs") - F.size(known)).cast("long").alias("n_unknown"),
        listed(known).alias("families"),
        listed(F.filter("paragraphs", lambda x: x["confirmed"])).alias("confirmed"),
        "paragraphs",
    )


def known_texts(family: str) -> list[str]:
    """Templates of a family: its phrases, its notices and its names."""
    said = [f"{n} {w}" for n in NAMES.get(family, ()) for w in ("license", "licence", "lizenz", "licencia", "licensed")]
    return [*TEMPLATES.get(family, ()), *NOTICES.get(family, ()), *said, *(f"license {n}" for n in IDENTIFIERS.get(family, ()))]


def _words(t: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if not any(c.isdigit() for c in w)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), train(labelled_table(spark)))
