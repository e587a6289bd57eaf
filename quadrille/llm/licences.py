"""Operator 6: licence scans with DataFrame functions alone.

A multinomial logistic regression over the word n-grams of a paragraph (a line of the text), trained on the fixed templates and short names below and on
ordinary sentences with licence words, gives each family's probability; under a threshold calibrated on perturbed templates it is unknown.  A prediction
is confirmed if the paragraph shares enough word pairs with a template of that family, or holds a short name of it that makes up half of the paragraph
or has three words.

Candidates are the paragraphs that hold a licence stem or an acronym in capitals, whatever their family, and all others whose prediction is confirmed:
a paragraph without either is only passed over if it shares too few word pairs with every template to be confirmed.

Scoring is a projection: no rows are exploded, joined or shuffled, so repeated rows, hot lines and extra columns need no care.  The model (a few thousand
n-grams, whatever the input) is a literal of the plan.  Null and empty texts, and texts without candidates: no findings, licence null.  Ties: the family that sorts last.
Very long texts: one array of lines each.  An empty table: no rows.  A column named as the result is replaced.
"""

import functools
import json
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Stems (in lower case) and acronyms (as written), which make a paragraph a candidate even if no family is found.
STEMS = ["licen", "copyright", "warrant", "permission", "redistribut", "public domain", "creative commons", "cc by", "cc-by", "cc0", "spdx", " gpl", "unlicense"]
ACRONYMS = r"(?<![A-Za-z0-9])(?:AGPL|LGPL|GPL|BSD|ISC|MPL|CC0)(?:v[0-9]|(?![A-Za-z]))"
#: MIT counts where it is the whole paragraph or the paragraph has lower-case letters: in a line of capitals it may be a German word.
MIT = r"(?<![A-Za-z0-9])MIT(?![A-Za-z])"
MIT_ALONE = r"^[^A-Za-z0-9]*MIT[^A-Za-z0-9]*$"

#: The templates of each family.
TEMPLATES = {
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL license v3"],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "This project is Apache licensed"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Released under a Creative Commons non commercial licence CC BY-NC"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "Released into the public domain under CC0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the GPL v3 license.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU GPL version 2"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the LGPL license"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "SPDX-License-Identifier: MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Copyright 2020 Example Corporation. All rights reserved.", "This document is confidential and proprietary; redistribution without written permission is prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
}
#: Short names of each family, as they stand alone in lists and headers.
SHORT = {
    "AGPL": ["AGPL", "AGPL v3", "AGPLv3", "AGPL-3.0"],
    "Apache": ["Apache 2.0", "Apache-2.0"],
    "BSD": ["BSD", "BSD 2-Clause", "BSD 3-Clause"],
    "CC-BY": ["CC BY", "CC BY 4.0"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0"],
    "CC-BY-SA": ["CC BY-SA", "CC BY-SA 4.0"],
    "CC0": ["CC0", "CC0 1.0"],
    "GPL": ["GPL", "GPL v2", "GPL v3", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GNU GPL"],
    "ISC": ["ISC"],
    "LGPL": ["LGPL", "LGPL v2.1", "LGPL v3", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "GNU LGPL"],
    "MIT": ["MIT"],
    "MPL": ["MPL", "MPL 2.0", "MPL-2.0"],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["Unlicense"],
}
UNKNOWN = "unknown"
#: Sentences that hold a stem and grant nothing.
ORDINARY = ["He renewed his driving licence at the office last week.", "The bar lost its liquor license after the fire.", "A warrant was issued for the arrest of the two men.", "She asked for permission to leave the room early.", "The copyright debate went on in parliament for years.", "The car comes with a five year warranty on all parts.", "Taxes redistribute income from the rich to the poor.", "The old songs have long been in the public domain.", "Drivers need a valid license and insurance.", "His behaviour does not warrant such a reply.", "The ministry granted permission to build the bridge.", "A software license may cost more than the machine.", "Which license should we choose for the new version?", "The general public was not allowed to enter, version or no version.", "Fishing licences are sold in the village shop.", "the press printed the terms under which the work was done"]

WORD = r"[a-z0-9]+(?:[.][0-9]+)*"
BUCKETS = 256
ROUNDS = 400
SEED = 6
#: A confirmed paragraph shares this part of its word pairs, or of the template's if they are fewer.
OVERLAP = 0.5
#: A paragraph without a stem shares so many word pairs at least: "version 2.0" or "or later" alone confirm nothing.
STEMLESS_PAIRS = 3


def words(paragraph: str) -> list[str]:
    return re.findall(WORD, paragraph.lower())


def grams(ws: list[str]) -> list[str]:
    return list(dict.fromkeys([*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]))


class Model:
    def __init__(self, labels, vocabulary, bias, threshold):
        self.labels, self.vocabulary, self.bias, self.threshold = labels, vocabulary, bias, threshold

    def probabilities(self, paragraph: str) -> np.ndarray:
        z = self.bias + sum((self.vocabulary[g] for g in grams(words(paragraph)) if g in self.vocabulary), np.zeros(len(self.labels)))
        e = np.exp(z - z.max())
        return e / e.sum()


@functools.cache
def model() -> Model:
    """Fitted on the templates, each also with words dropped and with ordinary words around it; half of the perturbed ones set the threshold."""
    rng = np.random.default_rng(SEED)
    labels = [*sorted(TEMPLATES), UNKNOWN]
    common = sorted({w for s in ORDINARY for w in words(s)})

    def perturbed(ws):
        ws = [w for w in ws if rng.random() > 0.1] or ws
        a, b = rng.integers(0, 6, 2)
        return [*rng.choice(common, a), *ws, *rng.choice(common, b)]

    fitted, tested = [], []
    for label, texts in [*TEMPLATES.items(), (UNKNOWN, ORDINARY)]:
        for text in texts:
            fitted.append((words(text), labels.index(label)))
            for k in range(12):
                (tested if k % 2 else fitted).append((perturbed(words(text)), labels.index(label)))
    for _ in range(120):
        fitted.append((list(rng.choice(common, rng.integers(1, 25))), len(labels) - 1))
        tested.append((list(rng.choice(common, rng.integers(1, 25))), len(labels) - 1))
    fitted += [(words(text), labels.index(label)) for label, texts in SHORT.items() for text in texts] * 7
    vocabulary = sorted({g for ws, _ in fitted for g in grams(ws)})
    place = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(fitted), len(vocabulary)))
    for r, (ws, _) in enumerate(fitted):
        x[r, [place[g] for g in grams(ws)]] = 1
    y = np.eye(len(labels))[[k for _, k in fitted]]
    w, bias, size = np.zeros((len(vocabulary), len(labels))), np.zeros(len(labels)), np.full((len(vocabulary), len(labels)), 1e-3)
    for _ in range(ROUNDS):
        z = x @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (y - p) / len(x)
        size += g * g
        w += 0.1 * g / np.sqrt(size)
        w = np.sign(w) * np.maximum(np.abs(w) - 1e-3, 0)  # keeps the weights sparse
        bias += 0.1 * (y - p).mean(0)
    weights = {g: np.round(w[k], 4) for g, k in place.items() if np.abs(w[k]).max() >= 1e-3}
    fit = Model(labels, weights, np.round(bias, 4), 0.0)
    score = [(p := fit.probabilities(" ".join(ws)), k) for ws, k in tested]
    right = [p.max() for p, k in score if p.argmax() == k != len(labels) - 1]
    wrong = [p[:-1].max() for p, k in score if k == len(labels) - 1]
    # The calibrated threshold lets the fewest of both pass on the wrong side.
    best = min(np.linspace(0.2, 0.9, 71), key=lambda t: (sum(v < t for v in right) + sum(v >= t for v in wrong), t))
    fit.threshold = float(round(best, 3))
    return fit


def _literal(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _pairs(ws: Column) -> Column:
    n = F.size(ws)
    return F.when(n > 1, F.zip_with(F.slice(ws, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(ws, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _stemmed(value: Column) -> Column:
    low = F.lower(value)
    return functools.reduce(lambda a, b: a | b, (low.contains(s) for s in STEMS))


def _named(value: Column) -> Column:
    """Whether a paragraph holds an acronym."""
    return value.rlike(ACRONYMS) | (value.contains("MIT") & value.rlike(MIT) & (value.rlike("[a-z]") | value.rlike(MIT_ALONE)))


def _word_pairs(text: str) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words(text), words(text)[1:])})


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@functools.cache
def known_pairs() -> tuple[frozenset[str], str]:
    """The word pairs of templates and short names, and a pattern of those of which a confirmed paragraph without stem or acronym has one at least:
    all but STEMLESS_PAIRS - 1 of each template."""
    weight = model().vocabulary
    each = [set(_word_pairs(t)) for ts in TEMPLATES.values() for t in ts]
    named = {p for ts in SHORT.values() for t in ts for p in _word_pairs(t)}
    every = frozenset(named.union(*each))
    spared: set[str] = set()
    # The pairs that speak least for a family, as a rule the commonest, are spared.
    for p in sorted(every - named, key=lambda p: (sum(float(weight[w][:-1].max()) if w in weight else 0.0 for w in p.split()), p)):
        if all(len(spared & t) < STEMLESS_PAIRS - 1 for t in each if p in t):
            spared.add(p)
    tree: dict[str, dict[str, list[str]]] = {}
    for p in sorted(every - spared):
        first, second = p.split()
        tree.setdefault(first[0], {}).setdefault(first[1:], []).append(second)
    # A word never follows a letter; after a digit it may ("a.3b").
    heads = ("{}(?:{})".format(c, "|".join("{}[^a-z0-9]+(?:{})".format(re.escape(w), "|".join(map(re.escape, ends))) for w, ends in rest.items())) for c, rest in tree.items())
    return every, "(?<![a-z])(?:" + "|".join(heads) + ")"


def _overlapping(paragraph: Column) -> Column:
    """Whether a paragraph without stem or acronym shares as many word pairs with all templates and short names together as a confirmation takes with one."""
    every, pattern = known_pairs()

    def enough(pairs):
        known = F.size(F.filter(pairs, lambda p: p.isin(sorted(every))))
        return _let(known, lambda k: (k >= 2) | ((k > 0) & (k >= F.lit(OVERLAP) * F.size(pairs))))

    low = F.lower(paragraph)
    return F.when(low.rlike(pattern), _let(_let(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda ws: F.array_distinct(_pairs(ws))), enough)).otherwise(False)


def _finding(paragraph: Column, fit: Model) -> Column:
    """A struct for a paragraph: family, score and whether a template or short name confirms it."""
    n = len(fit.labels)
    slots: list[dict] = [{} for _ in range(BUCKETS)]
    for g, w in fit.vocabulary.items():
        slots[zlib.crc32(g.encode()) % BUCKETS][g] = w.tolist()
    weights = _literal(slots, "array<map<string,array<double>>>")
    templates = {f: [_word_pairs(t) for t in ts] for f, ts in TEMPLATES.items()}
    names = {f: [p for t in ts if (p := _word_pairs(t))] for f, ts in SHORT.items()}
    single = {f: [w[0] for t in ts if len(w := words(t)) == 1] for f, ts in SHORT.items()}

    def scored(ws, pairs):
        found = F.filter(F.transform(F.concat(F.array_distinct(ws), pairs), lambda g: F.element_at(F.get(weights, (F.crc32(g.cast("binary")) % BUCKETS).cast("int")), g)), lambda w: w.isNotNull())
        return F.aggregate(found, _literal(fit.bias.tolist(), "array<double>"), lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))

    def judged(ws, pairs, z):
        top = F.array_max(z)
        label = F.get(_literal(fit.labels, "array<string>"), F.array_position(z, top).cast("int") - 1)
        score = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return _let(F.struct(label.alias("label"), score.alias("score")), lambda r: verdict(ws, pairs, r["label"], r["score"]))

    def verdict(ws, pairs, label, score):
        of = F.element_at(_literal(templates, "map<string,array<array<string>>>"), label)
        least = F.when(_stemmed(paragraph), 1).otherwise(STEMLESS_PAIRS)
        shared = F.exists(of, lambda t: F.size(F.array_intersect(t, pairs)) >= F.greatest(least, F.lit(OVERLAP) * F.least(F.size(t), F.size(pairs))))
        held = F.exists(F.element_at(_literal(names, "map<string,array<array<string>>>"), label), lambda t: (F.size(F.array_except(t, pairs)) == 0) & ((F.size(t) > 1) | (F.size(t) >= F.lit(OVERLAP) * F.size(pairs))))
        # Alone, "mit" is a German word and "MIT" a licence.
        alone = (F.size(ws) == 1) & (_stemmed(paragraph) | _named(paragraph)) & F.array_contains(F.element_at(_literal(single, "map<string,array<string>>"), label), F.get(ws, F.lit(0)))
        family = F.when(score >= fit.threshold, label).otherwise(F.lit(UNKNOWN))
        sure = F.coalesce(shared & (F.size(pairs) > 0), F.lit(False)) | F.coalesce(held, F.lit(False)) | F.coalesce(alone, F.lit(False))
        return F.struct(family.alias("family"), score.alias("score"), ((family != UNKNOWN) & (n > 0) & sure).alias("confirmed"))

    low = F.lower(paragraph)
    return _let(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda ws: _let(F.array_distinct(_pairs(ws)), lambda pairs: _let(scored(ws, pairs), lambda z: judged(ws, pairs, z))))


def scan(docs: DataFrame, text: str = "text", out: str = "findings") -> DataFrame:
    """docs with an array of findings (paragraph, from 0; family; score; confirmed), one for each candidate paragraph."""
    fit = model()
    numbered = F.transform(F.split(F.col(text), "\n"), lambda p, k: F.struct(k.alias("paragraph"), p.alias("line"), (_stemmed(p) | _named(p)).alias("telling")))
    lines = F.filter(numbered, lambda p: F.when(p["telling"], True).otherwise(_overlapping(p["line"])))

    def finding(p):
        f = _finding(p["line"], fit)
        return F.struct(p["paragraph"].alias("paragraph"), f["family"].alias("family"), f["score"].alias("score"), f["confirmed"].alias("confirmed"), p["telling"].alias("telling"))

    found = F.filter(F.transform(lines, finding), lambda f: f["telling"] | f["confirmed"])
    plain = F.transform(found, lambda f: F.struct(*(f[c].alias(c) for c in ("paragraph", "family", "score", "confirmed"))))
    kind = "array<struct<paragraph:int,family:string,score:double,confirmed:boolean>>"
    return docs.withColumn(out, F.coalesce(plain, F.array().cast(kind)))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its candidate paragraphs, its findings, the families confirmed, and the licence (the confirmed family of the highest score; unknown if none is; null without candidates)."""
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    sure = F.filter("findings", lambda f: f["confirmed"])
    best = F.array_max(F.transform(sure, lambda f: F.struct(f["score"].alias("score"), f["family"].alias("family"))))["family"]
    return got.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.when(F.size("findings") > 0, F.coalesce(best, F.lit(UNKNOWN))).alias("licence"), F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))).alias("families"), F.to_json("findings").alias("findings"))
