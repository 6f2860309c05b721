"""License scans: a trained classifier of paragraphs finds licence notices and names their family.

Method. A paragraph is a line of text. Its features are the word 1-grams and 2-grams of a learned vocabulary. A
multinomial logistic regression with an L1 penalty, trained on the driver from the licence sentences below and from
ordinary paragraphs, gives each family and `none` a probability. Then the paragraph's n-grams are compared with the best
family's sentences: a prediction counts as confirmed if it shares enough of them with one. How likely a notice's best
family is the right one at all is calibrated by leaving families out: a logistic curve over the log-odds of the best
family's share and the likeness of its closest sentence, fitted (Platt) to reworded sentences of families that the model
has seen and to sentences of families that it has not, each kind half of all; below a half the notice is `unknown`.

Scoring is native: split, filter, transform and aggregate over arrays within each row, no shuffle and no Python. Only
paragraphs with a word of the vocabulary are scored; all others have no feature and are `none` by the model's bias.

Defined cases: a null or empty text has no paragraph and licence `none`, score 0; a licence notice of no known family is
`unknown`; of several paragraphs the most probable one names the document's licence, `families` lists all; a very long
line is a paragraph like any other; repeated rows get repeated results, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences by which licence families are declared.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "Released under CC0 1.0, dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "Copyright 2020 Example Corporation. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying is strictly prohibited.",
    ),
}
#: Ordinary sentences that share words with licences.
ORDINARY = (
    "She had to renew her driving license before the trip.", "The version of the story that we heard was quite different.",
    "The public was asked for permission to use the hall.", "He found a copy of the book in the library.",
    "The software was easy to use and the work was done by noon.", "It is a common source of errors in this form.",
    "The terms of the agreement were published in May.", "This work was done under difficult conditions.",
    "General opinion was that the author had a point.", "A licence fee is paid by every household.",
)
NONE, UNKNOWN = "none", "unknown"
#: Ordinary paragraphs taken from the corpus to learn from, at most.
SAMPLE = 4_000
#: Share of ordinary paragraphs (or, in few of them, their number) beyond which an n-gram says nothing.
COMMON, COMMON_LEAST = 0.002, 2
#: Words of an ordinary paragraph that are put around training sentences.
FILLER = 6
#: Least share of a template's or of the paragraph's n-grams that confirms a prediction.
CONFIRMED = 0.6
_WORD = "[^a-z0-9.-]+"


def grams(paragraph: str) -> list[str]:
    """Distinct word 1-grams and 2-grams, as the Spark expression makes them."""
    words = [w for w in (x.strip(".-") for x in re.split(_WORD, paragraph.lower())) if w]
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def likeness(own: list[str], sentence: list[str]) -> float:
    """The share of n-grams that a paragraph and a sentence have in common, of the one that has fewer."""
    return len(set(own) & set(sentence)) / max(1, min(len(own), len(sentence)))


@dataclass(frozen=True)
class LicenseModel:
    """weights: one row for each n-gram of the vocabulary, one column for each class; `none` is the last class."""

    classes: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def evidence(self, paragraph: str) -> tuple[float, float, float]:
        """What the calibrated curve looks at: log-odds of the best family's share, likeness to its closest sentence, 1."""
        p, own = self.probabilities(paragraph), grams(paragraph)
        share = min(max(p[:-1].max() / max(1e-12, 1 - p[-1]), 1e-9), 1 - 1e-9)
        return float(np.log(share / (1 - share))), max(likeness(own, grams(t)) for t in TEMPLATES[self.classes[p[:-1].argmax()]]), 1.0

    def known(self, paragraph: str) -> float:
        """The calibrated probability that a notice is of its best family."""
        return float(1 / (1 + np.exp(-np.dot(self.curve, self.evidence(paragraph)))))

    def probabilities(self, paragraph: str) -> np.ndarray:
        own = set(grams(paragraph))
        z = self.bias + sum((self.weights[i] for i, g in enumerate(self.vocabulary) if g in own), np.zeros(len(self.bias)))
        z = np.exp(z - z.max())
        return z / z.sum()

    def classify(self, paragraph: str) -> str:
        p = self.probabilities(paragraph)
        if p[-1] >= 0.5:
            return NONE
        return self.classes[p[:-1].argmax()] if self.known(paragraph) >= 0.5 else UNKNOWN


def _reworded(sentence: str, random: np.random.Generator, filler: list[str]) -> str:
    """The sentence with a few words dropped and some ordinary ones around it."""
    words = [w for w in sentence.split() if random.random() > 0.1]
    around = lambda: [filler[i] for i in random.integers(len(filler), size=random.integers(0, 6))] if filler else []
    return " ".join(around() + words + around())


def _fit(found: list[list[str]], labels: list[int], classes: int, own: set[str], penalty: float = 2e-4, rounds: int = 250) -> tuple[list[str], np.ndarray, np.ndarray]:
    """L1-penalised multinomial regression of paragraphs' n-grams, by accelerated proximal steps, over the n-grams `own`."""
    n, vocabulary = len(found), sorted(own)
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((n, len(vocabulary)), np.float32)
    for i, gs in enumerate(found):
        x[i, [index[g] for g in gs if g in index]] = 1
    y = np.eye(classes, dtype=np.float32)[labels]
    share = 1 / np.maximum(1, np.bincount(labels, minlength=classes))[labels]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((len(vocabulary), classes), np.float32), np.zeros(classes, np.float32)
    v, vb, t = w, b, 1.0
    size = float((share[:, 0] * (x.sum(axis=1) + 1)).sum()) / 2
    for _ in range(rounds):
        z = x @ v + vb
        z = np.exp(z - z.max(axis=1, keepdims=True))
        miss = (z / z.sum(axis=1, keepdims=True) - y) * share
        new = v - x.T @ miss / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        new_b = vb - miss.sum(axis=0) / size
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, vb = new + (last - 1) / t * (new - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new.astype(np.float32), new_b.astype(np.float32)
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 1e-4)
    return [vocabulary[i] for i in used], w[used].astype(float), b.astype(float)


def _platt(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """A logistic curve through (z, y), whose last column is 1, both kinds of y weighing the same."""
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))  # as Platt smooths them
    w, ridge = np.zeros(z.shape[1]), 1e-4 * np.eye(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + ridge, z.T @ (weight * (p - target)) + ridge @ w)
    return tuple(float(x) for x in w)


def learn(ordinary: list[list[str]], filler: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES) -> LicenseModel:
    """The model; ordinary: the n-grams of ordinary paragraphs, of which only those that templates hold matter; filler: ordinary words."""
    random = np.random.default_rng(5)
    common = Counter(g for p in ordinary for g in set(p))
    most = max(COMMON_LEAST, COMMON * len(ordinary))
    plain = {g for s in ORDINARY for g in grams(s)}
    examples = [*ordinary, *map(grams, ORDINARY)]

    def rows(names: list[str]) -> tuple[list[list[str]], list[int], int, set[str]]:
        found, labels = list(examples), [len(names)] * len(examples)
        for k, name in enumerate(names):
            for sentence in templates[name]:
                made = [sentence] * 4 + [_reworded(sentence, random, filler) for _ in range(12)]
                found += map(grams, made)
                labels += [k] * len(made)
        return found, labels, len(names) + 1, {g for n in names for s in templates[n] for g in grams(s) if common[g] <= most and g not in plain}

    names = sorted(templates)
    vocabulary, w, b = _fit(*rows(names))
    model = LicenseModel((*names, NONE), tuple(vocabulary), w, b)
    known = [model.evidence(_reworded(s, random, filler)) for n in names for s in templates[n] for _ in range(4)]
    strange = []
    for fold in range(3):  # families left out, a third at a time
        left = names[fold::3]
        part = [n for n in names if n not in left]
        words, w2, b2 = _fit(*rows(part), rounds=120)
        other = LicenseModel((*part, NONE), tuple(words), w2, b2)
        strange += [other.evidence(s) for n in left for s in templates[n]]
    curve = _platt(np.array([*known, *strange]), np.arange(len(known) + len(strange)) < len(known))
    return replace(model, curve=curve)


def _sql_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_texts(xs: list[str] | tuple[str, ...]) -> str:
    return f"array({', '.join(map(_sql_text, xs))})" if xs else "cast(array() as array<string>)"


def _sql_numbers(xs: np.ndarray) -> str:
    return "array(" + ", ".join(f"{x!r}D" for x in np.round(np.asarray(xs, float), 6).ravel().tolist()) + ")"


def _any_of(words: set[str]) -> str:
    """A pattern for any of the words as a tree by their letters, so that few branches are tried at a place."""
    if words == {""}:
        return ""
    heads: dict[str, set[str]] = {}
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    tree = "(?:" + "|".join(re.escape(h) + _any_of(rest) for h, rest in sorted(heads.items())) + ")"
    return tree + "?" if "" in words else tree


def _words_sql(line: str) -> str:
    return f"filter(transform(split(lower({line}), '{_WORD}'), w -> trim(BOTH '.-' FROM w)), w -> w <> '')"


def _grams_sql(words: str) -> str:
    return f"array_distinct(concat({words}, transform(slice({words}, 2, greatest(size({words}) - 1, 0)), (w, i) -> concat({words}[i], ' ', w))))"


def license_columns(model: LicenseModel, text: str = "text") -> list[Column]:
    """n_paragraphs, licensed (struct of paragraph, family, score, confirmed for each notice), all as JVM expressions."""
    classes = len(model.classes)
    words = {max(g.split(" "), key=len) for g in model.vocabulary}  # a 2-gram needs both its words: the longer is looked for
    gate = rf"(?<![a-z0-9]){_any_of(words)}(?![a-z0-9])" if words else "(?!)"
    lines = f"filter(split(coalesce({text}, ''), '\\n'), l -> length(trim(l)) > 0)"
    found = f"case when rlike(lower(coalesce({text}, '')), {_sql_text(gate)}) then filter(split({text}, '\\n'), l -> rlike(lower(l), {_sql_text(gate)})) else cast(array() as array<string>) end"
    words = f"transform({found}, l -> struct(l as line, {_words_sql('l')} as words))"
    pairs = f"transform({words}, s -> struct(s.line as line, {_grams_sql('s.words')} as grams))"
    vocabulary = _sql_texts(model.vocabulary)
    known = f"transform({pairs}, s -> struct(s.line as line, s.grams as grams, transform(array_intersect(s.grams, {vocabulary}), g -> cast(array_position({vocabulary}, g) as int) - 1) as ids))"
    known = f"filter({known}, s -> size(s.ids) > 0)"
    weights, bias = _sql_numbers(model.weights), _sql_numbers(model.bias)
    scores = (
        f"transform({known}, s -> struct(s.line as line, s.grams as grams, "
        f"transform({bias}, (b, c) -> exp(aggregate(s.ids, b, (a, i) -> a + element_at({weights}, i * {classes} + c + 1)))) as z))"
    )
    totals = f"transform({scores}, s -> struct(s.line as line, s.grams as grams, s.z as z, aggregate(s.z, 0D, (a, x) -> a + x) as total))"
    kept = f"filter({totals}, s -> s.z[{classes - 1}] < 0.5 * s.total)"
    best = f"transform({kept}, s -> struct(s.line as line, s.grams as grams, s.total - s.z[{classes - 1}] as inside, s.total as total, slice(s.z, 1, {classes - 1}) as z))"
    best = f"transform({best}, s -> struct(s.line as line, s.grams as grams, s.inside as inside, s.total as total, array_max(s.z) as top, cast(array_position(s.z, array_max(s.z)) as int) as class))"
    families = _sql_texts(model.classes[:-1])
    sentences = "array(" + ", ".join("array(" + ", ".join(_sql_texts(grams(t)) for t in TEMPLATES[c]) + ")" for c in model.classes[:-1]) + ")"
    odds = "greatest(least(s.top / s.inside, 1 - 1e-9D), 1e-9D)"
    closest = f"array_max(transform({sentences}[s.class - 1], t -> struct(size(array_intersect(s.grams, t)) / cast(least(size(t), size(s.grams)) as double) as like, size(array_intersect(s.grams, t)) >= least(3, size(t)) as enough)))"
    compared = f"transform({best}, s -> struct(s as s, ln({odds} / (1 - {odds})) as odds, {closest} as closest))"
    a, b, c = (f"{x!r}D" for x in model.curve)
    rated = f"transform({compared}, r -> struct(r.s as s, r.closest as closest, 1 / (1 + exp(-({a} * r.odds + {b} * r.closest.like + {c}))) as known))"
    notice = (
        f"transform({rated}, r -> struct(r.s.line as paragraph, case when r.known >= 0.5 then {families}[r.s.class - 1] else '{UNKNOWN}' end as family, "
        f"r.s.inside / r.s.total as score, r.known as known, r.known >= 0.5 and r.closest.like >= {CONFIRMED}D and r.closest.enough as confirmed))"
    )
    return [F.expr(f"cast(size({lines}) as bigint)").alias("n_paragraphs"), F.expr(notice).alias("licensed")]


def license_scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_paragraphs, n_licensed, license, score, known, confirmed, families, licensed.

    score is the probability that the paragraph speaks of a licence at all, known that it is of a known family.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.select(F.col("id").alias(id_col), *license_columns(model))
    order = "(a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.family < b.family then -1 when a.family > b.family then 1 else 0 end"
    ranked = found.withColumn("first", F.expr(f"get(array_sort(licensed, {order}), 0)"))
    return ranked.select(
        id_col,
        "n_paragraphs",
        F.size("licensed").cast("bigint").alias("n_licensed"),
        F.coalesce("first.family", F.lit(NONE)).alias("license"),
        F.coalesce("first.score", F.lit(0.0)).alias("score"),
        F.coalesce("first.known", F.lit(0.0)).alias("known"),
        F.coalesce("first.confirmed", F.lit(False)).alias("confirmed"),
        F.expr("array_sort(array_distinct(transform(licensed, s -> s.family)))").alias("families"),
        "licensed",
    )


def learn_from(docs: DataFrame, limit: int = SAMPLE) -> LicenseModel:
    """The model, with ordinary paragraphs of at most `limit` documents: one of each, that with the smallest hash.

    The bound is the sample's size and concerns learning only. A paragraph is read whole, but what reaches the driver of
    it are the n-grams that it shares with templates and FILLER words. Paragraphs that speak of licences themselves are no
    examples of ordinary text; copies of one paragraph count once.
    """
    ids = docs.filter("text is not null and doc_id is not null").select(F.col("doc_id").alias("id")).orderBy(F.xxhash64("id")).limit(limit)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), F.col("doc_id") == F.col("id"), "left_semi")  # limit ids
    plain = "filter(split(text, '\\n'), l -> length(trim(l)) > 0 and not rlike(l, '(?i)licen[cs]|copyright|spdx|all rights'))"
    line = chosen.select("doc_id", F.expr(f"array_min(transform({plain}, l -> struct(xxhash64(l) as h, l as line)))").alias("first")).filter("first is not null")
    words = line.select(F.col("first.h").alias("h"), F.expr(_words_sql("first.line")).alias("words"))
    held = sorted({g for sentences in TEMPLATES.values() for s in sentences for g in grams(s)})
    start = f"1 + pmod(h, greatest(1, size(words) - {FILLER} + 1))"
    found = words.select("h", F.expr(f"array_intersect({_grams_sql('words')}, {_sql_texts(held)})").alias("grams"), F.expr(f"slice(words, cast({start} as int), {FILLER})").alias("filler"))
    rows = {r["h"]: r for r in found.orderBy("h").limit(limit).collect()}
    ordinary = [rows[h] for h in sorted(rows)]
    return learn([r["grams"] for r in ordinary], [w for r in ordinary[:500] for w in r["filler"]][:2000])
