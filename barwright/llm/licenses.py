"""Licence scan: a trained paragraph classifier with template confirmation (operator 3).

A paragraph is a line, or neighbouring lines without a blank one between them, joined: notices are
often wrapped. Of a joined paragraph's first and last line only the `EDGE` words next to the others
count, and between them lie fewer than 2 * `EDGE` words, so that a notice as long as the longest template
fits however it is wrapped. A paragraph is cut into words; its distinct word
unigrams and bigrams are hashed into sparse features of a multinomial logistic regression whose
classes are licence families and `unknown`. Probabilities are calibrated by a temperature fitted on
held-out variants. A family's prediction is confirmed only where the paragraph also shares enough of
one of that family's templates (word trigrams), or lies itself in one; otherwise the paragraph is
`unknown`. Paragraphs without any of the `ANCHORS` aren't looked at: every template has so many trigrams
with one of these words that no paragraph without them can be confirmed (`needed`, held by a test). Of confirmed paragraphs that share a line, the one that holds most of its template stays.

The regression is fitted here, on the templates below, seeded variants of them and general licence
talk as `unknown`; it is a constant of fixed size in the plan. The scan is DataFrame functions only:
no Python runs on executors, and nothing is shuffled.

Defined results
    null or empty text   no paragraph: an empty list, n_paragraphs 0, license null.
    ties                 the class that sorts first; for a document, the paragraph that comes first;
                         of overlapping paragraphs with the same share, the one of fewer lines.
    repeated rows        the same result for each. An empty table gives no rows.
    very long lines are classified whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the word n-grams.
FEATURES = 2048
#: Calibrated probability from which a family is predicted, and the share of a template's trigrams
#: (or of the paragraph's own, if it holds OWN_TRIGRAMS and OWN_HELD of the template) above which it is
#: confirmed.
LEAST_PROBABILITY, LEAST_OVERLAP, OWN_TRIGRAMS, OWN_HELD = 0.5, 0.5, 3, 0.4

#: Short notices by which texts name their licence.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["licensed under the gnu affero general public license version 3", "this program is free software under the terms of the gnu affero general public license"],
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"],
    "boost": ["distributed under the boost software license version 1 0", "licensed under the boost software license"],
    "bsd": ["licensed under the bsd 3 clause license", "licensed under the bsd 2 clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "cc0": ["dedicated to the public domain under cc0 1 0 universal", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "licensed under the eclipse public license version 2 0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu gpl version 2 or later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the gnu lesser general public license version 2 1", "this library is free software under the terms of the gnu lesser general public license"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "proprietary": ["copyright all rights reserved", "this document is proprietary and confidential and may not be reproduced without permission"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib": ["licensed under the zlib license", "in no event will the authors be held liable for any damages arising from the use of this software"],
}
#: Identifiers in tags.
TAGS = {
    "agpl": ["agpl 3 0 or later", "agpl 3 0 only"], "apache": ["apache 2 0"], "boost": ["bsl 1 0"], "bsd": ["bsd 3 clause", "bsd 2 clause"], "cc0": ["cc0 1 0"], "cc-by": ["cc by 4 0"], "cc-by-nc": ["cc by nc 4 0"], "cc-by-sa": ["cc by sa 4 0"],
    "epl": ["epl 2 0"], "gpl": ["gpl 3 0 or later", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only"], "isc": ["isc"], "lgpl": ["lgpl 2 1 or later", "lgpl 3 0 only"], "mit": ["mit"], "mpl": ["mpl 2 0"], "unlicense": ["unlicense"], "zlib": ["zlib"],
}
for _family, _tags in TAGS.items():
    TEMPLATES[_family] += [f"spdx license identifier {t}" for t in _tags]
#: Talk of licences that names none.
UNKNOWN = [
    "the driving license of the owner has expired", "a fishing license is needed here", "they asked for permission to leave", "the warranty covers two years of use",
    "the software was released last week", "please read the terms and conditions of sale", "the license plate was hard to read", "copyright law is a field of study",
    "the public domain is a legal idea", "this work is about the general public", "free software is a movement", "we may modify the schedule without notice",
    "distributed systems need care", "the commons were grazed by sheep", "poetic license is common in songs", "the source of the river", "all rights come with duties",
    "spdx license identifier licenseref custom", "spdx license identifier see file", "no one will be held liable for the weather", "the terms of the lease were made available", "a boost in sales under the new version",
    "the apache people of the southwest", "he studied at mit for four years", "a mozilla developer gave a talk", "attribution of the painting is disputed",
]
#: Words that hold every template together; see `needed`.
ANCHOR_WORDS = """license licensed copyright permission permitted proprietary confidential reserved waived granted gnu gpl lgpl agpl affero lesser mozilla eclipse bsd cc cc0
    noncommercial sharealike attribution domain unencumbered software source binary documentation file authors contributors subject purpose conditions compliance applicable
    warranties damages liable arising distributed redistribute redistribution released related reproduced available accompanying derived endorse promote modify obtaining possible""".split()
#: The words as one pattern, by their first letters.
ANCHORS = "(?<![a-z0-9])(?:" + "|".join(f"{k}(?:{'|'.join(w[1:] for w in ws)})" for k, ws in groupby(sorted(ANCHOR_WORDS), key=lambda w: w[0])) + ")(?![a-z0-9])"


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def trigrams(words: list[str]) -> list[str]:
    """Distinct word trigrams, or the whole of fewer words."""
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))})


def needed(template: str, overlap: float = 0.5) -> int:
    """Trigrams of a template that a paragraph must hold at least to be confirmed by it. Fewer of them than
    that may be without an anchor word."""
    n = len(trigrams(_words(template)))
    return min(int(n * overlap) + 1, max(OWN_TRIGRAMS, math.ceil(n * OWN_HELD)))


#: Words of the longest template.
EDGE = max(len(_words(t)) for ts in TEMPLATES.values() for t in ts)


def _grams(w: list[str]) -> set[str]:
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % FEATURES


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # classes x FEATURES
    bias: np.ndarray
    temperature: float


def _variants(words: list[str], rng: random.Random, n: int) -> list[list[str]]:
    """The notice itself, and with words lost, cut at an end, or set among others."""
    filler = [w for t in UNKNOWN for w in _words(t)]
    out = [words]
    for _ in range(n):
        v = [w for w in words if rng.random() > 0.08] or words
        if rng.random() < 0.3 and len(v) > 6:
            v = v[: rng.randint(len(v) * 2 // 3, len(v))]
        if rng.random() < 0.5:
            v = rng.choices(filler, k=rng.randint(1, 6)) + v
        if rng.random() < 0.5:
            v = v + rng.choices(filler, k=rng.randint(1, 6))
        out.append(v)
    return out


@lru_cache(maxsize=1)
def trained(seed: int = 3, variants: int = 12, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Fit the regression by gradient descent (Adagrad), then its temperature on held-out variants."""
    rng = random.Random(seed)
    classes = sorted([*TEMPLATES, "unknown"])
    sets: dict[bool, list[tuple[int, list[str]]]] = {True: [], False: []}
    for c, texts in {**TEMPLATES, "unknown": UNKNOWN}.items():
        for t in texts:
            for k, v in enumerate(_variants(_words(t), rng, variants)):
                sets[k % 4 != 3].append((classes.index(c), v))
    filler = [w for t in UNKNOWN for w in _words(t)]
    for k in range(200):
        sets[k % 4 != 3].append((classes.index("unknown"), rng.choices(filler, k=rng.randint(3, 20))))

    def matrix(rows: list[tuple[int, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), FEATURES))
        for i, (_, w) in enumerate(rows):
            g = _grams(w)
            for s in g:
                x[i, _bucket(s)] += 1 / math.sqrt(len(g))
        return x, np.array([y for y, _ in rows])

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(sets[True])
    truth = np.eye(len(classes))[y]
    w, b = np.zeros((len(classes), FEATURES)), np.zeros(len(classes))
    hw, hb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        miss = (soft(x @ w.T + b) - truth) / len(x)
        gw, gb = miss.T @ x + decay * w, miss.sum(axis=0)
        hw += gw * gw
        hb += gb * gb
        w -= rate * gw / np.sqrt(hw)
        b -= rate * gb / np.sqrt(hb)
    z, yt = matrix(sets[False])
    z = z @ w.T + b
    loss = {t: -np.log(soft(z / t)[np.arange(len(yt)), yt] + 1e-12).mean() for t in np.linspace(0.25, 3, 45)}
    return Model(classes, np.round(w, 4), np.round(b, 4), float(min(loss, key=loss.get)))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(w: Column, n: int) -> Column:
    """Word n-grams of an array of words, joined by blanks."""
    count = F.size(w) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _trigrams(w: Column) -> Column:
    """Word trigrams; of fewer words, the whole sequence."""
    return F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(_pairs(w, 3))


def classify(line: Column, model: Model, least: float = LEAST_PROBABILITY, overlap: float = LEAST_OVERLAP) -> Column:
    """struct<license, probability, overlap, held> of a paragraph, as one expression; held is the share of
    a template, overlap the greater of that and the paragraph's own share."""
    n = len(model.classes)
    names = F.array(*[F.lit(c) for c in model.classes])
    # bucket after bucket, a weight for each class; folded to one constant array
    weights = F.split(F.lit(",".join(f"{x:g}" for x in model.weights.T.ravel())), ",").cast("array<double>")
    bias = F.array(*[F.lit(float(x)) for x in model.bias])
    shapes = {c: [trigrams(_words(t)) for t in ts] for c, ts in TEMPLATES.items()}

    def scores(buckets: Column) -> Column:
        scale = F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double"))

        def score(c: Column) -> Column:
            total = F.aggregate(buckets, F.lit(0.0), lambda s, k: s + F.element_at(weights, (k * n + c).cast("int")))
            return (total / scale + F.element_at(bias, c)) / F.lit(model.temperature)

        return F.transform(F.sequence(F.lit(1), F.lit(n)), score)

    def predicted(z: Column) -> Column:
        def best(top: Column) -> Column:
            family = F.element_at(names, F.array_position(z, top).cast("int"))
            return F.struct(family.alias("family"), (F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))).alias("p"))

        return _let(F.array_max(z), best)

    def confirmed(words: Column, guess: Column) -> Column:
        def share(tri: Column) -> Column:
            out = F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("own"))
            for c, templates in shapes.items():
                common = F.array(*[F.size(F.array_intersect(tri, F.array(*[F.lit(g) for g in t]))) for t in templates])
                sizes = F.array(*[F.lit(float(len(t))) for t in templates])

                def both(n: Column) -> Column:
                    enough = F.array_max(F.zip_with(n, sizes, lambda x, y: F.when((x >= OWN_TRIGRAMS) & (x >= y * OWN_HELD), x).otherwise(F.lit(0))))
                    own = enough / F.size(F.array_distinct(tri))
                    return F.struct(F.array_max(F.zip_with(n, sizes, lambda x, y: x / y)).alias("held"), own.alias("own"))

                out = F.when(guess["family"] == c, _let(common, both)).otherwise(out)
            return out

        def verdict(s: Column) -> Column:
            most = F.greatest(s["held"], s["own"])
            sure = (guess["family"] != "unknown") & (guess["p"] >= least) & (most > overlap)
            return F.struct(F.when(sure, guess["family"]).otherwise(F.lit("unknown")).alias("license"), F.round(guess["p"], 6).alias("probability"), F.round(most, 6).alias("overlap"), F.round(s["held"], 6).alias("held"))

        return _let(_let(_trigrams(words), share), verdict)

    def judged(words: Column) -> Column:
        grams = F.array_distinct(F.concat(words, _pairs(words, 2)))
        buckets = F.transform(grams, lambda g: F.crc32(g.cast("binary")) % FEATURES)
        return _let(_let(_let(buckets, scores), predicted), lambda guess: confirmed(words, guess))

    return _let(_split(line), judged)


def _split(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


_PARAGRAPHS = "array<struct<line:int,lines:int,text:string>>"


def _joined(lines: Column) -> Column:
    """Paragraphs of two lines and more, from an array of struct<line, text, words>."""

    def grown(x: Column) -> Column:
        zero = F.struct(F.lit(True).alias("open"), F.lit(0).alias("between"), F.array_join(F.slice(x["words"], -F.least(F.size(x["words"]), F.lit(EDGE)), EDGE), " ").alias("text"), F.lit(1).alias("lines"), F.array().cast(_PARAGRAPHS).alias("out"))

        def more(acc: Column, y: Column) -> Column:
            goes = acc["open"] & (acc["between"] < 2 * EDGE) & (F.size(y["words"]) > 0)
            new = F.struct(x["line"].alias("line"), (acc["lines"] + 1).alias("lines"), F.concat_ws(" ", acc["text"], F.array_join(F.slice(y["words"], 1, EDGE), " ")).alias("text"))
            whole = F.when(F.size(y["words"]) < 2 * EDGE, F.concat_ws(" ", acc["text"], F.array_join(y["words"], " "))).otherwise(F.lit(""))
            return F.when(goes, F.struct(F.lit(True).alias("open"), (acc["between"] + F.size(y["words"])).alias("between"), whole.alias("text"), (acc["lines"] + 1).alias("lines"), F.concat(acc["out"], F.array(new)).alias("out"))).otherwise(
                F.struct(F.lit(False).alias("open"), acc["between"].alias("between"), acc["text"].alias("text"), acc["lines"].alias("lines"), acc["out"].alias("out")))

        return F.aggregate(F.slice(lines, x["line"] + 2, 2 * EDGE + 1), zero, more, lambda acc: acc["out"])

    return F.flatten(F.transform(F.filter(lines, lambda x: F.size(x["words"]) > 0), grown))


def _apart(judged: Column) -> Column:
    """Confirmed paragraphs that share no line, those holding most of a template first; and the lines
    outside them that are unknown."""
    fields = ("line", "lines", "license", "probability", "overlap")

    def meets(x: Column, y: Column) -> Column:
        return (x["line"] < y["line"] + y["lines"]) & (y["line"] < x["line"] + x["lines"])

    def chosen(found: Column) -> Column:
        first = F.array_sort(F.transform(F.filter(found, lambda x: x["license"] != "unknown"), lambda x: F.struct((-x["held"]).alias("lacks"), x["lines"].alias("lines"), x["line"].alias("line"), x["license"].alias("license"), x["probability"].alias("probability"), x["overlap"].alias("overlap"))))
        return F.aggregate(first, F.filter(first, lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: meets(x, y)), acc).otherwise(F.concat(acc, F.array(x))))

    def whole(found: Column) -> Column:
        def rest(named: Column) -> Column:
            unknown = F.filter(found, lambda x: (x["lines"] == 1) & (x["license"] == "unknown") & ~F.exists(named, lambda y: meets(x, y)))
            flat = [F.transform(a, lambda x: F.struct(*[x[f].alias(f) for f in fields])) for a in (named, unknown)]
            return F.array_sort(F.concat(*flat))

        return _let(chosen(found), rest)

    return _let(judged, whole)


def scan_licenses(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_PROBABILITY, overlap: float = LEAST_OVERLAP) -> DataFrame:
    """One row for each row of docs: doc_id, license (of the first confirmed paragraph), licenses (all
    confirmed families), n_paragraphs (confirmed), paragraphs (first line's number from 0, number of
    lines, license, probability, overlap of the confirmed paragraphs and of every other line with an
    anchor word)."""
    model = model or trained()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line"), line.alias("text"), _split(line).alias("words")))

    def candidates(ls: Column) -> Column:
        single = F.transform(ls, lambda x: F.struct(x["line"].alias("line"), F.lit(1).alias("lines"), x["text"].alias("text")))
        return F.filter(F.concat(single, _joined(ls)), lambda x: F.lower(x["text"]).rlike(ANCHORS))

    def judge(x: Column) -> Column:
        return _let(classify(x["text"], model, least, overlap), lambda c: F.struct(x["line"].alias("line"), x["lines"].alias("lines"), *[c[f].alias(f) for f in ("license", "probability", "overlap", "held")]))

    found = F.when(F.lower("text").rlike(ANCHORS), _let(lines, candidates))
    judged = _apart(F.transform(F.coalesce(found, F.array().cast(_PARAGRAPHS)), judge))
    out = rows.select("doc_id", judged.alias("paragraphs"))
    named = F.filter("paragraphs", lambda x: x["license"] != "unknown")
    return out.select("doc_id", F.try_element_at(named, F.lit(1))["license"].alias("license"), F.array_sort(F.array_distinct(F.transform(named, lambda x: x["license"]))).alias("licenses"), F.size(named).alias("n_paragraphs"), "paragraphs")
