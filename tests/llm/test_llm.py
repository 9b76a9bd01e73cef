"""The training-data operators against plain versions, and their defined results."""

import hashlib
import math
import os
import random
import re
import unicodedata
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import chat, components, decontam, exact, langid, licenses, mixing, neardup, pii, queries, secrets, shingles, tokens
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "\n\n", "a", "ONE two", "é" * 30, "word " * 30_000, "tie tie tie", "tie tie tie", " x\u0085y", "x\x00y", "😀 token = abcdef", "<|endoftext|> <|im_start|>"]


def make(spark, rows):
    return spark.createDataFrame([(d, t, lang, src, len(t or "")) for d, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows():
    return duckdb.connect().sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, extremes, ties and repeated rows, with columns of clashing names."""
    data = [(i if i != 3 else None, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(HARD)]
    data += [(8, "tie tie tie", "en", "s"), (8, "tie tie tie", "en", "s"), (None, None, None, None)]
    d = make(spark, data)
    return d.withColumns({c: F.lit("x") for c in ("row", "digest", "id", "cls", "keep_id", "text_sha256", "score", "items", "row_key", "_source", "mix_slot", "n_entities", "turns")})


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


# ---- 1 ----------------------------------------------------------------------------------------------


def test_secret_base_spans(spark, docs, rows):
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    for d, t, _ in rows:
        want = brute.secrets(t)
        named = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        r = got[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert not named or set(named.split(",")) <= set(r.spans.split(","))


def test_secret_spans_of_made_texts():
    rng = random.Random(4)
    bits = ["password", "Token", "api_key", "APIKEY", "ſecret", " = ", ":", '"', "'", "abc", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef" * 2, "tok", "en=", " ", "xyz_123456", "é", "secret=token=abcdef"]
    for _ in range(3000):
        t = "".join(rng.choices(bits, k=rng.randint(1, 9)))
        assert secrets.base_spans(t) == brute.secrets(t), t


def test_secret_ownership_separates_copies(spark):
    own, shared = "Zx9Kd83jFq0aLm27TyUw", "Qw12Er34Ty56Ui78Op90"
    data = [(i, f"use {shared} here", "en", f"s{i}") for i in range(5)] + [(9, f"use {own} here", "en", "s9")]
    got = {r.doc_id: r for r in secrets.scan_secrets(make(spark, data)).collect()}
    assert got[9].n_live == 1 and got[9].n_example == 0 and got[9].spans == "opaque:4:24"
    assert all(got[i].n_live == 0 and got[i].n_example == 1 and got[i].spans == "" and got[i].n_owners == 5 for i in range(5))


def test_secret_ownership_counts_repositories(spark):
    """Two owners and many repositories are copies as well; one owner and many repositories aren't."""
    copied, own = "Qw12Er34Ty56Ui78Op90", "Zx9Kd83jFq0aLm27TyUw"
    data = [(i, f"use {copied} here", f"l{i}", f"s{i % 2}") for i in range(8)] + [(20 + i, f"use {own} here", f"l{i}", "s0") for i in range(9)]
    got = {r.doc_id: r for r in secrets.scan_secrets(make(spark, data), repo="concat(source, '/', lang)").collect()}
    assert all((got[i].n_live, got[i].n_example, got[i].n_owners, got[i].n_repos) == (0, 1, 2, 8) for i in range(8))
    assert all((got[20 + i].n_live, got[20 + i].n_example, got[20 + i].n_owners, got[20 + i].n_repos) == (1, 0, 1, 9) for i in range(9))


def test_opaque_spans_touch_no_base_span():
    rng = random.Random(2)
    bits = ["Ab1" * 8, "0123456789abcdef" * 2, "password=", "AKIA", "ABCDEFGHIJKLMNOP1234", " ", "/", "=", "-", "token: ", "x"]
    for _ in range(2000):
        t = "".join(rng.choices(bits, k=rng.randint(1, 12)))
        base = secrets.base_spans(t)
        want = [(m.start(), 3, m.end()) for m in secrets.OPAQUE.finditer(t) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and not any(s < m.end() and m.start() < e for s, _, e in base)]
        assert secrets.opaque_spans(t, base) == want


def test_secret_hard_rows(spark, hard, none):
    got = secrets.scan_secrets(hard).collect()
    assert len(got) == hard.count() and secrets.scan_secrets(none).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == (0, 0, 0, empty, "") for r in got if r.doc_id in (0, 1, 2))
    assert [r.spans for r in got if r.doc_id == 12] == ["assign:2:16"]


# ---- 2 ----------------------------------------------------------------------------------------------


def plain_order(blocks, w):
    """Earliest deadline first, with the windows taken from the ideal by looking at its every block."""
    w = [Fraction(x) for x in w]
    releases, deadlines = {}, {}
    left, now, got = list(blocks), Fraction(0), [Fraction(0)] * len(w)
    while any(got[i] < blocks[i] for i in range(len(w))):
        on = [i for i in range(len(w)) if got[i] < blocks[i]]
        total = sum(w[i] for i in on)
        step = min((blocks[i] - got[i]) * total / w[i] for i in on)
        for i in on:
            k = math.floor(got[i])
            while k <= got[i] + step * w[i] / total and k <= blocks[i]:
                if k >= got[i]:
                    t = now + (k - got[i]) * total / w[i]
                    releases.setdefault((i, k), math.floor(t))
                    deadlines.setdefault((i, k - 1), math.ceil(t))
                k += 1
        got = [g + step * w[i] / total if i in on else g for i, g in enumerate(got)]
        now += step
    out, used = [], [0] * len(w)
    for t in range(sum(blocks)):
        ready = [i for i in range(len(w)) if used[i] < left[i] and releases[i, used[i]] <= t]
        i = min(ready, key=lambda i: (deadlines[i, used[i]], i))
        out.append(i)
        used[i] += 1
    return out


def test_schedule_against_plain_earliest_deadline_first():
    rng = random.Random(1)
    for _ in range(80):
        n = rng.randint(1, 6)
        blocks, w = [rng.randint(0, 25) for _ in range(n)], [rng.randint(1, 40) for _ in range(n)]
        assert mixing.exact_order(blocks, w).tolist() == plain_order(blocks, w)


def test_a_million_slots_keep_to_the_targets():
    blocks = [500_000, 300_000, 150_000, 60_000, 7]
    w = np.sqrt(np.array(blocks, float))
    order = mixing.exact_order(blocks, list(w))
    seen = np.cumsum(order[:, None] == np.arange(5)[None, :], axis=0)
    until = min(int(b / x * w.sum()) for b, x in zip(blocks, w, strict=True)) - 1  # all run until the first has run out
    assert np.abs(seen[:until] - np.arange(1, until + 1)[:, None] * (w / w.sum())[None, :]).max() < 1
    for t in range(until, len(order), 9973):
        assert np.abs(seen[t] - ideal(np.array(blocks), w, t + 1)).max() < 1 + 1e-6


def test_blocks_grow_where_a_schedule_would_be_too_long(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    got = mixing.mix(docs, block_rows=1, most_blocks=100).toPandas()
    assert got.groupby("mix_slot").size().max() == 20 and got.mix_slot.nunique() <= 102 and sorted(got.doc_id) == list(range(2000))


def test_any_number_of_sources(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 2 = 0, concat('s', id), null) as source")
    got = mixing.mix(docs, block_rows=4).toPandas()
    assert sorted(got.doc_id) == list(range(3000)) and got.source.isna().sum() == 1500
    assert sorted(got.mix_slot.unique()) == list(range(1500 + 375))


def ideal(blocks, w, t):
    """Blocks of each source after t slots when all run at their weights without a break."""
    got, left = np.zeros(len(w)), t
    while left > 1e-9 and (got < blocks - 1e-9).any():
        rate = np.where(got < blocks - 1e-9, w, 0)
        rate = rate / rate.sum()
        some = rate > 0
        step = min(left, ((blocks - got)[some] / rate[some]).min())
        got, left = got + rate * step, left - step
    return got


def test_every_prefix_is_within_a_block_of_the_targets():
    rng = random.Random(4)
    cases = [([rng.randint(1, 200) for _ in range(n)], [rng.random() + 0.001 for _ in range(n)]) for n in (1, 2, 5, 9, 30)]
    cases += [([5, 0, 7], [1e-9, 1.0, 3]), ([3] * 1000, [float(i + 1) for i in range(1000)])]
    for blocks, w in cases:
        order = mixing.exact_order(blocks, w)
        assert np.bincount(order, minlength=len(w)).tolist() == blocks
        seen = np.zeros(len(w))
        for t, i in enumerate(order):
            seen[i] += 1
            if len(w) < 100 or t % 97 == 0:
                assert np.abs(seen - ideal(np.array(blocks), np.array(w, float), t + 1)).max() < 1 + 1e-6


def test_mix_does_not_drift_from_the_targets(spark):
    """A hot source with a third of the rows and twenty others; each block is a row."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id div 3 % 20)) as source")
    order = mixing.mix(docs, block_rows=1).orderBy("mix_slot").toPandas().source
    w = order.value_counts() ** 0.5
    w /= w.sum()
    end = max(t for t in range(len(order)) if order[t] != "hot")  # the others run out together
    seen = np.cumsum(order.to_numpy()[:, None] == w.index.to_numpy()[None, :], axis=0)[: end - 20]
    assert np.abs(seen - np.arange(1, len(seen) + 1)[:, None] * w.to_numpy()).max() < 1


def test_mix_keeps_every_row_once(spark, docs):
    m = mixing.mix(docs, block_rows=4).select("doc_id", "source", "mix_slot", "mix_block", "mix_row").toPandas()
    assert sorted(m.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert not m.duplicated(["mix_slot", "mix_row"]).any()
    assert (m.groupby("mix_slot").source.nunique() == 1).all()
    assert (m.groupby(["source", "mix_block"]).mix_slot.nunique() == 1).all()
    assert sorted(m.mix_slot.unique()) == list(range(m.mix_slot.nunique()))
    order = m.sort_values(["source", "mix_block", "mix_row"])
    keys = [hashlib.md5(f"mix\x1f{d}".encode()).hexdigest() for d in order.doc_id]
    for _, g in order.assign(k=keys).groupby("source"):
        assert list(g.k) == sorted(g.k)


def test_mix_query_returns_whole_rows(spark, docs):
    got = queries.op2_mix_sources(spark, SF)
    assert got.columns == [*docs.columns, "mix_slot", "mix_block", "mix_row"]
    assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_mix_hard_rows(spark, hard, none):
    assert mixing.mix(hard).count() == hard.count()
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(hard, {"s": 1.0})
    assert mixing.mix(hard, {"s": 1.0}, default_weight=2.0).count() == hard.count()
    with pytest.raises(ValueError):
        mixing.mix(hard, {"s": 0.0, None: 1.0})


# ---- 3 ----------------------------------------------------------------------------------------------


def test_license_lines(spark):
    data = [("mit", "x\nReleased under the MIT License.\ny"), ("apache", "Licensed under the Apache License, Version 2.0."), ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
            ("bsd", "Licensed under the BSD 3-Clause License"), (None, "He lost his driving license."), (None, "A licence that I invented"), (None, None), (None, "")]
    got = {r.doc_id: r for r in licenses.scan_licenses(make(spark, [(i, t, None, None) for i, (_, t) in enumerate(data)])).collect()}
    assert [got[i].license for i in range(len(data))] == [x for x, _ in data]
    assert got[0].paragraphs[0].line == 1


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:"""


def test_wrapped_notices(spark):
    narrow = "\n".join(" ".join(licenses._words(MIT)[k : k + 3]) for k in range(0, 27, 3))
    prose = "The river rose and the town slept on while rain fell over the fields and the hills beyond. " * 4
    data = [("mit", MIT), ("gpl", GPL), ("bsd", BSD), ("mit", narrow), ("unlicense", "This is free and unencumbered software released\r\ninto the public\r\ndomain."),
            ("gpl", "A tool.\n\n" + GPL + "\n\n" + prose), ("mit", prose + "\n" + prose + " Released under the\nMIT License. " + prose), (None, "He lost his driving\nlicense. The terms and\nconditions of sale"),
            (None, "Released under the\n\nMIT of Boston granted a license")]
    got = {r.doc_id: r for r in licenses.scan_licenses(make(spark, [(i, t, None, None) for i, (_, t) in enumerate(data)])).collect()}
    assert [got[i].license for i in range(len(data))] == [x for x, _ in data]
    assert [got[i].n_paragraphs for i in range(4)] == [1, 1, 1, 1]
    assert (got[5].paragraphs[0].line, got[6].paragraphs[0].line) == (2, 1)


def test_a_part_of_a_template_is_confirmed_by_its_own_trigrams(spark):
    got = licenses.scan_licenses(make(spark, [(0, "Neither the name of the copyright holder nor the names of its contributors may be", None, None)])).collect()[0]
    assert got.license == "bsd" and got.paragraphs[0].overlap == 1.0


def test_anchors_lose_nothing(spark):
    """No paragraph without an anchor word holds as many trigrams of any template as confirm it."""
    anchors = set(licenses.ANCHOR_WORDS)
    flat = [(c, t) for c, ts in licenses.TEMPLATES.items() for t in ts]
    for _, t in flat:
        assert sum(not anchors & set(x.split()) for x in licenses.trigrams(licenses._words(t))) < licenses.needed(t), t
    got = {r.doc_id: r.license for r in licenses.scan_licenses(make(spark, [(i, t, None, None) for i, (_, t) in enumerate(flat)])).collect()}
    assert sum(got[i] == c for i, (c, _) in enumerate(flat)) >= len(flat) - 1


#: Notices in words or layouts that training hasn't seen, and texts that name no licence.
HELD_OUT = [
    ("mit", "// SPDX-License-Identifier: MIT"), ("apache", "# SPDX-License-Identifier: Apache-2.0"), ("gpl", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("bsd", "SPDX-License-Identifier: BSD-3-Clause"), ("epl", " * SPDX-License-Identifier: EPL-2.0"),
    ("mit", "This project is licensed under the MIT License - see the LICENSE file for details."), ("mit", "The code is released\nunder the MIT license."), ("apache", "This repository is licensed under the\nApache License, Version 2.0; see NOTICE."),
    ("apache", "Licensed to the Foundation under one or more agreements.\nYou may not use this file except in compliance\nwith the License."),
    ("apache", "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "* Neither the name of the copyright holder nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission."),
    ("zlib", "In no event will the authors be held liable for any damages\narising from the use of this software."), ("epl", "This program and the accompanying materials\nare made available under the terms of the Eclipse Public License 2.0\nwhich is available at a site"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not distributed with this file, get one."), ("lgpl", "This library is free software; you can use it under the terms of the GNU Lesser\nGeneral Public License as published."),
    ("agpl", "This program is free software under the terms of the GNU\nAffero General Public License, version 3."), ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that notices stay."),
    ("cc-by-sa", "Except where noted, this work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."), ("cc-by", "Text: this work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("boost", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)"), ("unlicense", "This is free and unencumbered software\nreleased into the public domain."), ("cc0", "To the extent possible under law, the author has waived\nall copyright and related rights to this work."),
    ("gpl", GPL), ("bsd", BSD), ("mit", MIT),
    *[(None, t) for t in ("SPDX-License-Identifier: LicenseRef-Custom", "His license was revoked after the accident on the bridge.", "The software was tested for three weeks before it was released.", "Ask for permission to use the copy machine in the hall.",
                          "The GNU is an antelope that lives in herds on the plain.", "Subject to the conditions of sale, the goods may be returned.", "A program of free concerts is available in the park.", "Copyright disputes about songs are common.",
                          "The MIT campus lies on the river.", "Mozilla and the Apache project held a conference.", "All rights of way are marked on the map.", "The terms of the lease were made available to the public.")],
]


def test_notices_held_out_of_training(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(make(spark, [(i, t, None, None) for i, (_, t) in enumerate(HELD_OUT)])).collect()}
    right = [got[i].license == want for i, (want, _) in enumerate(HELD_OUT)]
    assert np.mean(right) >= 0.94, [(HELD_OUT[i], got[i].license, got[i].paragraphs) for i, ok in enumerate(right) if not ok]
    assert not any(got[i].license for i, (want, _) in enumerate(HELD_OUT) if want is None)
    sure = [max((p.probability for p in got[i].paragraphs if p.license == want), default=0.0) for i, (want, _) in enumerate(HELD_OUT) if want]
    assert abs(np.mean(sure) - np.mean([ok for ok, (want, _) in zip(right, HELD_OUT, strict=True) if want])) < 0.2


def test_license_hard_rows(spark, hard, none):
    got = licenses.scan_licenses(hard).collect()
    assert len(got) == hard.count() and all(r.license is None and r.n_paragraphs == 0 for r in got)
    assert licenses.scan_licenses(none).count() == 0
    long = "word " * 20_000 + "\nReleased under the MIT License.\n" + "word " * 20_000
    assert licenses.scan_licenses(make(spark, [(1, long, None, None), (1, long, None, None)])).select("license").collect() == [("mit",), ("mit",)]


def test_licenses_in_documents(spark, docs, rows):
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
    words = {"MIT License": "mit", "Apache License": "apache", "GNU General": "gpl", "CC BY-NC": "cc-by-nc"}
    for d, t, _ in rows:
        want = {v for k, v in words.items() if k in t and "icensed under" in t or k in t and "eleased under" in t}
        assert (got[d] in want) if want else got[d] is None


# ---- 4 ----------------------------------------------------------------------------------------------


def variants(n, seed, base_words=120, edits=12):
    """Copies of one text with random words changed, so that many pairs lie near the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def check_near(spark, data, k, num):
    df = make(spark, [(i, t, None, None) for i, t in enumerate(data)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, k, num, 100).collect()}
    assert got == brute.near_components(list(enumerate(data)), k, num, 100)


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(2)
    data = variants(160, 1) + variants(40, 2, 30, 3) + [" ".join(f"q{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(40)]
    data += ["", " ", "one", "ONE", "one two", "one  two\n", "a b c", "a b c"] * 2
    check_near(spark, data, 3, 85)


def test_near_groups_on_the_smallest_table(spark, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 5, 80, 100).collect()}
    assert got == brute.near_components([(d, t) for d, t, _ in rows], 5, 80, 100)


def test_components_in_rounds(spark):
    rng = random.Random(3)
    n = 300
    edges = [(i, i + 1) for i in range(0, 150)] + [(rng.randrange(150, n), rng.randrange(150, n)) for _ in range(120)] + [(5, i) for i in range(60, 90)]
    b = lambda x: x.to_bytes(4, "big")
    df = spark.createDataFrame([(b(x), b(y)) for x, y in edges if x != y], "a binary, b binary")
    top = list(range(n))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, y in edges:
        x, y = sorted((root(x), root(y)))
        top[y] = x
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    for held in (10**6, 3):
        got = {int.from_bytes(r.node, "big"): int.from_bytes(r.comp, "big") for r in components.components(df.repartition(8), held).collect()}
        assert got == want
    assert components.components(df.limit(0)).count() == 0


def test_blocks_of_a_large_region_find_the_same(spark, monkeypatch):
    """A region of hundreds of members in more than twenty blocks, few of them linked by neighbours."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
    seen = []
    real = neardup.discard
    monkeypatch.setattr(neardup, "discard", lambda *t: [seen.append(x.agg(F.max("mains") + F.max("others")).first()[0]) for x in t if x is not None and "mains" in x.columns] + [real(*t)])
    check_near(spark, variants(400, 7, 120, 16), 3, 85)
    assert max(seen) > 20


def merged(names, pairs):
    """The groups that pairs make of names."""
    top = {c: c for c in names}
    for x, y in pairs:
        old, new = top[x], top[y]
        top = {c: new if t == old else t for c, t in top.items()}
    return {frozenset(c for c in top if top[c] == t) for t in top.values()}


def test_joining_links_are_those_of_all_pairs():
    rng = random.Random(9)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 25))), np.int64) for _ in range(rng.randint(2, 40))]
        comp = [bytes([rng.randrange(6)]) for _ in sets]
        got = [(a[0], b[0]) for a, b in neardup._joining([bytes([i]) for i in range(len(sets))], comp, sets, 60, 100)]
        assert all(comp[a] != comp[b] and shingles.similar(sets[a], sets[b], 60, 100) for a, b in got)
        links = [(comp[i], comp[j]) for i in range(len(sets)) for j in range(i) if shingles.similar(sets[i], sets[j], 60, 100)]
        assert merged(comp, [(comp[a], comp[b]) for a, b in got]) == merged(comp, links)


@pytest.mark.parametrize("edge_rows", [200_000, 40])
def test_neighbours_across_partitions(spark, monkeypatch, edge_rows):
    """Partitions of a few rows each: most neighbours lie in different ones."""
    monkeypatch.setattr(neardup, "EDGE_ROWS", edge_rows)
    base, trees = neardup.forest_shape(0.8)
    rng = random.Random(3)
    ids = [bytes([rng.randrange(256) for _ in range(16)]) for _ in range(60)]
    sigs = [b"".join(rng.choice([b"\0\1", b"\0\2"]) if rng.random() < 0.2 else b"\0\0" for _ in range(trees * neardup.DEPTH)) for _ in ids]
    df = spark.createDataFrame(list(zip(ids, sigs, strict=True)), "cls binary, sig binary")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        forest = neardup._forest(df, base, trees)
        got = {(bytes(r.a), bytes(r.b)) for x in (forest.filter("kind = 0"), neardup._across(forest, base)) for r in x.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    width = 2 * neardup.DEPTH
    want = set()
    for t in range(trees):
        rows = sorted((s[t * width : (t + 1) * width], c) for c, s in zip(ids, sigs, strict=True))
        want |= {tuple(sorted((x[1], y[1]))) for x, y in zip(rows, rows[1:], strict=False) if x[0][: 2 * base] == y[0][: 2 * base]}
    assert want and want <= got


def test_forest_shapes():
    for t in (0.5, 0.8, 0.85, 0.95, 1.0):
        base, trees = neardup.forest_shape(t)
        assert (1 - t**base) ** trees <= neardup.MISS and trees <= neardup.MOST_TREES
    assert neardup.forest_shape(0.8)[0] == 6


def test_near_hard_rows(spark, hard, none):
    got = neardup.near_duplicates(hard).collect()
    assert len(got) == hard.count()
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in got if r.doc_id in (0, 1, 2))
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    kept = neardup.dedup(hard)
    assert kept.columns == hard.columns and {8} == {r.doc_id for r in kept.collect()} & {8, 9}
    assert neardup.near_duplicates(none).count() == 0 and neardup.dedup(none).count() == 0


def test_minhash_estimates():
    a, b = (shingles.shingle_set(" ".join(f"w{i}" for i in r), 1, shingles.WordHashes()) for r in (range(0, 900), range(100, 1000)))
    by = shingles.multipliers(512)
    same = np.mean(shingles.minhash(a, by) == shingles.minhash(b, by))
    assert same == pytest.approx(0.8, abs=0.08)


# ---- 5 ----------------------------------------------------------------------------------------------

KEY = b"test"


def test_surrogates_fit_their_kind():
    t = "Dr. Anna Weber wrote a.b7@mail.example.com, called +1 (415) 555-0133, paid with 4111 1111 1111 1111 from 10.0.0.1; 078-05-1120; Mr Weber agreed, Herr Иван Петров too."
    new, n = pii.rewrite(t, KEY, {})
    for gone in ("Anna", "Weber", "a.b7@mail", "555-0133", "4111 1111", "10.0.0.1", "078-05-1120", "Петров"):
        assert gone not in new, gone
    assert pii.rewrite(t, KEY, {}) == (new, n) and pii.rewrite(t, b"other", {})[0] != new
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert card[0] == "4" and pii.luhn(card)
    surname = re.search(r"Mr (\w+) agreed", new)[1]
    assert new.count(surname) == 2
    first = re.match(r"Dr\. (\w+)", new)[1]
    assert first in pii.FIRST[("latin", "f")]
    assert pii.script(re.search(r"Herr \w+ (\w+)", new)[1]) == "cyrillic"
    assert re.search(r"\w\.\w\d@\w+\.\w+\.com", new) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)


def planted_texts(n=400, seed=11):
    """Sentences with entities whose places are known as they are written."""
    rng = random.Random(seed)
    digits = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))
    surnames = ["Weber", "Okafor", "Lindqvist", "O-Brien".replace("-", ""), "Tanaka", "Kumar"]
    kinds = {
        "mail": lambda: f"{rng.choice('abc')}{digits(2)}.x@mail{digits(1)}.example.org", "ip": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)), "ip6": lambda: f"fe80::{rng.randint(10, 99)}:{rng.randint(100, 999)}",
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "card": lambda: "4" + digits(3) + "".join(f" {digits(4)}" for _ in range(3)), "phone": lambda: f"+44 {rng.randint(20, 99)} {digits(4)} {digits(4)}", "plain": lambda: f"5{digits(9)}",
        "iban": lambda: "DE" + pii.iban_check("DE", b := digits(18)) + b, "name": lambda: f"{rng.choice(['Anna', 'Paul', 'Marta'])} {rng.choice(surnames)}", "title": lambda: rng.choice(surnames), "cue": lambda: f"Rajesh {rng.choice(surnames)}",
    }
    frames = {"plain": "we called {} today", "title": "then Mr {} came", "cue": "hello, my name is {}"}
    calm = ["the river rose by 12 cm", "it is 12:30:45 now", "version 1.2.3 of std::map", "in 2024 there were 1,000,000 of them", "see page 12-34", "x = a[1]::b", "order 66"]
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.4:
                s = rng.choice(calm)
            else:
                k = rng.choice(sorted(kinds))
                v, frame = kinds[k](), frames.get(k, "so {} it was")
                s = frame.format(v)
                lo = at + frame.index("{")
                spans.append((lo, lo + len(v)))
            parts.append(s)
            at += len(s) + 2
        out.append((". ".join(parts), spans))
    return out


def test_found_entities_are_those_planted():
    for t, spans in planted_texts():
        covered = [any(s <= i < e for s, e, *_ in pii.find(t)) for i in range(len(t))]
        for s, e in spans:
            inside = [covered[i] for i in range(s, e) if t[i] not in " @"]
            assert all(inside), (t, t[s:e], pii.find(t))
        planted = {t[s:e] for s, e in spans} | {w for s, e in spans for w in t[s:e].split(" ")}
        for s, e, kind, _ in pii.find(t):
            assert any(lo <= s and e <= hi for lo, hi in spans) or t[s:e] in planted, (t, t[s:e], kind)


def test_mentions_of_one_person_stay_together():
    new, _ = pii.rewrite("Anna Weber met us. Later Weber said that Anna agreed.", KEY, {})
    first, last = re.match(r"(\w+) (\w+) met us\. Later \2 said that \1 agreed\.$", new).groups()
    assert first not in ("Anna", "Weber") and last not in ("Anna", "Weber")
    a, b = (pii.rewrite(t, KEY, {})[0] for t in ("Dr Kim Lee and Ms Kim Lee", "Dr Kim Lee"))
    assert a.split()[1] == a.split()[5] and pii.find("Dr Kim Lee")[0][2] == "first:latin:"
    assert b.split()[1] in pii.NEUTRAL["latin"]


def test_scripts_and_formats_are_kept():
    for name, script in (("太郎", "cjk"), ("محمد", "arabic"), ("दीपक", "devanagari"), ("Иван", "cyrillic")):
        new = pii.rewrite(f"Mr {name}", KEY, {})[0].removeprefix("Mr ")
        assert new != name and all(pii.script(c) == script for c in new if c.isalpha()), (name, new)
    iban = pii.rewrite("pay GB82 WEST 1234 5698 7654 32 now", KEY, {})[0]
    value = re.search(r"GB\d\d(?: \w{4}){4} \w\w", iban)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1
    assert pii.rewrite("Frau Anna-Lena Müller-Weber", KEY, {})[0].count("-") == 2
    many = {pii.surrogate(KEY, "first:latin:f", "anna", k) for k in range(30)}
    assert len(many) > 20 and not any("-" in x for x in many)


def test_texts_without_entities_stay(spark, docs, rows):
    """Held against a plain reading of the words, not against `find`."""
    got = {r.doc_id: r for r in pii.pseudonymise_rows(docs.select("doc_id", "text"), KEY).collect()}
    for d, t, _ in rows:
        want = brute.addresses(t)
        for value in want:
            assert value not in got[d].text
        if not want and not re.search(r"\d{3}|\b(?:Mr|Mrs|Ms|Dr|Frau|Herr|Sr|Prof|Miss)\b", t) and not any(n in t for v in pii.FIRST.values() for n in v):
            assert got[d].text == t and got[d].n_entities == 0


def test_surrogates_are_distinct_and_nobodys(spark):
    """First names have few surrogates, so that collisions must be resolved."""
    names = pii.FIRST[("latin", "f")]
    data = [(i, f"Frau {n} Xyz met ms {n} Abc.", None, None) for i, n in enumerate(names)]
    d = make(spark, data)
    found = pii.entities(d)
    done, odd = pii.assign(found, KEY)
    rows = done.collect()
    assert len(rows) == found.count() and odd.count() > 0
    assert len({(r.kind, r.new) for r in rows}) == len(rows)
    assert not {(r.kind, r.new) for r in rows} & {(r.kind, r.normal) for r in rows}
    small = {r.doc_id: r.text for r in pii.pseudonymise_rows(d, KEY).collect()}
    joined = {r.doc_id: r.text for r in pii.pseudonymise_rows(d, KEY, broadcast_exceptions=0).collect()}
    assert small == joined and all(n not in small[i] for i, n in enumerate(names))


def test_surrogates_hard_rows(spark, hard, none):
    got = pii.pseudonymise_rows(hard, KEY)
    assert got.count() == hard.count() and got.filter("text is null").count() == 2
    assert pii.pseudonymise_rows(none, KEY).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4])
    scores, start, move = rng.normal(size=(8, 2)), np.exp(rng.normal(size=2)), np.exp(rng.normal(size=(2, 2)))
    p, pairs = langid.posteriors(scores, lengths, start, move)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in lengths:
        z, marg, pr = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2**n):
            path = [(code >> i) & 1 for i in range(n)]
            w = start[path[0]] * np.exp(sum(scores[at + i, y] for i, y in enumerate(path)))
            for a, b in zip(path, path[1:], strict=False):
                w *= move[a, b]
            z += w
            for i, y in enumerate(path):
                marg[i, y] += w
            for a, b in zip(path, path[1:], strict=False):
                pr[a, b] += w
        assert np.allclose(p[at : at + n], marg / z)
        want_pairs += pr / z
        at += n
    assert np.allclose(pairs, want_pairs)


def test_language_of_held_out_rows(spark, model, rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_words_of_mixed_text(model, rows):
    by = {lang: next(t for _, t, x in rows if x == lang and len(t) > 800) for lang in ("en", "de")}
    chain = [w for lang in ("en", "de") for w in [w for line in langid.lines(by[lang]) for w in line][:12]]
    p = model.label([chain])
    i = {x: k for k, x in enumerate(model.langs)}
    assert p[: len(chain) // 2, i["en"]].mean() > 0.7 and p[len(chain) // 2 :, i["de"]].mean() > 0.7


def test_language_hard_rows(spark, model, hard, none):
    got = langid.identify(hard, model).collect()
    assert len(got) == hard.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (0, 1, 2))
    kept = langid.keep_identified(hard, model)
    assert kept.columns == hard.columns and kept.filter("text is null or trim(text) = ''").count() == 0
    assert langid.fit(none).langs == [] and langid.identify(hard, langid.fit(none)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(none, model).count() == 0


def test_every_language_is_learned(spark):
    """Seventy languages of words of their own, rare ones too, and one id that very many rows share."""
    rng = random.Random(8)
    own = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(70)}
    data = [(1000 * j + k, " ".join(rng.choices(w, k=15)), lang, "s") for k, (lang, w) in enumerate(own.items()) for j in range(8 if k < 60 else 4)]
    m = langid.fit(make(spark, data + [(-1, " ".join(rng.choices(own["l00"], k=5)) + f" {i}", "l00", "s") for i in range(700)]), per_lang=4)
    assert m.langs == sorted(own)
    assert np.mean([got.lang == x[2] for x, got in zip(data, m.predict([x[1] for x in data]), strict=True)]) > 0.98


def test_numerals_and_symbols_are_no_letters(spark, model):
    texts = ["½ ² ①", "Ⅷ ٣ 12", "— § © 100 %", "\u0301 \u200d", "😀", "½ haus und garten", "straße ²"]
    got = langid.identify(make(spark, [(i, t, None, None) for i, t in enumerate(texts)]), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [not any(unicodedata.category(c)[0] == "L" for c in t) for t in texts]
    assert all(r.score == 0 for r in got[:5])


def test_texts_of_no_learned_language_are_rejected(spark, model, rows):
    rng = random.Random(3)
    strange = [" ".join("".join(chr(0x10D0 + rng.randrange(33)) for _ in range(6)) for _ in range(40)), " ".join("".join(rng.choices("日月火水木金土山川", k=5)) for _ in range(30))]
    data = [(i, t, None, None) for i, t in enumerate(strange)] + [(100 + d, t, lang, None) for d, t, lang in rows if langid.lines(t)]
    got = {r.doc_id for r in langid.keep_identified(make(spark, data), model).collect()}
    assert got == {d for d, *_ in data if d >= 100}


def test_runs_of_code_switched_text(spark, model, rows):
    by = {lang: next(t for _, t, x in rows if x == lang and len(t) > 800) for lang in ("en", "de")}
    parts = {lang: " ".join([w for line in langid.lines(t) for w in line][:15]) for lang, t in by.items()}
    text = f"{parts['en']} {parts['de']}"
    got = langid.label_runs(make(spark, [(1, text, None, None), (2, None, None, None), (3, "12", None, None)]), model).collect()
    assert {r.doc_id for r in got} == {1} and sum(r.words for r in got) == 30
    at = {lang: sum(min(r.end, hi) - max(r.start, lo) for r in got if r.lang == lang and r.end > lo and r.start < hi) for lang, lo, hi in (("en", 0, len(parts["en"])), ("de", len(parts["en"]) + 1, len(text)))}
    assert at["en"] > 0.7 * len(parts["en"]) and at["de"] > 0.7 * len(parts["de"])
    one = langid.identify(make(spark, [(1, text, None, None)]), model).first()
    assert sum(x.words for x in one.word_langs) == 30 and {x.lang for x in one.word_langs} >= {"en", "de"}


def test_training_in_blocks_gives_the_same(rows, model, monkeypatch):
    sample = [(lang, t[:300]) for _, t, lang in rows[:40]]
    whole = langid.train(sample, rounds=5)
    monkeypatch.setattr(langid, "CELLS", 500)
    assert np.allclose(langid.train(sample, rounds=5).weights, whole.weights, atol=1e-5)


def test_chunks_and_memory_do_not_change_predictions(model, rows, monkeypatch):
    texts = [t for _, t, _ in rows[:60]]
    want = model.predict(texts)
    monkeypatch.setattr(langid, "CHUNK", 500)
    monkeypatch.setattr(langid, "REMEMBERED", 300)
    model._known.clear()
    model._scores = None
    got = model.predict(texts)
    assert [(g.lang, g.words) for g in got] == [(w.lang, w.words) for w in want]
    assert np.allclose([g.score for g in got], [w.score for w in want], atol=1e-5)


# ---- 7 ----------------------------------------------------------------------------------------------


def conversation_rows():
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randint(0, 99)}" for _ in range(n)) + "."
    return [(c, t, "user" if t % 2 == 0 else "assistant", say(rng.randint(3, 12)) + ("?" if t % 2 == 0 else "\n" + say(40))) for c in range(120) for t in range(rng.randint(2, 8))]


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(1)
    m = chat.Hmm(*[np.log(rng.dirichlet(np.ones(s[-1]), size=s[:-1] or None)) for s in ((6,), (6, 6), (6, chat.N_MARKS), (6, chat.N_FEATURES))])
    lines = ["User: hi?", "more text here", "Assistant: " + "w " * 30]
    seen = [chat.observe(x, k == 0) for k, x in enumerate(lines)]
    best = max(((sum([m.start[p[0]]] + [m.move[a, b] for a, b in zip(p, p[1:], strict=False)] + [m.mark[s, o[0]] + m.feature[s, o[1]] for s, o in zip(p, seen, strict=True)]), p) for p in np.ndindex(6, 6, 6)))[1]
    assert m.viterbi(lines)[0] == list(best)


def role_accuracy(out):
    right = 0
    for r in out:
        right += [t.role for t in r.turns] == [chat.ROLES[s // 2] for s in r.states if s % 2 == 0]
        assert r.chat.count("<|im_start|>") == len(r.turns)
    return right / len(out)


def test_roles_are_recovered(spark):
    df = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    raw = chat.transcripts(df).cache()
    out = chat.parse_transcripts(raw, chat.fit(raw)).collect()
    assert len(out) == 120 and role_accuracy(out) > 0.85


def test_roles_by_unknown_names(spark, monkeypatch):
    """Speakers that neither the parser's list nor the training styles name."""
    df = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    raw = chat.transcripts(df).cache()
    model = chat.fit(raw)
    rows = [r for r in conversation_rows()]
    texts = []
    for c in range(120):
        own = [(t, role, x) for k, t, role, x in rows if k == c]
        names = {"user": f"Zuleika {c}x", "assistant": "Ferdinand"}
        lines, states = [], []
        for _, role, x in own:
            part = f"{names[role]}: {x}".split("\n")
            lines += part
            states += [2 * chat.ROLES.index(role)] + [2 * chat.ROLES.index(role) + 1] * (len(part) - 1)
        texts.append(("\n".join(lines).replace(f" {c}x", "a"), states))
    out = chat.parse_transcripts(spark.createDataFrame(texts, "transcript string, states array<int>"), model).collect()
    assert role_accuracy(out) > 0.85


def test_long_conversations_stay_in_order(spark):
    """Parts follow the order of turns, however the conversation is spread over ranges; a whole one is one row."""
    data = [("long", i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(700)] + [("short", 0, "user", "hi"), ("short", 1, "assistant", "ho"), ("same", 3, "user", "x"), ("same", 3, "user", "x")]
    df = spark.createDataFrame(data, "conv_id string, turn long, role string, text string").repartition(6)
    whole = {r.conv_id: r for r in chat.transcripts(df).collect()}
    assert len(whole) == 3 and [x for x in whole["same"].transcript.split() if x.endswith("x")] == ["x", "x"]
    assert re.findall(r"turn (\d+)", whole["long"].transcript) == [str(i) for i in range(700)]
    parts = sorted((r.part, r.transcript) for r in chat.transcripts(df, part_turns=100).collect() if r.conv_id == "long")
    assert [p for p, _ in parts] == list(range(7))
    assert re.findall(r"turn (\d+)", "\n".join(t for _, t in parts)) == [str(i) for i in range(700)]
    assert all(len(re.findall(r"turn", t)) == 100 for _, t in parts)


def test_markers():
    for line, role in (("User: hi", "user"), ("### assistant", "assistant"), ("[Human] hey", "user"), ("<|system|>", "system"), ("A: yes", "assistant"), ("**Bot:** ok", "assistant")):
        m, _, rest = chat.observe(line, False)
        assert chat._MARKS[m] == role and ":" not in rest
    assert chat._MARKS[chat.observe("John Smith: hello", False)[0]] == "first"
    assert [chat._MARKS[m] for m, _, _ in chat.observed(["Note: x", "Ann: a", "Bo Li: b", "Ann: c", "Bo Li: d", "e"])] == ["other", "first", "second", "first", "second", "none"]
    assert chat._MARKS[chat.observe("Answering is hard", False)[0]] == "none"


def test_chat_hard_rows(spark):
    data = [(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, None, "tool", "x"), *[(3, 5, "user", f"t{i}") for i in range(60)]]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    raw = chat.transcripts(df, part_turns=8)
    got = chat.parse_transcripts(raw, chat.fit(raw))
    assert got.count() == 11 and raw.filter("conv_id = '3'").count() == 8
    assert sum(len(r.states) for r in raw.collect()) == len(data)
    assert chat.transcripts(df.limit(0)).count() == 0
    texts = spark.createDataFrame([(None, "a"), ("", "b"), ("plain words only", "c")], "transcript string, turns string")
    out = chat.parse_transcripts(texts, chat.fit(raw)).collect()
    assert [len(r.turns) for r in out][:2] == [0, 0] and out[0].chat == ""


# ---- 8 ----------------------------------------------------------------------------------------------


def test_tiling_against_plain_tiling():
    rng = random.Random(5)
    for _ in range(250):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 40))] for _ in range(2))
        for least in (2, 3, 5):
            # ties may be broken in another order, which can change later tiles; the longest never
            got, want = decontam.tile(a, b, least), brute.tiles(a, b, least)
            assert max((k for *_, k in got), default=0) == max((k for *_, k in want), default=0)
            assert all(a[i : i + k] == b[j : j + k] and k >= least for i, j, k in got)
            used = [x for i, _, k in got for x in range(i, i + k)]
            assert len(used) == len(set(used))
            assert bool(got) == bool(want)


def test_reordered_passages_are_caught(spark):
    item = " ".join(f"b{i}" for i in range(40))
    w = item.split()
    data = [(0, "x y " + item + " z"), (1, " ".join(["p", *w[20:], "q", *w[:20]]).upper()), (2, " ".join(w[:8]) + " nothing else"), (3, "clean words only"), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "two words"), (None, "some other item of the test")], "item_id long, text string")
    df = make(spark, [(i, t, None, None) for i, t in data])
    for bound in (10**6, 20):
        got = {r.doc_id: r for r in decontam.find_contamination(df, bench, block_words=bound).collect()}
        assert [got[i].contaminated for i in range(6)] == [True, True, False, False, False, False]
        assert got[0].coverage == 1.0 and got[1].best_item == 7 and got[2].coverage == pytest.approx(0.2)
        assert {r.doc_id for r in decontam.decontaminate(df, bench, block_words=bound).collect()} == {2, 3, 4, 5}


def test_contamination_on_the_smallest_table(spark, docs, rows):
    bench = duckdb.connect().sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = {d for d, t, _ in rows for _, x in bench if " ".join(decontam.words(x)) in " ".join(decontam.words(t))}
    got = {r.doc_id for r in decontam.find_contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    assert want and want == got


def test_contamination_hard_rows(spark, hard, none):
    bench = spark.createDataFrame([(1, "tie tie tie")], "item_id long, text string")
    assert decontam.find_contamination(hard, bench).count() == hard.count()
    assert decontam.decontaminate(hard, bench).columns == hard.columns
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.find_contamination(hard, bench.limit(0)).filter("contaminated").count() == 0


def test_large_benchmarks_give_the_same(spark, hard):
    """Both paths on null ids, ids that rows share, repeated rows and items, and hard texts."""
    item = " ".join(f"b{i}" for i in range(30))
    bench = spark.createDataFrame([(1, "tie tie tie"), (1, "Tie, tie, TIE"), (4, item), (3, item), (None, item + " x"), (None, "é" * 30), (5, None), (6, ""), (8, "слово " * 7)], "item_id long, text string")
    more = make(spark, [(None, item, None, None), (None, "clean", None, None), (50, item, None, None), (50, "other words here", None, None), (50, item, None, None), (51, "слово " * 9, None, None), (52, None, None, None)])
    for df in (hard, more):
        got = [sorted(map(repr, decontam.find_contamination(df, bench, block_words=bound).collect())) for bound in (10**6, 20)]
        assert got[0] == got[1] and any("contaminated=True" in r for r in got[0])
        kept = [sorted(map(repr, decontam.decontaminate(df, bench, block_words=bound).collect())) for bound in (10**6, 20)]
        assert kept[0] == kept[1] and 0 < len(kept[0]) < len(got[0])
    assert sorted((r.doc_id is None, r.text) for r in decontam.decontaminate(more, bench, block_words=20).filter("text is not null").collect()) == [(False, "other words here"), (True, "clean")]


def test_benchmark_words_of_any_script_count(spark):
    bench = spark.createDataFrame([(i, " ".join(["слово", "λόγος", "शब्द"] * 40)) for i in range(9)], "item_id long, text string")
    assert len(list(decontam._blocks(bench, decontam.SEED, 400, "item_id", "text"))) > 1
    assert len(list(decontam._blocks(bench, decontam.SEED, 10_000, "item_id", "text"))) == 1
    assert sum(len(x.items) for x in decontam._blocks(bench, decontam.SEED, 400, "item_id", "text")) == 9


# ---- 9 ----------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, docs, rows, hard, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    got = {r.doc_id: r for r in tokens.token_counts(docs, path).collect()}
    for d, t, _ in rows:
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), n(t), n(t) > 2048)
    assert [r.n_tokens for r in tokens.token_counts(hard, path).collect()] == [n(r.text) for r in hard.select("text").collect()]
    assert tokens.token_counts(none, path).count() == 0


def test_token_counts_of_odd_strings():
    import public_tokenizers

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    c = tokens.Counter(spec, *tokens._proven(spec))
    rng = random.Random(8)
    bits = ["don't", "I'LL", "we're", "'s", "''", "É", "ß", "ſ", "İ", "K", "Σας", "１２", "12a", "½", "µ", "\x85", "\xa0", "\x1c", "é", "<|endoftext|>", "<|startoftext|", " ", "\n", "naïve", "😀", "ŉ", "the", "THE", "_", "’"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 8))) for _ in range(4000)]
    assert c.count(texts) == [len(e.ids) for e in c.tok.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_encode_alone():
    import public_tokenizers

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    whole = tokens._proven(spec)[0]
    assert len(whole) > 20_000
    lib = tokens._load(spec)
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(whole), 500))


# ---- 10 ---------------------------------------------------------------------------------------------


def test_exact_groups(spark, rows):
    data = [(i, t) for i, (_, t, _) in enumerate(rows[:80])] * 1 + [(1000 + i, t) for i, (_, t, _) in enumerate(rows[:30])] + [(2000, None), (2001, "")]
    df = make(spark, [(d, t, None, None) for d, t in data])
    got = {r.doc_id: r for r in exact.annotate(df, exact.DigestIndex(spark)).collect()}
    for d, (keep, n) in brute.exact(data).items():
        t = dict(data)[d] or ""
        assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == (keep, n, keep == d, hashlib.sha256(t.encode()).hexdigest())


def test_index_persists_between_batches(spark, tmp_path):
    path = f"file:{tmp_path}/index"
    first, second = (make(spark, [(d, t, None, None) for d, t in x]) for x in ([(1, "a"), (2, "a"), (3, "b")], [(9, "a"), (10, "c"), (11, "c")]))
    assert sorted(r.doc_id for r in exact.dedup(first, exact.DigestIndex(spark, path, buckets=4)).collect()) == [2, 3]
    again = exact.DigestIndex(spark, path, buckets=4)
    assert [r.doc_id for r in exact.dedup(second, again).collect()] == [11]
    assert {(r.doc_id, r.keep_id) for r in exact.annotate(second, again).collect()} == {(9, 2), (10, 11), (11, 11)}
    assert again.table().count() == 3
    p = again.unseen(spark.createDataFrame([("x", 1)], "digest string, keep_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in p and p.count("Exchange") == 1


def test_buckets_follow_the_rows_and_stay(spark, tmp_path):
    assert exact.DigestIndex(spark).buckets == exact.LEAST_BUCKETS
    assert exact.DigestIndex(spark, rows=100_000_000).buckets == 50
    path = f"file:{tmp_path}/index"
    index = exact.DigestIndex(spark, path, rows=30_000_000)
    assert index.buckets == 15
    index.append(spark.createDataFrame([("a", 1), ("b", 2)], "digest string, keep_id long"))
    spark.sql(f"DROP TABLE {index.name}")  # as in another session: the files stay
    again = exact.DigestIndex(spark, path, rows=10)
    assert again.buckets == 15 and again.table().count() == 2


def test_tables_on_the_way_are_removed(spark):
    from barwright.llm import common

    t = common.cut(spark.range(1000), "test", rows=1000, per_file=100)
    at = t._cut_path.removeprefix("file:")
    assert t.count() == 1000 and os.path.isdir(at)
    common.discard(t, None, spark.range(3))
    assert not os.path.exists(at)


def test_exact_hard_rows(spark, hard, none):
    index = exact.DigestIndex(spark)
    got = exact.annotate(hard, index)
    assert got.count() == hard.count()
    kept = exact.dedup(hard, exact.DigestIndex(spark))
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 9 in ids and 8 not in ids and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert exact.annotate(none, exact.DigestIndex(spark)).count() == 0


# ---- queries and pipeline ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_like_duckdb(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(queries.ORACLES[name])
    assert sorted(want.columns) == cols
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(want.project(", ".join(cols)).fetchall())


def test_pipeline_against_plain_stages(spark, model, rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "mixture"]
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    left = [(d, t) for (d, t, _), x in zip(rows, model.predict([t for _, t, _ in rows]), strict=True) if x.lang != "und" and x.known >= langid.LEAST_KNOWN]
    left = [(d, t) for d, t in left if brute.exact(left)[d][0] == d]
    near = brute.near_components(left, 5, 80, 100)
    left = [(d, t) for d, t in left if near[d][1] == d]
    bench = duckdb.connect().sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    index = decontam.Index(bench, decontam.SEED)
    assert got == {d for d, t in left if index.best(t, decontam.COVERAGE)[0] < decontam.COVERAGE}


def test_stages_return_the_columns_of_documents(spark, hard):
    import corpus_pipeline

    extra = hard.withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, SF).columns == extra.columns


def test_shared_folder_is_the_cluster_s(spark):
    from barwright.llm import common

    assert os.path.isdir(common.shared_dir(spark).removeprefix("file:"))
