import random
import re

import pytest
from pyspark.sql import functions as F

from stopclock.llm.fingerprints import fingerprints
from stopclock.llm.licenses import TEMPLATES, scan_licenses, statements
from stopclock.llm.lines import remove_repeated_lines
from stopclock.llm.pages import extract_main_text, main_text
from stopclock.llm.phrases import contamination, search

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def brute_contamination(docs, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                owners = windows.get(tuple(w[a : a + k]))
                if owners:
                    hit.update(range(a, a + k))
                    found |= owners
        out[d] = (len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "a"] + [f"w{i}é" for i in range(25)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 13, 14, 30])))) for k in range(25)] + [(99, None), (7, "a of the"), (None, "zz yy xx")]
    docs = [(-1, None), (-2, ""), (-3, "..! ?"), (-4, "zz yy xx")]
    for d in range(90):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            piece = (rng.choice(items)[1] or "").upper().split()
            at = rng.randint(0, len(w))
            w[at:at] = piece[rng.randint(0, 2) :]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    frame = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id long, text string, term int").repartition(4)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(frame, tests).collect()}
    assert got == brute_contamination(docs, items, 13)


def test_proximity_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "delta gamma beta alpha"), (3, "alpha q q q q q q q beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    assert search(docs, items)[0].count() == 0
    near = {r.doc_id for r in search(docs, items, slack=1)[0].collect()}
    assert near == {1}
    assert 2 in {r.doc_id for r in search(docs, items, slack=3)[0].collect()}
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(docs, none).collect()] == [0, 0, 0]
    assert contamination(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0


def brute_lines(rows, n):
    bare = {d: [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")] for d, t in rows}
    first = {}
    key = lambda ls, i: tuple(x.strip(" \t\r\x0b\x0c") for x in ls[i : i + n])
    for d in sorted(bare):
        for i in range(len(bare[d]) - n + 1):
            first.setdefault(key(bare[d], i), (d, i))
    out = {}
    for d, t in rows:
        gone = set()
        for i in range(len(bare[d]) - n + 1):
            if first[key(bare[d], i)] != (d, i):
                gone.update(range(i, i + n))
        out[d] = (len(bare[d]), len(gone), "\n".join(x for i, x in enumerate(bare[d]) if i not in gone) if gone else t)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(12)] + ["", "  "]
    rows = [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "one\ntwo")] + [(d, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(1, 12)))) for d in range(80)]
    rows += [(200, "\n".join(["same"] * 9)), (201, "\n".join(["same"] * 4))]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, lines int, start int")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in remove_repeated_lines(frame).collect()}
    assert got == brute_lines(rows, 3)
    assert remove_repeated_lines(frame.limit(0)).count() == 0
    assert remove_repeated_lines(spark.createDataFrame([(None, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string")).where("n_removed > 0").count() == 0


def test_fingerprints_equal_sets_of_paragraphs(spark):
    rng = random.Random(9)
    rows = [(5, None), (7000, ""), (-9, "é" * 200)] + [(d * 37, "\n".join("".join(rng.choice("abcé🙂 ") for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 6)))) for d in range(1, 70)]
    frame = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, cell int")
    got = {r.doc_id: r for r in fingerprints(frame).collect()}
    cut = re.compile("[^\n]{1,64}")
    near = lambda a, b: 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))
    order = sorted((d, t or "") for d, t in rows)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, new, other = (set(cut.findall(x)) for x in (t, edited, after))
        assert (got[d].n_chars, got[d].edited) == (len(t), edited)
        assert got[d].near_edited == pytest.approx(near(own, new)) and got[d].near_next == pytest.approx(near(own, other))
    by_text = {}
    for d, t in order:
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    assert fingerprints(frame.limit(0)).count() == 0
    alone = fingerprints(spark.createDataFrame([(3, "abcdefgh"), (None, "x")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited, r.near_next) for r in alone] == [(3, "abcdefab", 1.0)]


def test_small_sketches_are_retried(spark, monkeypatch):
    from stopclock.llm import fingerprints as module

    monkeypatch.setattr(module, "PER_DIGEST", 0)
    monkeypatch.setattr(module, "LEAST", 2)
    rows = [(d, "\n".join(f"line {d} {i}" for i in range(8))) for d in range(6)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.near_next == 0 and 0.7 < r.near_edited < 0.8 for r in got)


PAGE = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>home</a><li><a href=/x>x</a></ul></nav><div class="ad">Buy now, a long advert text here.</div>%s
<aside>More</aside><div id=comments><p>First! I like this article very much indeed.</p></div><form>Name <input></form><footer>&copy; x</footer>"""


@pytest.mark.parametrize("body", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "%s"])
def test_main_text(body):
    content = "<h2>Ti&amp;tle</h2><p>A long   first\nparagraph of the text, with <b>bo</b>ld words.<br>And more of it.<p>Short.</p><ul><li>One item of a list in the text</li></ul>"
    want = "Ti&tle A long first paragraph of the text, with bold words.And more of it. Short. One item of a list in the text"
    assert main_text(PAGE % (body % content)) == want


def test_pages_of_any_shape(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain words"), (3, "u", "plain words"), (None, None, "<p>a<p>b"), (4, "u", "<nav>only"), (5, "u", "<article><p>" + "word " * 30000)]
    got = extract_main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted([("1", ""), ("2", ""), ("3", "plain words"), ("3", "plain words"), ("None", "a b"), ("4", ""), ("5", ("word " * 30000).strip())])
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licenses_wrapped_over_lines_and_many_in_a_block(spark):
    short = [w.split("|")[0] for n, w in TEMPLATES.items() if not n.endswith(("-text", "-header"))]
    line = ". ".join(short)
    mit = "Copyright 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software"
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL\nAll rights\nreserved"
    gpl = "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n"
    twice = "Released under\nthe MIT License.\n" * 2 + "All rights reserved. This work is licensed under the GNU General Public License, version 2, or the Apache License, Version 2.0"
    texts = [line, mit, bsd, "filler words " * 300 + mpl, gpl * 9, twice]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("reduction > 0")
    found = sorted((r.doc_id, r.line, r.license) for r in got.collect())
    assert [x[2] for x in found if x[0] == 0] == sorted(n for n in TEMPLATES if not n.endswith(("-text", "-header")))
    assert [x for x in found if x[0] in (1, 2, 3, 5)] == [
        (1, 2, "MIT-grant"), (2, 1, "BSD"), (3, 0, "MPL-2.0"), (3, 2, "All-rights-reserved"),
        (5, 0, "MIT"), (5, 2, "MIT"), (5, 4, "All-rights-reserved"), (5, 4, "GPL-2.0"),
    ]
    assert [x[1:] for x in found if x[0] == 4] == [(3 * k, "GPL-3.0-header") for k in range(9)]


def test_licenses(spark):
    assert [x[0] for x in statements("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert [x[0] for x in statements("Licensed under CC BY 4.0")] == ["CC-BY-4.0"]
    assert statements("the driver license is under review") == [] == statements("")
    found = statements("it is LICENSED under the Apache Licence, Version 2.0, so")
    assert [(x[0], x[2], x[3]) for x in found] == [("Apache-2.0", ["license"], ["licence"])]
    filler = "filler words " * 60
    rows = [(1, "x\nReleased under the MIT License.\ny"), (1, "x\nReleased under the MIT License.\ny"), (2, filler + "This work is licensed under the GNU General Public License, version 3." + filler), (3, None), (4, ""), (None, "Released under the MIT License.")]
    got = scan_licenses(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, line int"))
    assert sorted((str(r.doc_id), r.line, r.license) for r in got.collect()) == [("1", 1, "MIT"), ("2", 0, "GPL-3.0"), ("None", 0, "MIT")]
    assert got.where(F.col("reduction") <= 0).count() == 0
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


