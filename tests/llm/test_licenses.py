"""License scans: lines, weights and inheritance against plain code."""

import math
import re
from collections import Counter

from siftline.llm.licenses import FULL_TEXTS, HEADERS, TEMPLATES, TERM, scan_licenses


def brute(files, threshold=0.6):
    cut = lambda text: re.findall(TERM, text.lower())
    vectors = {n: Counter(cut(t)) for n, t in TEMPLATES.items()}
    n = len(files)
    df = Counter(t for _, text in files for t in set(cut(text or "")))
    known = set().union(*vectors.values())
    weight = lambda t: math.log((1 + n) / (1 + (df[t] if t in known else 0))) + 1
    def norm(v):
        return math.sqrt(sum((c * weight(t)) ** 2 if t in known else c * weight(t) ** 2 for t, c in v.items()))
    own = []
    for path, text in files:
        best = (0, None)
        for line in (text or "").split("\n"):
            v = Counter(cut(line))
            scores = [(round(sum(v[t] * c * weight(t) ** 2 for t, c in vectors[name].items()) / norm(v) / norm(vectors[name]), 6), name) for name in sorted(vectors)] if v else []
            if scores:
                top = max(s for s, _ in scores)
                best = max(best, next((s, name) for s, name in scores if s == top), key=lambda b: (b[0], b[1] or ""))
        own.append(best[::-1] if best[0] >= threshold else (None, None))
    out = []
    for (path, _), (name, score) in zip(files, own):
        found, origin = name, path if name else None
        folder = path
        while found is None and folder is not None and folder != "":
            folder = folder.rpartition("/")[0]
            inside = [(-s, l) for (p, _), (l, s) in zip(files, own) if p and l and p.rpartition("/")[0] == folder and re.match(r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$", p.rpartition("/")[2])]
            if inside:
                found, origin = min(inside)[1], folder
        out.append((path, name, score, found, origin))
    return sorted(out, key=repr)


def test_scan_equals_plain_code(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/x.py", "prose prose\nmore of it"),
        ("a/b/c/deep.py", None),
        ("a/b/NOTICE.txt", "words\n  licensed under the apache license, VERSION 2.0 !\nwords"),
        ("a/b/d.py", "the MIT license is mentioned in a rather long sentence of other words here"),
        ("ab/none.py", ""),
        ("LICENSE", "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."),
        ("root.py", "x"),
        ("c/COPYING", "Licensed under CC BY-NC 4.0."),
        ("c/COPYING", "Released under the MIT License."),
        ("c/d/e/f/g.py", "Licensed under CC BY-SA 4.0."),
        ("c/d/e/f/h.py", "of the and under this\n" * 3000),
        ("c/my LICENSE", "Released under the ISC License."),
        (None, "Released under the MIT License."),
        (None, "nothing"),
        ("d//odd.py", "É İstanbul"),
    ]
    frame = spark.createDataFrame([(p, t, "x", 2.0) for p, t in files], "path string, text string, license string, best double")
    got = scan_licenses(frame)
    rows = sorted(((r.path, r.own_license, r.own_score, r.license, r.license_from) for r in got.collect()), key=repr)
    assert rows == brute(files)
    assert {r[1] for r in rows} >= {"MIT", "Apache-2.0", "CC-BY-NC-4.0"}


def test_no_files(spark):
    assert scan_licenses(spark.createDataFrame([], "path string, text string")).collect() == []


def test_a_header_scores_alike_at_every_size(spark):
    header = "Copyright 2021 Example Authors. Licensed under the Apache License, Version 2.0."
    files = [(f"d{i}/x.py", f"Copyright 2021 Example Authors\nline {i % 5}") for i in range(12)] + [("h/x.py", header), ("p/x.py", "prose")]
    def score(times):
        rows = [(f"{k}/{p}", t) for k in range(times) for p, t in files]
        found = scan_licenses(spark.createDataFrame(rows, "path string, text string"), threshold=0.5)
        return {(r.own_license, r.own_score) for r in found.where("path LIKE '%/h/x.py'").collect()}
    (small,), (large,) = score(1), score(200)
    assert small[0] == large[0] == "Apache-2.0" and abs(small[1] - large[1]) < 0.03


def test_every_term_is_weighed_by_its_own_frequency(spark):
    files = [("a.py", "our Released under the MIT License"), ("b.py", "our prose"), ("c.py", "our x"), ("d.py", None)]
    n, df = len(files), {"our": 3, **dict.fromkeys("released under the mit license".split(), 1)}
    weight = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    square = sum(weight[t] ** 2 for t in weight if t != "our")
    got = scan_licenses(spark.createDataFrame(files, "path string, text string")).where("path = 'a.py'").first()
    assert got.own_license == "MIT" and got.own_score == round(math.sqrt(square / (square + weight["our"] ** 2)), 6)


def test_headers_and_licence_files_are_compared_as_a_whole(spark):
    other = {"MIT": "Copyright (c) 2020 Jane Doe and others\n", "GPL-3.0": "", "GPL-2.0": "", "ISC": "(c) me\n"}
    files = [(f"{n}/LICENSE", other.get(n, "") + text) for n, text in FULL_TEXTS.items()]
    files += [(f"h/{n}.c", "/* -*- C -*- */\n/*\n * Copyright 2021 Someone\n * " + t.replace(". ", ".\n * ") + "\n */\nint x;\n") for n, t in HEADERS.items()]
    files += [(f"s/{n}.py", f"#!/usr/bin/python\n# SPDX-License-Identifier: {n}\nx = 1") for n in ("MIT", "GPL-2.0-or-later", "Zlib")]
    files += [(f"{n}/src/a.c", "int x;") for n in FULL_TEXTS]
    files += [("p/LICENSE", "the and of this is a story of the sea and of the people in it\n" * 50), ("p/x.c", "prose " * 30)]
    files += [(f"w/{i}.txt", f"some words of the {i}th text, and this is all") for i in range(40)]
    got = {r.path: r.license for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    for n in FULL_TEXTS:
        assert got[f"{n}/LICENSE"] == got[f"{n}/src/a.c"] == n
    for n in HEADERS:
        assert got[f"h/{n}.c"] == n
    assert (got["s/MIT.py"], got["s/GPL-2.0-or-later.py"], got["s/Zlib.py"]) == ("MIT", "GPL-2.0", None)
    assert got["p/LICENSE"] is None and got["p/x.c"] is None
