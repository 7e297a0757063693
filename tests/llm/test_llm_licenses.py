import math
import re
from collections import Counter

from vigil.llm import licenses

SCHEMA = "doc_id long, path string, text string, license string, line int, dir string, hash long"
APACHE, MIT = licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["MIT"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "l", 1, "d", 2) for r in rows], SCHEMA).repartition(3)


def files():
    prose = "the work of others is under review\nby many people in a small town\n" * 20
    return [
        (1, "a/LICENSE", APACHE), (2, "a/x.txt", prose), (3, "a/b/y.txt", prose), (4, "a/b/c/z.txt", f"{prose}{MIT}\n{prose}"),
        (5, "a/b/c/d/deep.txt", ""), (6, "a/b/c/COPYING", f"# {MIT.upper()}"), (7, "q/none.txt", prose), (8, "top.txt", prose), (9, None, prose),
        (10, "q/null.txt", None), (11, "a/tie/one", MIT), (12, "a/tie/two", APACHE), (13, "a/tie/three", "nothing here"), (13, "a/tie/three", "nothing here"),
        (None, "a/noid", "x"), (14, "q/almost.txt", "Licensed plates under the sun"), (15, None, MIT), (16, "long/l.txt", prose * 60 + APACHE),
        (17, "a/x.txt", prose),
    ]


def brute(rows):
    tok = lambda s: re.findall("[a-z0-9]+", s.lower())
    lines = [set(tok(x)) for _, _, t in rows for x in (t or "").split("\n") if tok(x)]
    vocabulary = {x for t in licenses.TEMPLATES.values() for x in tok(t)}
    idf = lambda t: math.log((1 + len(lines)) / (1 + (sum(t in x for x in lines) if t in vocabulary else 0))) + 1
    known = {t: idf(t) for t in vocabulary}
    other = idf("\0")

    def vector(s):
        return {t: n * known.get(t, other) for t, n in Counter(tok(s)).items()}

    def best(s, least):
        v, out = vector(s), []
        norm = math.sqrt(sum(x * x for x in v.values()))
        for name, text in licenses.TEMPLATES.items():
            w = vector(text)
            dot = sum(v.get(t, 0) * x for t, x in w.items())
            if dot:
                c = round(dot / norm / math.sqrt(sum(x * x for x in w.values())), 6)
                if c >= least:
                    out.append((-c, name))
        return min(out, default=None)

    own, given = [], {}
    for _, path, text in rows:
        whole = best(text or "", licenses.FILE)
        heads = [b for x in (text or "").split("\n") if (b := best(x, licenses.HEADER))]
        own.append((whole, min(heads, default=None)))
        if whole and path is not None:
            d = path.rpartition("/")[0]
            given[d] = min(whole, given.get(d, whole))
    out = []
    for (i, path, _), (whole, head) in zip(rows, own, strict=True):
        if whole or head:
            s, name = whole or head
            out.append((i, path, name, "file" if whole else "header", -s, path))
            continue
        up = path.rpartition("/")[0] if path is not None else None
        while up is not None and up not in given:
            up = up.rpartition("/")[0] if up else None
        if up is None:
            out.append((i, path, None, "none", 0.0, None))
        else:
            out.append((i, path, given[up][1], "inherited", -given[up][0], up))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    df = licenses.scan(frame(spark, files()))
    assert sorted(map(tuple, df.collect()), key=repr) == brute(files())


def test_expected_licences(spark):
    got = {(r["doc_id"], r["path"]): (r["license"], r["origin"]) for r in licenses.scan(frame(spark, files())).collect()}
    assert got[1, "a/LICENSE"] == ("Apache-2.0", "file") and got[3, "a/b/y.txt"] == ("Apache-2.0", "inherited")
    assert got[4, "a/b/c/z.txt"] == ("MIT", "header") and got[5, "a/b/c/d/deep.txt"] == ("MIT", "inherited")
    assert got[8, "top.txt"] == (None, "none") and got[16, "long/l.txt"] == ("Apache-2.0", "header")


def test_empty_table(spark):
    assert licenses.scan(frame(spark, [])).count() == 0


def test_needed_terms_lose_no_segment():
    weight = {t: 1.0 + (hash_ % 7) for hash_, t in enumerate(sorted({x for s in licenses.TEMPLATES.values() for x in licenses._counted(s)}))}
    must = set(licenses.needed(licenses.TEMPLATES, weight, 0.5))
    for text in licenses.TEMPLATES.values():
        v = {t: n * weight[t] for t, n in licenses._counted(text).items()}
        rest = sum(x * x for t, x in v.items() if t not in must)
        assert rest < 0.25 * sum(x * x for x in v.values())


GPL3 = """/* tool.c
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
"""
APACHE_HEADER = """# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
"""


def test_full_texts_headers_and_spdx_lines(spark):
    code = "def run(x):\n    return [y for y in x if y]\n\n\nclass Town:\n    people = 3\n" * 30
    short = {n: "Copyright (c) 2019 Some Body\n\n" + licenses.TEXTS[n] for n in licenses.SHORT}
    rows = [(k, f"full/{n}/LICENSE", short.get(n, x)) for k, (n, x) in enumerate(licenses.TEXTS.items())]
    rows += [(100 + k, f"full/{n}/src/a.py", code) for k, n in enumerate(licenses.TEXTS)]
    rows += [
        (200, "h/tool.c", GPL3 + code), (201, "h/a.py", APACHE_HEADER + code), (202, "h/b.py", " ".join(APACHE_HEADER.split()) + "\n" + code),
        (203, "h/c.py", "".join(f"# {x}\n" for x in short["MIT"].split("\n")) + code), (204, "h/d.py", code), (205, "h/d.py", None),
        (210, "s/a.py", "# SPDX-License-Identifier: MIT\n" + code), (211, "s/b.c", "/* SPDX-License-Identifier: GPL-2.0+ */\n" + code),
        (212, "s/c.rs", code + "// spdx-license-identifier: MIT OR  Apache-2.0"), (213, "s/d.py", "# SPDX-License-Identifier: Zlib\n"),
        (204, "h/d.py", code), (200, "h/tool.c", GPL3 + code),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.scan(frame(spark, rows)).collect()}
    for k, n in enumerate(licenses.TEXTS):
        assert (got[k], got[100 + k]) == ((n, "file"), (n, "inherited"))
    assert {k: got[k] for k in range(200, 206)} == {
        200: ("GPL-3.0-or-later", "header"), 201: ("Apache-2.0", "header"), 202: ("Apache-2.0", "header"), 203: ("MIT", "header"),
        204: (None, "none"), 205: (None, "none"),
    }
    assert [got[k] for k in range(210, 214)] == [("MIT", "header"), ("GPL-2.0-or-later", "header"), ("MIT OR Apache-2.0", "header"), ("Zlib", "header")]
