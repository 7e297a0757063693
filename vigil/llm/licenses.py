"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

*Segments.* Every line of a file is a possible notice, and the whole text a possible licence file. A header
of several lines (``HEADERS``, and the full texts that are also put at the top of source files) is compared
with blocks of consecutive lines: from each line on, as many as hold the header's number of terms, however
wrapped. The full licence texts (``license_texts/``) are compared with whole texts, a term's count being damped
to ``1 + ln(count)``, if the template has ``FILE`` of the text's number of terms at least. A line ``SPDX-License-Identifier: x`` states its licence, with score 1.
Terms are runs of ``[a-z0-9]`` in lower case. A term's weight is its count times
``ln((1 + lines) / (1 + lines with it)) + 1``, with counts over all lines of all files; terms outside the
templates count as met in no line.

*Candidates, without loss.* For each template, its heaviest terms are picked until the rest has less than
``HEADER`` of its norm. By Cauchy-Schwarz a segment without any of these terms has a smaller cosine than
that, so only files with one of them are compared, over all of their text. For headers and full texts it is
also asked, for the same reason, that the file's terms hold that share of the template's norm in all.

*Inheritance.* A file whose best line has a cosine of ``HEADER`` or more has that licence. A file whose whole
text has ``FILE`` or more is a licence file: it covers its directory and those below. Other files take the
licence of the nearest ancestor directory with one, by a join of each directory's ancestor paths (files
meet their directory's result, a plain table, in a join that splits hot directories).

Everything is DataFrame operations. Cosines are rounded to six decimals before they are compared; ties go
to the first licence by name. Defined results: a null or empty text has no licence of its own and can
inherit one; a null path is a file in no directory. Rows that repeat have the same result each. An empty
table gives an empty result. Only ``doc_id, path, text`` are read.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import materialize, same, whole_text

# --- Fixed values: short notices of common licences, by SPDX identifier ---------------------------
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-only": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This source code form is subject to the terms of the Mozilla Public License, version 2.0.",
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}."
_LATER = "either version {0} of the License, or (at your option) any later version"
#: The granting paragraph of each usual header; what follows it (no warranty, addresses) differs.
HEADERS = {
    "AGPL-3.0-only": _GNU.format("Affero General Public License", "version 3 of the License"),
    "AGPL-3.0-or-later": _GNU.format("Affero General Public License", _LATER.format("3")),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with'
        " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-2.0-only": _GNU.format("General Public License", "version 2 of the License"),
    "GPL-2.0-or-later": _GNU.format("General Public License", _LATER.format("2")),
    "GPL-3.0-only": _GNU.format("General Public License", "version 3 of the License"),
    "GPL-3.0-or-later": _GNU.format("General Public License", _LATER.format("3")),
    "LGPL-2.1-only": _GNU.format("Lesser General Public License", "version 2.1 of the License"),
    "LGPL-2.1-or-later": _GNU.format("Lesser General Public License", _LATER.format("2.1")),
    "LGPL-3.0-only": _GNU.format("Lesser General Public License", "version 3 of the License"),
    "LGPL-3.0-or-later": _GNU.format("Lesser General Public License", _LATER.format("3")),
    "MIT": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Full texts that are also used as headers.
SHORT = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT"]
SPDX = r"(?i)\bspdx-license-identifier:[ \t]*(\(?[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?\)?(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?\)*)*)"
#: Older names of the same licences.
RENAMED = {f"{n}-{v}{old}": f"{n}-{v}-{new}" for n, v in (("AGPL", "3.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0")) for old, new in (("", "only"), ("+", "or-later"))}
# --------------------------------------------------------------------------------------------------
HEADER = 0.7
FILE = 0.5


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _counted(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for t in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split():
        found[t] = found.get(t, 0) + 1
    return found


def weights(files: DataFrame, templates: dict[str, str]) -> tuple[dict[str, float], float]:
    """Weight of one use of each template term, and of any other term."""
    vocabulary = sorted({t for x in templates.values() for t in _counted(x)})
    lines = files.select(F.explode(F.split(whole_text(), "\n")).alias("line")).select(terms(F.col("line")).alias("t")).where(F.size("t") > 0)
    # The empty term stands for the line itself.
    met = lines.select(F.explode(F.array_append(F.array_distinct("t"), F.lit(""))).alias("term"))
    known = files.sparkSession.createDataFrame([(t,) for t in ["", *vocabulary]], "v_term string")
    met = met.join(F.broadcast(known), F.col("term") == F.col("v_term"))
    seen = dict(met.groupBy("term").count().collect())  # a row a template term at most
    n = seen.get("", 0)
    weigh = lambda k: math.log((1 + n) / (1 + k)) + 1
    return {t: weigh(seen.get(t, 0)) for t in vocabulary}, weigh(0)


def _squares(text: str, weight: dict[str, float], damped: bool) -> dict[str, float]:
    return {t: ((1 + math.log(n) if damped else n) * weight[t]) ** 2 for t, n in _counted(text).items()}


def needed(templates: dict[str, str], weight: dict[str, float], least: float, damped: bool = False) -> list[str]:
    """Terms of which a segment with a cosine of ``least`` to any template holds one at least."""
    out: set[str] = set()
    for text in templates.values():
        square = sorted((s, t) for t, s in _squares(text, weight, damped).items())
        rest, total = 0.0, sum(s for s, _ in square)
        for s, t in square:
            rest += s
            if rest >= (least - 1e-5) ** 2 * total:
                out.add(t)
    return sorted(out)


def cosines(segments: DataFrame, key: list[str], templates: dict[str, str], weight: dict[str, float], other: float, damped: bool = False) -> DataFrame:
    """``key, license, cosine`` of segments ``key, t`` (terms) and templates that share a term.

    ``damped``: a count n of a term is used as ``1 + ln(n)``.
    """
    spark = segments.sparkSession
    uses = segments.select(*key, F.explode("t").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("n"))
    table = spark.createDataFrame([(t, w) for t, w in weight.items()], "w_term string, w double")
    uses = uses.join(F.broadcast(table), F.col("term") == F.col("w_term"), "left").withColumn("x", (F.log("n") + 1 if damped else F.col("n")) * F.coalesce("w", F.lit(other)))
    parts = []
    for name, text in templates.items():
        square = _squares(text, weight, damped)
        norm = math.sqrt(sum(square.values()))
        parts += [(name, t, math.sqrt(x) / norm) for t, x in square.items()]
    # Of the templates' fixed size; a list of weights a term, so that a use is one row here too.
    by_term: dict[str, list] = {}
    for name, t, y in parts:
        by_term.setdefault(t, []).append((name, y))
    ys = spark.createDataFrame(list(by_term.items()), "y_term string, ys array<struct<license:string,y:double>>")
    uses = materialize(uses.join(F.broadcast(ys), F.col("term") == F.col("y_term"), "left").select(*key, "x", "ys"), "license-uses")
    norms = uses.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = uses.where("ys IS NOT NULL").select(*key, "x", F.explode("ys").alias("s"))
    dots = dots.groupBy(*key, F.col("s.license").alias("license")).agg(F.sum(F.col("x") * F.col("s.y")).alias("dot"))
    a, b = dots.alias("a"), norms.alias("b")
    met = a.join(b, [same(F.col(f"a.{k}"), F.col(f"b.{k}")) for k in key])
    return met.select(*[F.col(f"a.{k}").alias(k) for k in key], "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))


def _held(files: DataFrame, key: list[str], templates: dict[str, str], weight: dict[str, float], least: float, damped: bool) -> DataFrame:
    """Those ``files (key, text)`` whose terms hold ``least`` of the norm of one of the templates, one row a key.

    The scan itself asks for a needed term, then for as many of a template's terms as its heaviest ones take to
    hold the share. Only the terms of files that pass, never texts, are summed exactly; only the texts of files
    that hold the share are shuffled or written.
    """
    shares: dict[str, list] = {}
    enough, t = F.lit(False), F.col("t")
    for name, text in templates.items():
        square = _squares(text, weight, damped)
        whole, held, fewest = sum(square.values()), 0.0, 0
        for x in sorted(square.values(), reverse=True):
            if held < (least - 1e-5) ** 2 * whole - 1e-9:
                held, fewest = held + x, fewest + 1
        enough = enough | (F.size(F.array_intersect(t, _strings(sorted(square)))) >= fewest)
        for term, x in square.items():
            shares.setdefault(term, []).append((name, x / whole))
    table = files.sparkSession.createDataFrame(list(shares.items()), "h_term string, held array<struct<name:string,share:double>>")
    must = _strings(needed(templates, weight, least, damped))
    # One-element generator: the terms are made once a file.
    some = files.select(*key, F.explode(F.array(F.array_distinct(terms(F.col("text"))))).alias("t")).where(F.arrays_overlap(t, must) & enough)
    met = some.select(*key, F.explode("t").alias("term")).join(F.broadcast(table), F.col("term") == F.col("h_term"))
    met = met.select(*key, F.explode("held").alias("h")).groupBy(*key, "h.name").agg(F.sum("h.share").alias("share"))
    # Rows that repeat a key add up to more than one of them has: none is lost, the cosine decides.
    met = materialize(met.where(F.col("share") >= (least - 1e-5) ** 2).select(*key).distinct(), "license-held")
    a, b = files.alias("a"), met.alias("b")
    near = a.join(b, [same(F.col(f"a.{k}"), F.col(f"b.{k}")) for k in key], "left_semi")
    return materialize(near.dropDuplicates(key), "license-near")


def _blocks(files: DataFrame, key: list[str], templates: dict[str, str], must: Column) -> DataFrame:
    """``key, line, size, t``: from each line on, the lines that hold ``size`` terms, for the size of each template."""
    lines = files.select(*key, F.posexplode(F.split("text", "\n")).alias("line", "s")).select(*key, "line", terms(F.col("s")).alias("t")).where(F.size("t") > 0)
    order = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(F.size("t")).over(order), F.lit(0)))
    sizes = sorted({sum(_counted(x).values()) for x in templates.values()})
    over = Window.partitionBy(*key).orderBy("at")
    made = [F.struct(F.lit(n).alias("size"), F.flatten(F.collect_list("t").over(over.rangeBetween(0, n - 1))).alias("t")) for n in sizes]
    return lines.select(*key, "line", F.array(*made).alias("made")).select(*key, "line", F.explode("made").alias("b")).select(*key, "line", "b.size", "b.t").where(F.arrays_overlap("t", must))


def _spdx(files: DataFrame, key: list[str]) -> DataFrame:
    """``key, line, license, cosine`` of the lines that name an SPDX expression; other names than ours come as written."""
    names = {n.lower(): n for n in [*TEMPLATES, *HEADERS, *TEXTS]} | {n.lower(): m for n, m in RENAMED.items()}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    lines = files.where(F.col("text").rlike(SPDX)).select(*key, F.posexplode(F.split("text", "\n")).alias("line", "s"))
    lines = lines.withColumn("license", F.regexp_replace(F.regexp_extract("s", SPDX, 1), r"[ \t]+", " ")).where("license <> ''")
    return lines.select(*key, "line", F.coalesce(known[F.lower("license")], "license").alias("license"), F.lit(1.0).alias("cosine"))


def _long(files: DataFrame, key: list[str], weight: dict[str, float], other: float) -> DataFrame:
    """``key, line, license, cosine`` of blocks with headers, whole texts (line -1) with full texts, and SPDX lines."""
    heads = HEADERS | {f"{n}#text": TEXTS[n] for n in SHORT}
    near = _held(files, key, heads, weight, HEADER, False)
    blocks = _blocks(near, key, heads, _strings(needed(heads, weight, HEADER)))
    head = cosines(blocks, [*key, "line", "size"], heads, weight, other).drop("size").withColumn("license", F.substring_index("license", "#", 1))
    near = _held(files, key, TEXTS, weight, FILE, True).select(*key, F.lit(-1).alias("line"), terms(F.col("text")).alias("t"))
    whole = cosines(near.withColumn("size", F.size("t")), [*key, "line", "size"], TEXTS, weight, other, True)
    full = F.create_map(*[F.lit(x) for n, t in TEXTS.items() for x in (n, sum(_counted(t).values()))])
    whole = whole.where(full[F.col("license")] >= F.col("size") * FILE).drop("size")
    return head.unionByName(whole).unionByName(_spdx(files, key))


def scan(files: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, path, license, origin, score, licensed_by`` for each row of ``files (doc_id, path, text)``.

    ``origin``: ``header``, ``file`` (a licence file itself), ``inherited`` or ``none``; ``licensed_by``: the
    path, or the directory, that the licence comes from. Given ``templates`` are used alone.
    """
    alone, templates = bool(templates), templates or TEMPLATES
    every = {**templates} if alone else {f"{k}{n}": x for k, d in enumerate((templates, HEADERS, TEXTS)) for n, x in d.items()}
    all_weight, other = weights(files, every)
    weight = {t: all_weight[t] for x in templates.values() for t in _counted(x)}
    must = _strings(needed(templates, weight, min(HEADER, FILE)))
    base = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path"), F.xxhash64("text").alias("hash"), whole_text().alias("text"))
    some = materialize(base.where(F.arrays_overlap(terms(F.col("text")), must)), "license-candidates")
    key = ["doc_id", "path", "hash", "line"]
    lines = some.select("doc_id", "path", "hash", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    lines = lines.select(*key, terms(F.col("s")).alias("t")).where(F.arrays_overlap("t", must))
    whole = some.select("doc_id", "path", "hash", F.lit(-1).alias("line"), terms(F.col("text")).alias("t"))
    found = cosines(lines.unionByName(whole), key, templates, weight, other)
    if not alone:
        found = found.unionByName(_long(base, key[:3], all_weight, other))
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "license"))
    is_file = F.col("line") < 0
    fits = F.when(is_file, F.col("cosine") >= FILE).otherwise(F.col("cosine") >= HEADER)
    own = found.where(fits).groupBy("doc_id", "path", "hash", is_file.alias("is_file")).agg(best.alias("b"))
    per = own.groupBy("doc_id", "path", "hash").agg(
        F.max(F.when(F.col("is_file"), F.col("b"))).alias("as_file"), F.max(F.when(~F.col("is_file"), F.col("b"))).alias("as_header")
    )
    pick = F.coalesce("as_file", "as_header")
    per = per.select(
        F.col("doc_id").alias("o_id"), F.col("path").alias("o_path"), F.col("hash").alias("o_hash"),
        pick["license"].alias("license"), (-pick["minus"]).alias("score"), F.col("as_file").isNotNull().alias("is_file"),
    )
    per = materialize(per, "license-own")
    folder = lambda p: F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    given = per.where("is_file AND o_path IS NOT NULL").groupBy(folder(F.col("o_path")).alias("g_dir")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("g"))
    rows = base.select("doc_id", "path", "hash", folder(F.col("path")).alias("dir"))
    # Ancestors of each directory, itself first; the root is the empty path.
    names = F.split("dir", "/")
    steps = F.explode(F.sequence(F.lit(0), F.size(names))).alias("depth")
    folders = rows.where("path IS NOT NULL").select("dir").distinct().select("dir", steps).withColumn("up", F.array_join(F.slice(names, 1, F.col("depth")), "/")).dropDuplicates(["dir", "up"])
    near = folders.join(given, F.col("up") == F.col("g_dir")).groupBy("dir").agg(F.max(F.struct("depth", "up", "g")).alias("m"))
    near = materialize(near.select(F.col("dir").alias("n_dir"), F.col("m.g.license").alias("n_license"), (-F.col("m.g.minus")).alias("n_score"), F.col("m.up").alias("n_up")), "license-folders")
    rows = materialize(rows, "license-rows")
    out = rows.join(per, same(F.col("doc_id"), F.col("o_id")) & same(F.col("path"), F.col("o_path")) & (F.col("hash") == F.col("o_hash")), "left")
    out = out.join(near, (F.col("dir") == F.col("n_dir")) & F.col("path").isNotNull(), "left")
    mine, theirs = F.col("license").isNotNull(), F.col("n_license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "n_license").alias("license"),
        F.when(mine & F.col("is_file"), "file").when(mine, "header").when(theirs, "inherited").otherwise("none").alias("origin"),
        F.coalesce("score", "n_score", F.lit(0.0)).alias("score"),
        F.when(mine, F.col("path")).when(theirs, F.col("n_up")).alias("licensed_by"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a tenth lies in the folder of their source, a fifth in that of their language,
    the rest in folders of 200 ids below."""
    tens = F.pmod("doc_id", F.lit(10))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    deep = F.concat(F.lit("part"), F.expr("doc_id div 200"))
    path = F.when(tens == 0, F.concat_ws("/", "source", name)).when(tens < 3, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", deep, name))
    return docs.select("doc_id", path.alias("path"), "text")
