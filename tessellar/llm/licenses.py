"""License scans: sparse TF-IDF cosine to templates, then inheritance by path.

Every line of a file is compared with licence templates by TF-IDF cosine; a
licence file (by its name) is compared as a whole, too.  Beside that, notices, phrases
of standard headers and titles of full licence texts are sought as windows of
running words, whatever stands around them and however lines are wrapped.
A file's own licence is that of its best line or window.  Files without one take that of the licence file in
the nearest ancestor directory, found by an equality join on directory paths.
Everything is DataFrame operations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Notices by which files name their licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "All-Rights-Reserved": ("All rights reserved.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": ("SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "EPL-2.0": ("This program is made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"),
    "ISC": ("Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-only"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}


def _gnu(name: str, version: str, dated: str) -> tuple[str, ...]:
    """The ways in which headers and licence texts name a GNU licence and its version."""
    by = "as published by the Free Software Foundation"
    return (f"under the {name}, version {version}", f"{name} Version {version}, {dated}", f"{name} {by}, either version {version}", f"{name} {by}, version {version}", f"{name} version {version} {by}", f"{name} {by}; either version {version}", f"{name} {by}; version {version}")


#: Phrases of standard headers, and openings of full licence texts, beside the notices.
PHRASES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (*_gnu("GNU Affero General Public License", "3", "19 November 2007"), "SPDX-License-Identifier: AGPL-3.0"),
    "Apache-2.0": ("under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "governed by a BSD-style license"),
    "CC-BY-4.0": ("under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "EPL-2.0": ("Eclipse Public License v 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0": (*_gnu("GNU General Public License", "2", "June 1991"), "GNU GPL, version 2", "GNU GPL version 2", "GNU GPL v2", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": (*_gnu("GNU General Public License", "3", "29 June 2007"), "GNU GPL, version 3", "GNU GPL v3", "SPDX-License-Identifier: GPL-3.0"),
    "ISC": ("under the ISC License",),
    "LGPL-2.1": (*_gnu("GNU Lesser General Public License", "2.1", "February 1999"), "SPDX-License-Identifier: LGPL-2.1"),
    "LGPL-3.0": (*_gnu("GNU Lesser General Public License", "3", "29 June 2007"), "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("under the MIT License",),
    "MPL-2.0": ("terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    "Unlicense": ("free and unencumbered software released into the public domain",),
}
RIGHTS = "All-Rights-Reserved"
#: Of which every window holds one, so that most texts are looked through a few times only.
MARKS = (" license", " licensed ", " gpl", " rights reserved ", " redistribution ", " permission ", " under cc ", " cc0 ", " public domain ", " copyright and related ")
#: Copies of the small side of a join on directories, among which a directory's files are dealt.
SALT = 32
LEAST = 0.75
#: Short words of any text.
PLAIN = frozenset("a all and any by for in is of or the this to with".split())
WORD = "[A-Za-z0-9]+"
LICENSE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([._-].*)?$"


def template_rows(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[list[tuple[str, str]], dict[str, float], float, list[dict[str, float]]]:
    """(licence, notice) rows, idf of each term, that of unknown terms, and unit vectors."""
    rows = [(k, t) for k, v in sorted(templates.items()) for t in v]
    counts = [Counter(w.lower() for w in re.findall(WORD, t)) for _, t in rows]
    df = Counter(w for c in counts for w in c)
    n = len(rows)
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in sorted(df.items())}
    vectors = []
    for c in counts:
        v = {w: k * idf[w] for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    return rows, idf, math.log(1 + n) + 1, vectors


def anchors(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Terms of which a line must hold one to come to a cosine of `least` with
    any template: a template's other terms together weigh less than that.
    Of the terms that would do, long words come first: short ones ("the", "of")
    stand in lines of any kind."""
    out: set[str] = set()
    for v in vectors:
        left = 1.0
        for w, x in sorted(v.items(), key=lambda p: (len(p[0]) < 5, p[0] in PLAIN or p[0].isdigit(), -p[1], p[0])):
            if left < least * least * (1 - 1e-9):
                break
            out.add(w)
            left -= x * x
    return sorted(out)


def _words(text: Column) -> Column:
    """The running words of a text in lower case, an array."""
    return F.array_remove(F.transform(F.split(text, f"[^{WORD[1:-2]}]+"), F.lower), "")


def _could_reach(words: Column, least: float) -> Column:
    """Whether a line of these words may come to `least` with any template, by
    a bound that one pass over them gives.

    The dot product is a sum over words, so it is at most that of each word's
    largest weight.  Squares of counts are at least the counts, and the known
    terms' part of the norm at least their sum over the root of their number.
    Weights are looked up for known words alone; the others are counted.
    """
    _, idf, unknown, vectors = template_rows()
    facts = F.create_map(*[F.lit(y) for w, x in idf.items() for y in (w, x)])
    reach = F.create_map(*[F.lit(y) for w, x in idf.items() for y in (w, x * max(v.get(w, 0.0) for v in vectors))])

    def add(a: Column, word: Column) -> Column:
        weight = F.element_at(facts, word)
        return F.struct((a["dot"] + F.element_at(reach, word)).alias("dot"), (a["sum"] + weight).alias("sum"), (a["known"] + weight * weight).alias("known"), (a["n"] + F.lit(1)).alias("n"))

    def done(a: Column) -> Column:
        other = (F.size(words) - a["n"]) * F.lit(unknown * unknown)
        norm2 = F.greatest(a["known"], a["sum"] * a["sum"] / F.lit(float(len(idf)))) + other
        return a["dot"] >= F.lit(least - 1e-6) * F.sqrt(norm2)

    none = F.struct(*[F.lit(0.0).alias(n) for n in ("dot", "sum", "known")], F.lit(0).alias("n"))
    return F.aggregate(F.filter(words, lambda w: w.isin(*idf)), none, add, done)


def _cosines(lines: DataFrame, key: list[str], least: float) -> DataFrame:
    """key, license, score: the best template of each line that reaches `least`."""
    rows, idf, unknown, vectors = template_rows()
    spark = lines.sparkSession
    names = [f"w{k}" for k in range(len(rows))]
    table = spark.createDataFrame([(w, x, *[float(v.get(w, 0.0)) for v in vectors]) for w, x in idf.items()], "term string, idf double, " + ", ".join(f"{n} double" for n in names))
    found = _words(F.col("line"))
    some = lines.filter(F.arrays_overlap(found, F.array(*map(F.lit, anchors(vectors, least)))))
    # lines that cannot reach it go before their words are shuffled
    words = some.filter(_could_reach(found, least)).select(*key, F.explode(found).alias("term"))
    counted = words.groupBy(*key, "term").count()
    weighed = counted.join(F.broadcast(table), "term", "left").withColumn("x", F.col("count") * F.coalesce("idf", F.lit(unknown)))  # a few hundred rows
    dots = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *[F.sum(F.col("x") * F.coalesce(n, F.lit(0.0))).alias(n) for n in names])
    scored = F.array(*[F.struct(F.round(F.col(n) / F.col("norm"), 9).alias("score"), F.lit(-k).alias("first"), F.lit(rows[k][0]).alias("license")) for k, n in enumerate(names)])
    return dots.select(*key, F.array_max(scored).alias("best")).select(*key, "best.license", "best.score").filter(F.col("score") >= least)


def window(phrase: str) -> str:
    """The phrase as running words between single spaces."""
    return " " + " ".join(w.lower() for w in re.findall(WORD, phrase)) + " "


def _windows(rows: DataFrame) -> DataFrame:
    """path, license, score: licences of which a text holds a notice or phrase
    word for word, with any signs between the words.  A reservation of rights
    beside a licence says nothing."""
    # lower case comes second: it would make letters of other signs
    plain = F.concat(F.lit(" "), F.lower(F.regexp_replace("text", f"[^{WORD[1:-2]}]+", " ")), F.lit(" "))
    some = rows.select("path", plain.alias("plain")).filter(F.array_contains(F.transform(F.array("plain"), _marked), True))
    hit = {k: reduce(or_, [F.col("plain").contains(w) for w in sorted({window(p) for p in (*TEMPLATES.get(k, ()), *PHRASES.get(k, ()))})]) for k in sorted({*TEMPLATES, *PHRASES})}
    named = some.withColumn("found", F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in hit.items() if k != RIGHTS])))
    found = F.when(F.size("found") > 0, F.col("found")).when(hit[RIGHTS], F.array(F.lit(RIGHTS)))
    return named.select("path", F.explode(found).alias("license"), F.lit(1.0).alias("score"))


def _marked(plain: Column) -> Column:
    return reduce(or_, [plain.contains(m) for m in MARKS])


def _directory(path: Column) -> Column:
    """The path's directory, "" at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def scan(files: DataFrame, *, path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """path, license, score, how and from_path of each distinct path.

    how: "own" (a line or, for a licence file, the whole text reaches `least`,
    or a window of running words is a notice or phrase, score 1; the best score, ties to the licence's later name; rights reserved only
    where nothing else is found), "inherited" (of the
    licence file in the nearest ancestor directory, the file's own included;
    of several there the best score, then the smallest path; the score is that
    file's) or "none" (null license, score 0).  A null or empty text has no
    licence of its own; whole texts are read; rows of one path are one file,
    whose lines are those of all its rows; rows without a path are left out;
    other columns aren't read; an empty table gives an empty table.
    """
    rows = files.select(F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text")).filter("path is not null")
    lines = rows.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    by_line = _cosines(lines, ["path", "line_no"], least).select("path", "license", "score")
    is_license = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE)
    by_file = _cosines(rows.filter(is_license).select("path", F.lit(-1).alias("line_no"), F.col("text").alias("line")), ["path", "line_no"], least).select("path", "license", "score")
    own = by_line.unionByName(by_file).unionByName(_windows(rows))
    own = own.groupBy("path").agg(F.max(F.struct(F.col("license") != RIGHTS, "score", "license")).alias("best")).select("path", "best.license", "best.score")
    paths = rows.select("path").distinct().withColumn("dir", _directory(F.col("path")))
    paths = cut(paths.join(own, "path", "left"))  # read three times below
    # one row a directory: its licence file, if any
    given = paths.filter(F.col("license").isNotNull() & is_license).groupBy("dir").agg(F.min_by(F.struct("license", "score", "path"), F.struct(-F.col("score"), F.col("path"))).alias("by"))
    dirs = paths.filter("license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    above = dirs.select("dir", F.explode(up).alias("a")).select("dir", "a.depth", "a.above").filter((F.col("depth") > 0) | (F.col("above") == ""))
    nearest = above.join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("by", "depth").alias("by"))
    # a directory may hold a third of all files: they are dealt among copies of its one row
    salt = F.pmod(F.hash("path"), F.lit(SALT))
    nearest = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = paths.withColumn("_salt", salt).join(nearest, ["dir", "_salt"], "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "path",
        F.when(mine, F.col("license")).otherwise(F.col("by.license")).alias("license"),
        F.coalesce("score", "by.score", F.lit(0.0)).alias("score"),
        F.when(mine, "own").when(F.col("by").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(mine, F.col("path")).otherwise(F.col("by.path")).alias("from_path"),
    )
