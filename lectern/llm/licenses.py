"""Licence scans: TF-IDF cosine of lines and licence files to templates, then inheritance from the nearest directory.

Native: DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise

_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_REST = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
    "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _fsf(kind: str, version: str, what: str = "This program") -> str:
    return f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Notices by which common licences are declared, and the whole text of short licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved"),
    ("MIT", "MIT License"),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_REST),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_REST),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", _BSD2 + _DISCLAIMER),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _DISCLAIMER),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-3.0", _fsf("General Public License", "3")),
    ("GPL-2.0", _fsf("General Public License", "2")),
    ("LGPL-3.0", _fsf("Lesser General Public License", "3", "This library")),
    ("LGPL-2.1", _fsf("Lesser General Public License", "2.1", "This library")),
    ("AGPL-3.0", _fsf("Affero General Public License", "3")),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # titles without a version come last: of equal scores the first counts
    ("GPL", "GNU GENERAL PUBLIC LICENSE"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("AGPL", "GNU AFFERO GENERAL PUBLIC LICENSE"),
]
#: Most consecutive lines with words that are compared as one unit.
BLOCK_LINES = 12
#: Names of files that declare the licence of their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[^/]*)?$"
THRESHOLD = 0.75
_BREAK = r"[^a-z0-9]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tally(ordered: Column) -> Column:
    """(term, tf) of each distinct term of a sorted array: a term's run ends where the next begins."""
    places = F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i))
    starts = F.filter(places, lambda i: i.isNotNull())
    return _let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("tf"))))


def terms(text: str) -> list[str]:
    return [t for t in re.split(_BREAK, text.lower()) if t]


def document_counts(texts: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and how many hold each term of the vocabulary; over all rows."""
    held = F.array_intersect(F.split(F.lower("text"), _BREAK), F.array(*[F.lit(t) for t in vocabulary]))
    counts = texts.select(F.explode(F.array_append(held, F.lit(""))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()  # a row a term
    found = {r["t"]: r["n"] for r in counts}
    return found.pop("", 0), found


def weights(total: int, counts: dict[str, int], threshold: float = THRESHOLD) -> tuple[dict[str, float], float, list[dict[str, float]], set[str]]:
    """idf of known terms, idf of others, each template's unit vector, and the terms without which no cosine reaches the threshold."""
    idf = lambda n: math.log((total + 1) / (n + 1)) + 1
    known = {t: idf(counts.get(t, 0)) for _, text in TEMPLATES for t in terms(text)}
    vectors, needed = [], set()
    for _, text in TEMPLATES:
        vector = {t: n * known[t] for t, n in Counter(terms(text)).items()}
        length = math.sqrt(sum(w * w for w in vector.values()))
        vectors.append({t: w / length for t, w in vector.items()})
        rest = 1.0
        for t, w in sorted(vectors[-1].items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold**2 * (1 - 1e-9):
                break  # the terms that are left can't reach the threshold by themselves
            needed.add(t)
            rest -= w * w
    return known, idf(0), vectors, needed


def declared(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, name, text) -> path, license, score: the best template of each path whose cosine reaches the threshold.

    Every line, sentence of a line and run of up to BLOCK_LINES lines with
    words is compared, and the whole text of a licence file too.  Terms
    are weighted by how few of all texts hold them.  A unit is counted within
    its row, so what is shuffled is one row of sums for each unit that can
    reach the threshold at all.
    """
    known, unknown, vectors, needed = weights(*document_counts(files, sorted({t for _, text in TEMPLATES for t in terms(text)})), threshold)
    spark = files.sparkSession
    table = spark.createDataFrame([(t, w, [v.get(t, 0.0) for v in vectors]) for t, w in known.items()], "term string, idf double, w array<double>")

    squares = F.create_map(*[F.lit(x) if isinstance(x, str) else x for t in sorted(known) for x in (t, F.array(*[F.lit(v.get(t, 0.0) ** 2) for v in vectors]))])
    some = F.array(*[F.lit(t) for t in sorted(needed)])

    def reach(unit: Column) -> Column:
        """The most that a cosine can be, squared: the part of the template's vector whose terms the unit holds."""
        words = F.array_intersect(F.split(F.lower(unit), _BREAK), F.array(*[F.lit(t) for t in sorted(known)]))
        none = F.array(*[F.lit(0.0)] * len(vectors))
        most = lambda held: F.array_max(F.aggregate(held, none, lambda total, t: F.zip_with(total, F.element_at(squares, t), lambda x, y: x + y)))
        return _let(words, lambda held: F.when(F.arrays_overlap(held, some), most(held)).otherwise(0.0))

    def blocks(text: Column) -> Column:
        """Lines with words, their sentences, and every run of 2 to BLOCK_LINES of them."""
        lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: F.lower(x).rlike("[a-z0-9]"))
        runs = lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(2), F.lit(BLOCK_LINES)), lambda n: F.array_join(F.slice(x, i, n), " "))))
        return _let(lines, lambda x: F.concat(x, F.flatten(F.transform(x, lambda y: F.split(y, r"\.\s+"))), runs(x)))

    whole = F.when(F.col("name").rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    near = threshold**2 - 1e-9
    units = files.filter(reach(F.col("text")) >= near).select("path", F.explode(F.array_distinct(F.concat(blocks(F.col("text")), whole))).alias("unit"))
    units = units.filter(reach(F.col("unit")) >= near)
    tally = _let(F.array_sort(F.filter(F.split(F.lower("unit"), _BREAK), lambda t: t != "")), _tally)
    units = units.select("path", F.xxhash64("unit").alias("u"), F.explode(tally).alias("x")).select("path", "u", "x.term", "x.tf")
    units = units.join(F.broadcast(table), "term", "left")
    w = F.col("tf") * F.coalesce("idf", F.lit(unknown))
    sums = [F.sum(w * F.coalesce(F.get("w", F.lit(k)), F.lit(0.0))).alias(f"d{k}") for k in range(len(TEMPLATES))]
    compared = units.groupBy("path", "u").agg(F.sqrt(F.sum(w * w)).alias("norm"), *sums)
    scores = F.array(*[F.struct(F.round(F.col(f"d{k}") / F.col("norm"), 6).alias("score"), F.lit(-k).alias("k")) for k in range(len(TEMPLATES))])
    best = compared.select("path", F.array_max(scores).alias("b")).groupBy("path").agg(F.max("b").alias("b")).filter(F.col("b.score") >= threshold)
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    return best.select("path", F.get(names, -F.col("b.k")).alias("license"), F.col("b.score").alias("score"))


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, path, license, found, score, distance for every row.

    found is `header` for a licence that the file itself declares, `inherited`
    for that of the nearest directory at or above its own which holds a
    licence file that declares one (distance: how many levels up), or `none`.
    A directory with several takes the one that scores best, then the name
    that sorts first.  Rows that share a path count as one file; null texts
    are empty; a null path has no directory and inherits nothing.
    """
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paths = rows.select("doc_id", "path", _dir(F.col("path")).alias("dir"))
    named = rows.withColumn("name", F.regexp_extract("path", r"[^/]*$", 0)).select("path", "name", "text")
    own = materialise(declared(named.filter("path IS NOT NULL"), threshold), "licences")
    holders = own.filter(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE))
    licensed = holders.groupBy(_dir(F.col("path")).alias("above")).agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("l")).select("above", F.col("l.license").alias("of_dir"))
    # each directory once, then its ancestors: a directory of any size is one row here
    dirs = paths.filter("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("up"))
    above = above.select("dir", "up", F.array_join(F.slice(parts, 1, F.size(parts) - F.col("up")), "/").alias("above"))
    nearest = above.join(licensed, "above").groupBy("dir").agg(F.min(F.struct("up", "of_dir")).alias("n")).select("dir", F.col("n.up").alias("up"), F.col("n.of_dir").alias("of_dir"))
    found = F.when(F.col("license").isNotNull(), "header").when(F.col("of_dir").isNotNull(), "inherited").otherwise("none")
    return paths.join(own, "path", "left").join(nearest, "dir", "left").select(
        "doc_id", "path", F.coalesce("license", "of_dir").alias("license"), found.alias("found"), "score",
        F.when(F.col("license").isNull(), F.col("up")).alias("distance"),
    )


def rendered_paths(docs: DataFrame) -> DataFrame:
    """documents with the path each would have in a tree of three levels: source, then ranges of 2,000 and of 200 ids.

    The first ids of a range name licence files of its directory, so each
    directory has some; every row has a path.
    """
    k, source = F.coalesce("doc_id", F.lit(0)), F.coalesce("source", F.lit("unknown"))
    wide, tight, number = F.floor(k / 2000).cast("string"), F.floor(k / 200).cast("string"), k.cast("string")
    at = lambda n, a, b: (F.pmod(k, F.lit(n)) >= a) & (F.pmod(k, F.lit(n)) < b)
    path = (
        F.when(at(20000, 40, 60), F.concat(source, F.lit("/NOTICE."), number))
        .when(at(2000, 20, 40), F.concat(source, F.lit("/"), wide, F.lit("/COPYING."), number))
        .when(at(200, 0, 20), F.concat(source, F.lit("/"), wide, F.lit("/"), tight, F.lit("/LICENSE."), number))
        .otherwise(F.concat(source, F.lit("/"), wide, F.lit("/"), tight, F.lit("/"), number, F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")
