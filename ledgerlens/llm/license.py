"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

A file is compared with the template texts of licences as a whole, by its header
(the first HEADER_LINES lines) and by each line, as the cosine of sparse TF-IDF
vectors with weights (1 + ln tf) idf; its own licence is that of the best of these
units with a cosine of at least THRESHOLD. idf = ln((1 + n) / (1 + df)) + 1 over all files, but never more than
that of a term in one of RAREST files, so that a verdict is the same in small and
large corpora. A licence file (by its name, or a file whose whole text reaches
THRESHOLD) declares its licence for its directory; a file without a licence of its
own takes that of the nearest ancestor directory that declares one, found by joins
of directory paths.

Only DataFrame functions are used. A first pass counts the files that hold each
term. By the Cauchy-Schwarz inequality, common terms that make less than
THRESHOLD of every template's length can't bring any unit there by themselves, so
only units that hold one of the other, telling terms are looked at. Likewise the
terms that make less than LIGHT of every template leave THRESHOLD - LIGHT of a
unit's length to its other template terms, and no term weighs under 1, so units
whose telling terms weigh less go before anything is counted. Both bounds
lose none. All that is sent out is bounded by the templates. Joins on directories
have one row for each directory on one side, so that a directory with a third of
all files is a skewed join that AQE splits, and minima are taken before shuffles.

Edge cases: a null or empty text has no terms and can only inherit. A null path
has no directories and keeps only its own licence. Ties of cosines go to the
first licence by name. Rows are judged by their own text, also where they repeat an
id or have none; repeated rows each get a row. A directory with several licence
files takes the one with the largest cosine, ties to the first by path. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

THRESHOLD = 0.6
#: Rarer terms weigh like those of one file in so many; the smallest tables have as many.
RAREST = 200
HEADER_LINES = 20
#: The part of a template that its light terms may make in the second bound.
LIGHT = 0.15
# Texts by which works name or grant their licences, in full where they are short.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy '
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "All rights reserved. Unauthorized copying is prohibited"),
]
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _template_terms(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    made = spark.createDataFrame(rows, "template int, licence string, body string")
    return made.select("template", "licence", F.explode(_terms(F.col("body"))).alias("term")).groupBy("template", "licence", "term").agg(
        F.count("*").alias("tf")
    )


def _damped(tf: Column) -> Column:
    return 1.0 + F.log(tf.cast("double"))


def _idf(df: Column, n: int) -> Column:
    return F.least(F.log((1.0 + n) / (1.0 + F.coalesce(df, F.lit(0)))) + 1.0, F.lit(math.log(1.0 + RAREST) + 1.0))


def _telling(weights: list[tuple[int, str, float]], most: float, files: dict[str, int]) -> list[str]:
    """The template terms but for the commonest, which together make less than ``most`` of each template's length.

    ``weights``: template, term, part of the template's length; ``files``: how many hold a term.
    """
    places: dict[str, list[tuple[int, float]]] = {}
    for template, term, w in weights:
        places.setdefault(term, []).append((template, w * w))
    made: dict[int, float] = {}
    telling = []
    for term in sorted(places, key=lambda t: (-files.get(t, 0), t)):
        if all(made.get(t, 0.0) + w < 0.999 * most**2 for t, w in places[term]):
            made.update({t: made.get(t, 0.0) + w for t, w in places[term]})
        else:
            telling.append(term)
    return telling


def _key() -> Column:
    """What tells rows apart: their id, if any, and their text."""
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col("row").cast("string")), F.lit("-")), F.lit("|"), F.xxhash64("text").cast("string"))


def own_licences(spark: SparkSession, files: DataFrame) -> DataFrame:
    """row (an id of the file), path, licence, score of the best unit of each row (null if none is near enough), whole: its whole text is near.

    ``files`` has row, path, text.
    """
    in_templates = _template_terms(spark)
    vocabulary = sorted(r.term for r in in_templates.select("term").distinct().collect())  # bounded by the templates
    n = files.count()
    # combined before the shuffle: a task sends each term once
    frequency = files.select(F.explode(F.array_distinct(_terms("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    frequency = materialize(spark, frequency, "licence-df")
    seen = {r.term: r.df for r in frequency.where(F.col("term").isin(vocabulary)).collect()}
    known = spark.createDataFrame([(t, seen.get(t, 0)) for t in vocabulary], "term string, df long").withColumn("idf", _idf(F.col("df"), n))
    weighted = in_templates.join(F.broadcast(known), "term").withColumn("w", _damped(F.col("tf")) * F.col("idf"))
    lengths = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    vectors = weighted.join(lengths, "template").select("template", "licence", "term", (F.col("w") / F.col("length")).alias("unit"))
    vector_rows = sorted(tuple(r) for r in vectors.collect())
    vectors = spark.createDataFrame(vector_rows, "template int, licence string, term string, unit double")
    parts = [(t, term, w) for t, _, term, w in vector_rows]
    telling, heavy = _telling(parts, THRESHOLD, seen), _telling(parts, LIGHT, seen)
    weight = F.create_map(*(F.lit(x) for r in known.where(F.col("term").isin(heavy)).collect() for x in (r.term, r.idf)))

    # terms by line, then the units: lines, header, whole
    lines = files.select(_key().alias("key"), F.transform(F.split("text", r"[\r\n]+"), _terms).alias("lines"))
    tells = lambda terms: F.exists(terms, lambda t: t.isin(telling))
    some = lines.where(F.exists("lines", tells))
    unit = lambda terms, whole: F.struct(terms.alias("terms"), whole.alias("whole"))
    one = F.size("lines") == 1
    units = F.concat(
        F.transform("lines", lambda x: unit(x, one)), F.array(unit(F.flatten("lines"), F.lit(True)), unit(F.flatten(F.slice("lines", 1, HEADER_LINES)), F.lit(False)))
    )

    def may_reach(terms: Column) -> Column:
        hits = F.filter(terms, lambda t: t.isin(heavy))
        own = F.aggregate(F.array_distinct(hits), F.lit(0.0), lambda x, t: x + F.pow(weight[t] * _damped(F.size(F.filter(hits, lambda h: h == t))), F.lit(2.0)))
        return own >= 0.999 * (THRESHOLD - LIGHT) ** 2 * F.size(F.array_distinct(terms))

    told = F.filter(units, lambda u: tells(u["terms"]) & may_reach(u["terms"]))
    each = some.select("key", F.monotonically_increasing_id().alias("file"), F.posexplode(told).alias("place", "of"))
    counted = each.select("key", "file", "place", "of.whole", F.explode("of.terms").alias("term")).groupBy("key", "file", "place", "whole", "term").agg(F.count("*").alias("tf"))
    # written once: file numbers hold for all that follows
    counted = materialize(spark, counted, "licence-terms")
    # no idf is under 1, which bounds what terms outside the templates make of a unit's length from below: units that can't reach THRESHOLD go
    inside = counted.join(F.broadcast(known.select("term", "idf")), "term", "left")
    least = F.sum(F.pow(_damped(F.col("tf")) * F.coalesce("idf", F.lit(1.0)), F.lit(2.0))).alias("least")
    dot = inside.join(F.broadcast(vectors), "term").groupBy("file", "place", "template").agg(F.sum(_damped(F.col("tf")) * F.col("idf") * F.col("unit")).alias("dot"), F.first("licence").alias("licence"))
    norms = inside.groupBy("key", "file", "place", "whole").agg(least)
    near = dot.join(norms, ["file", "place"]).where(F.col("dot") >= 0.999 * THRESHOLD * F.sqrt("least")).drop("least")
    near = materialize(spark, near, "licence-near")
    kept = counted.join(near.select("file", "place").distinct(), ["file", "place"], "left_semi")
    outside = kept.join(F.broadcast(known.select("term")), "term", "left_anti")
    asked = outside.select("term").distinct()
    idf = known.select("term", "idf").unionByName(asked.join(frequency, "term", "left").select("term", _idf(F.col("df"), n).alias("idf")))
    length = kept.join(idf, "term").groupBy("file", "place").agg(F.sqrt(F.sum(F.pow(_damped(F.col("tf")) * F.col("idf"), F.lit(2.0)))).alias("norm"))
    scored = near.join(length, ["file", "place"]).select("key", "whole", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= THRESHOLD)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("down"), "licence")).alias("best"), F.max("whole").alias("whole"))
    best = best.select("key", F.col("best.licence").alias("licence"), (-F.col("best.down")).alias("score"), "whole")
    return files.select("row", "path", _key().alias("key")).join(best, "key", "left").select("row", "path", "licence", "score", F.coalesce("whole", F.lit(False)).alias("whole"))


def ancestors(directory: Column) -> Column:
    """All directories above and including one, the nearest last; the root is the empty string."""
    parts = F.split(directory, "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    up = F.transform(steps, lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), up))


def inherit(found: DataFrame, declares: Column) -> DataFrame:
    """Adds directory, basis ('own', 'inherited' or null) and from_directory to row, path, licence, score."""
    directory = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    found = found.withColumn("directory", directory)
    chosen = found.where(declares & F.col("licence").isNotNull() & F.col("directory").isNotNull())
    declared = chosen.groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("down"), "path", "licence")).alias("d"))
    declared = declared.select(F.col("directory").alias("above"), F.col("d.licence").alias("declared"))
    directories = found.where("directory is not null").select("directory").distinct()
    steps = directories.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("depth", "above"))
    nearest = steps.join(declared, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "declared")).alias("n"))
    nearest = nearest.select("directory", F.col("n.above").alias("from_directory"), F.col("n.declared").alias("declared"))
    out = found.join(nearest, "directory", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        "row", "path", F.coalesce("licence", "declared").alias("licence"), "score",
        F.when(own, "own").when(F.col("declared").isNotNull(), "inherited").alias("basis"),
        F.when(~own, F.col("from_directory")).alias("from_directory"),
    )


def is_licence_file(path: Column) -> Column:
    """Files that speak for their directory by their usual names; files whose whole text is a licence do so in any case."""
    return F.upper(F.element_at(F.split(path, "/"), -1)).rlike(r"^(LICEN[CS]E|COPYING|NOTICE|UNLICENSE)([._-].*)?$")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: doc_id, path, licence, score, basis, from_directory.

    The documents stand at the path source/lang/doc_id; the table has no file
    names, so a document whose whole text is a licence speaks for its directory.
    """
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = docs.select(F.col("doc_id").alias("row"), path.alias("path"), "text")
    out = inherit(own_licences(spark, files), F.col("whole"))
    return out.withColumnRenamed("row", "doc_id")


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL: dict[str, str] = {}
