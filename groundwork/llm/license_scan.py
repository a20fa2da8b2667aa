"""License scan with Spark expressions only: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines, blocks between blank lines and whole files are compared with the
templates.  A file takes its best line, block or whole as its own license.  A
license file (by its name, or because its whole text is near a template)
licenses its directory, and a file without a license of its own takes that of
its nearest ancestor directory that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import runs
from .scratch import Scratch

# SPDX identifiers and public notices of the licenses.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A tag names its license itself; which versions come after doesn't matter here.
TAG = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)"
TAG_END = r"(-only|-or-later|\+)$"
TOKEN = "[a-z0-9]+"
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)(\.(txt|md|rst))?$"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _idf(df: Column, n: int) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def scan_licenses(files: DataFrame, threshold: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """``(path, license_id, score, origin, license_path)``, one row per row of ``files`` (columns ``path`` and ``text`` used).

    ``score`` is the cosine of TF-IDF vectors, with document frequencies over
    all files; a word of no template has the weight of one that no file has.
    ``origin`` is ``own``, ``inherited`` or null (no license: ``license_id``
    and ``score`` null).  Ties go to the smaller license id, between license
    files of a directory to the higher score, then the smaller path.  A line
    with an SPDX tag has the license that it names, with a score of 1.  Null and
    empty texts can only inherit; a null path inherits nothing and isn't
    scanned; texts of any length are scanned whole; rows that repeat a path are one file with the union of their
    segments.  An empty table gives no rows; other columns are ignored.
    """
    spark = files.sparkSession
    tables = Scratch(spark, "licenses")
    texts = files.select("path", F.coalesce("text", F.lit("")).alias("text")).where("path is not null")
    given = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "t int, license_id string, text string")
    tf_t = given.select("t", "license_id", F.explode(_tokens(F.col("text"))).alias("term")).groupBy("t", "license_id", "term").agg(F.count("*").alias("tf"))

    # the vocabulary of the templates is a parameter's, so its size has a bound
    terms = sorted(r["term"] for r in tf_t.select("term").distinct().collect())
    listed = F.array(*map(F.lit, terms))
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    seen = texts.select(F.explode(F.concat(F.array_intersect(words, listed), F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = {r["term"]: r["df"] for r in seen.collect()}  # at most one row per term
    n = df.pop("", 0)
    idf = spark.createDataFrame([(t, df.get(t, 0)) for t in terms], "term string, df long").select("term", _idf(F.col("df"), n).alias("idf"))
    vector = tf_t.join(idf, "term").withColumn("tw", F.col("tf") * F.col("idf"))
    norm = vector.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    vector = vector.join(norm, "t").select("t", "license_id", "term", (F.col("tw") / F.col("tnorm")).alias("tw"))
    found = _anchors([(r["t"], r["term"], r["tw"]) for r in vector.collect()], df, threshold)

    # A text without these words can't reach the threshold with any template.
    anchors = F.array(*map(F.lit, sorted(found | {"spdx"})))
    some = texts.where(F.arrays_overlap(words, anchors))
    parts = some.select(
        "path",
        F.explode(
            F.concat(
                F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("line").alias("kind"), x.alias("part"))),
                F.transform(F.split("text", r"\n[ \t\r]*\n"), lambda x: F.struct(F.lit("block").alias("kind"), x.alias("part"))),
                F.array(F.struct(F.lit("file").alias("kind"), F.col("text").alias("part"))),
            )
        ).alias("s"),
    ).select("path", "s.kind", F.when(F.col("s.kind") == "line", F.regexp_replace(F.regexp_extract("s.part", TAG, 1), TAG_END, "")).alias("tag"), _tokens(F.col("s.part")).alias("terms"))
    parts = parts.where(F.arrays_overlap("terms", anchors))
    parts = tables.save(parts.select(F.monotonically_increasing_id().alias("id"), "path", "kind", "tag", "terms"))
    # terms are counted within the row, so only sums are shuffled; what is broadcast is bounded by the templates' words
    tf = parts.select("id", F.explode_outer(runs(F.col("terms"))).alias("r")).select("id", F.col("r.token").alias("term"), F.col("r.n").alias("tf"))
    weighted = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(None).cast("double"), _idf(F.lit(0.0), n)))
    own_norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = weighted.join(F.broadcast(vector.select("t", "term", "tw")), "term").groupBy("id", "t").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    near = dot.join(own_norm, "id").select("id", "t", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    named = near.join(F.broadcast(given.select("t", "license_id")), "t").join(parts.select("id", "path", "kind"), "id").select("path", "kind", "license_id", "score")
    tagged = parts.where("tag <> ''").select("path", "kind", F.col("tag").alias("license_id"), F.lit(1.0).alias("score"))
    scored = tables.save(
        named.unionByName(tagged)
        .groupBy("path", "license_id")
        .agg(F.max("score").alias("score"), F.max(F.when(F.col("kind") == "file", F.col("score"))).alias("file_score"))
    )
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("license_id")))
    own = scored.groupBy("path").agg(best.alias("b"), F.max("file_score").alias("file_score")).select("path", F.col("b.license_id").alias("license_id"), (-F.col("b.s")).alias("score"), "file_score")

    # license files license their directory; each directory asks all above it, nearest first
    name, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]*$", "")
    licenses = own.where(F.col("file_score").isNotNull() | name.rlike(LICENSE_NAME)).groupBy(folder.alias("above"))
    licenses = licenses.agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path"), F.col("license_id"))).alias("l"))
    folders = files.where("path is not null").select(folder.alias("folder")).distinct()
    names = F.split("folder", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/")), F.when(F.col("folder") != "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    inherited = (
        folders.select("folder", F.explode(above).alias("above"))
        .join(licenses, "above")
        .groupBy("folder")
        .agg(F.max_by("l", F.length("above")).alias("l"))
    )
    out = files.select("path", folder.alias("folder")).join(own.drop("file_score"), "path", "left").join(inherited, "folder", "left")
    mine = F.col("license_id").isNotNull()
    return out.select(
        "path",
        F.coalesce("license_id", "l.license_id").alias("license_id"),
        F.coalesce("score", -F.col("l.s")).alias("score"),
        F.when(mine, "own").when(F.col("l.license_id").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("l.path")).alias("license_path"),
    )


def _anchors(weights: list[tuple[int, str, float]], df: dict[str, int], threshold: float) -> set[str]:
    """Words of which a text must hold one to reach the threshold with any template.

    Without its rarest words a template's unit vector has a norm below the
    threshold, so by Cauchy and Schwarz no text without them reaches it.
    """
    out: set[str] = set()
    for t in {t for t, _, _ in weights}:
        left = 1.0
        for _, term, w in sorted((df.get(term, 0), term, w) for x, term, w in weights if x == t):
            if left < (threshold - 1e-5) ** 2:
                break
            out.add(term)
            left -= w * w
    return out
