"""Licences of files: TF-IDF cosine of headers and licence files to templates, inherited from ancestor directories.

Blocks of a file are compared with templates: the whole text of a licence file, the header (what stands before the
first empty line), paragraphs, and runs of one to three lines. Templates are full texts, the notices by which files
name their licences, and SPDX lines. Comment marks and line ends don't count. A block is compared once, however
many files have it. A file takes the licence of its best block; a file without one takes that of the nearest
directory above it that has a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.llm.common import Scratch

# Texts and notices of public licences, each as one line.
GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as "
    "published by the Free Software Foundation, either version {version} of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You "
    "should have received a copy of the GNU {name} along with this program."
)
GENERAL, LESSER, AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "MIT": (
        "Released under the MIT License.",
        "MIT License Copyright (c) " + GRANT + "The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    "BSD-2-Clause": (CONDITIONS + DISCLAIMER,),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license.", CONDITIONS + NAMES + DISCLAIMER),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        GNU.format(name=GENERAL, version=3),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This program is licensed under the GNU General Public License, version 2.",
        GNU.format(name=GENERAL, version=2),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        GNU.format(name=LESSER, version=3),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        GNU.format(name=AFFERO, version=3),
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "MPL-2.0": (
        "This file is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "LicenseRef-All-Rights-Reserved": ("All rights reserved.",),
}
#: A licence that a file names by its identifier only.
SPDX = "SPDX-License-Identifier: {name}"
#: Every template has one of these; a block without any of them shares too few terms with each to reach the score.
LICENCE_WORDS = (
    r"(?i)licen[sc]|copyright|copyleft|spdx|all rights reserved|public domain|\bCC[ 0-]|permission|redistribut|warrant|unencumbered"
)
LICENCE_FILES = r"(?i)/(licen[sc]e|copying|notice|copyright)[^/]*$"
#: Marks around the lines of a comment.
COMMENT = r"(?m)^[\s/*#;%!<>|\"'-]+|[\s/*#|\"'-]+$"
#: The most lines that are compared as one block, besides headers, paragraphs and licence files.
RUN = 3


def plain(block: Column) -> Column:
    """A block as one line, without comment marks and repeated white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(block, COMMENT, ""), r"\s+", " "))


def blocks(files: DataFrame) -> DataFrame:
    """(path, block): what is compared of each file, each block of a file once. Only those with a licence word stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = files.filter(text.rlike(LICENCE_WORDS))
    whole = F.when(F.col("path").rlike(LICENCE_FILES), F.array(text)).otherwise(F.array().cast("array<string>"))

    def runs(lines: Column) -> Column:
        """For each line the run of lines that begins there; a sentence may be broken anywhere."""
        every = F.transform(lines, lambda _, i: F.slice(lines, i + 1, F.lit(RUN)))
        return F.filter(every, lambda run: F.array_join(run, "\n").rlike(LICENCE_WORDS))

    # the array of an array names the lines once for all runs
    runs_of = F.flatten(F.transform(F.array(F.split(text, "\r?\n")), runs))
    parts = [F.concat(whole, F.split(text, r"\n\s*\n")).alias("parts"), runs_of.alias("runs")]
    listed = marked.select("path", *parts)
    run = [F.array_join(F.slice("run", 1, n), "\n") for n in range(1, RUN + 1)]
    short = listed.select("path", F.explode("runs").alias("run")).select("path", F.explode(F.array(*run)).alias("block"))
    found = listed.select("path", F.explode("parts").alias("block")).unionByName(short)
    found = found.filter(F.col("block").rlike(LICENCE_WORDS))
    return found.select("path", plain(F.col("block")).alias("block")).filter("block != ''").distinct()


def terms(line: Column) -> Column:
    """Runs of letters, digits, dots, plus and minus signs, in lower case, without dots at the end."""
    found = F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}](?:[\p{L}\p{N}.+-]*[\p{L}\p{N}+])?"), F.lit(0))
    return found


def license_scan(
    files: DataFrame,
    scratch: Scratch | None = None,
    templates: dict[str, tuple[str, ...]] | None = None,
    min_score: float = 0.75,
) -> DataFrame:
    """(path, text) -> path, own_license, own_score, license, inherited_from; one row per row.

    own_score is 0 and own_license NULL without a block that reaches `min_score`; of equal scores the
    licence first by name wins. Licence files are those whose names say so (LICENSE, COPYING, NOTICE);
    of several in a directory the best score, then the first path, speaks for it. inherited_from is the
    directory, NULL where the file has a licence of its own or finds none. A NULL path inherits nothing;
    a NULL or empty text has no blocks. Rows that repeat a path share the best licence of all of them. Other
    columns are ignored.
    """
    spark = files.sparkSession
    scratch = scratch or Scratch(spark)
    chosen = TEMPLATES if templates is None else templates
    found = blocks(files.select("path", "text")).withColumnRenamed("block", "text")
    # a block is long, so its terms are shuffled with a digest of it and not with the block
    lines = scratch.save(found.select("path", F.unhex(F.sha2("text", 256)).alias("line"), "text"), "blocks")
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    bodies = lines.groupBy("line").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    tf = (
        bodies.select("line", "times", F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("line", "term")
        .agg((1 + F.log(F.count(F.lit(1)))).alias("tf"), F.first("times").alias("times"))
    )
    tf = scratch.save(tf, "tf")
    total = counted.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).scalar()
    idf = tf.groupBy("term").agg((F.log((total + 1.0) / (F.sum("times") + 1.0)) + 1.0).alias("idf"))
    idf = scratch.save(idf, "idf")
    known = [(name, i, plain_text) for name, texts in sorted(chosen.items())
             for i, plain_text in enumerate((*texts, SPDX.format(name=name)))]
    patterns = spark.createDataFrame(known, "license string, form int, line string")
    pattern_tf = (
        patterns.select(F.struct("license", "form").alias("template"), F.explode(terms(F.col("line"))).alias("term"))
        .groupBy("template", "term")
        .agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    )

    def weighted(df: DataFrame, by: str) -> DataFrame:
        # a term that no line of the corpus has weighs most
        rarest = F.log(total + 1.0) + 1.0
        w = df.join(idf, "term", "left").select(by, "term", (F.col("tf") * F.coalesce("idf", rarest)).alias("w"))
        norm = w.groupBy(by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, by)

    left = weighted(tf, "line")
    right = weighted(pattern_tf, "template").select("template", "term", F.col("w").alias("v"), F.col("norm").alias("vnorm"))
    cosine = F.round(F.sum(F.col("w") * F.col("v")) / (F.max("norm") * F.max("vnorm")), 6)
    scores = left.join(right, "term").groupBy("line", "template").agg(cosine.alias("score")).filter(F.col("score") >= min_score)
    scores = scores.select("line", F.col("template.license").alias("license"), "score")
    best = scores.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
    best = scratch.save(best.select("line", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score")), "best")
    own = (
        lines.select("path", "line").join(best, "line")
        .groupBy("path")
        .agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
        .select(F.col("path").alias("own_path"), F.col("b.license").alias("own_license"), (-F.col("b.less")).alias("own_score"))
    )
    own = scratch.save(own, "own")

    speaks = own.withColumnRenamed("own_path", "path").filter(F.col("path").rlike(LICENCE_FILES))
    directory = F.regexp_replace("path", "/[^/]*$", "")
    declared = (
        speaks.groupBy(directory.alias("dir"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("less"), "path", "own_license")).alias("b"))
        .select("dir", F.col("b.own_license").alias("dir_license"))
    )
    declared = scratch.save(declared, "declared")

    # Directories above are looked up once for each directory, not for each file.
    paths = files.select("path")
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"))
    )
    nearest = (
        paths.filter(F.col("path").isNotNull())
        .select(directory.alias("dir"))
        .distinct()
        .select(F.col("dir").alias("below"), F.explode(above).alias("up"))
        .select("below", "up.depth", "up.dir")
        .join(declared, "dir")
        .groupBy("below")
        .agg(F.max(F.struct("depth", "dir", "dir_license")).alias("up"))
        .select("below", F.col("up.dir").alias("from_dir"), "up.dir_license")
    )
    nearest = scratch.save(nearest, "nearest")
    found = (
        paths.withColumn("below", directory)
        .join(own, F.col("path").eqNullSafe(F.col("own_path")), "left")
        .join(nearest, "below", "left")
    )
    alone = F.col("own_license").isNull()
    return found.select(
        "path",
        "own_license",
        F.coalesce("own_score", F.lit(0.0)).alias("own_score"),
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(alone, F.col("from_dir")).alias("inherited_from"),
    )
