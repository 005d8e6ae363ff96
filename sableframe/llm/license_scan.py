"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by path.

Two kinds of passages are compared: the whole text of a licence file (by its
name), and in any file each header, a run of lines around those with a cue
(licence, copyright, SPDX; `AROUND` lines on either side). Terms are weighed by
frequency and by rarity among the templates: notices, file headers, whole
licences and SPDX tags. A passage's terms meet the small table of template terms
by a broadcast join, and the cosine with each template is the sum over shared
terms by both norms; at least `THRESHOLD` names a licence. A file's own licence is
that of its best passage, the lesser template's name on ties. A directory has the
licence of the licence files in it, the best first; a file without one inherits
from its own directory or the nearest ancestor that has one. Directories are
resolved once each and joined back by path, so that large directories cost no
more than small ones.

Null and empty texts have no passages; null paths have no directory and inherit
nothing. Repeated rows (file_id and path) are one file whose passages count
together, and each of them gets the result; an empty table gives no rows. Other
columns are ignored. All of it is native column expressions and joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.functions.text import let

from .common import table

#: Wordings by licence: notices, headers of files, SPDX tags and whole licences, as published.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms is permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution license, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This source is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name.removesuffix("-only"), f"SPDX-License-Identifier: {name}") for name in ("AGPL-3.0-only", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-2.0-only", "GPL-3.0-only", "ISC", "LGPL-3.0-only", "MIT", "MPL-2.0")),
]
CUE = "licen[sc]e|copyright|spdx|redistribut|permission"
AROUND = 1
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.6
LICENSE_FILE = "(?i)^(licen[sc]e|copying|notice)([.-][^/]*)?$"


def _weights() -> tuple[list[tuple[str, float]], float, list[tuple[int, str, str, float]]]:
    """Rarity of the templates' terms, that of any other term, and the templates' unit vectors."""
    counts = [(name, Counter(re.findall(TERM, text.lower()))) for name, text in TEMPLATES]
    df = Counter(t for _, c in counts for t in c)
    rarity = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in sorted(df.items())}
    vectors = []
    for k, (name, c) in enumerate(counts):
        w = {t: n * rarity[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors += [(k, name, t, x / norm) for t, x in w.items()]
    return list(rarity.items()), math.log(1 + len(counts)) + 1, vectors


def passages(files: DataFrame) -> DataFrame:
    """(file_id, path, passage, text): licence files whole, as passage 0, and the headers of all files by their first line.

    Lines and cues are bound once, and a run of neighbouring lines is found from
    each cue and the one before it, so the work is linear in a file's lines.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)

    def cue_lines(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).rlike(CUE), i)), lambda i: i.isNotNull())

    def edges(cues: Column, step: int) -> Column:
        """Cues without a neighbour before (-1) or after (1) whose lines around it touch theirs."""
        far = F.transform(cues, lambda i, k: F.when(F.coalesce(step * (F.get(cues, k + step) - i) > 2 * AROUND + 1, F.lit(True)), i))
        return F.filter(far, lambda i: i.isNotNull())

    def headers(lines: Column, cues: Column) -> Column:
        def run(r: Column) -> Column:
            start, end = F.greatest(r["a"] - AROUND, F.lit(0)), F.least(r["b"] + AROUND, F.size(lines) - 1)
            return F.struct((start + 1).alias("passage"), F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("text"))

        runs = F.transform(F.arrays_zip(edges(cues, -1).alias("a"), edges(cues, 1).alias("b")), run)
        # a run of neighbouring lines is one header; so is each line with a cue alone
        return F.concat(runs, F.transform(cues, lambda i: F.struct((-i - 1).alias("passage"), F.get(lines, i).alias("text"))))

    found = let(F.split("text", "\n"), lambda lines: let(cue_lines(lines), lambda cues: headers(lines, cues)))
    whole = F.when(name.rlike(LICENSE_FILE), F.array(F.struct(F.lit(0).alias("passage"), F.col("text").alias("text")))).otherwise(F.array())
    both = F.when(F.lower("text").rlike(CUE), F.concat(whole, found)).otherwise(whole)
    return files.where("text IS NOT NULL").select("file_id", "path", F.explode(both).alias("p")).select("file_id", "path", "p.passage", "p.text")


def own_licenses(files: DataFrame) -> DataFrame:
    """(file_id, path, own) of files with a licence of their own: struct(similarity, license)."""
    spark = files.sparkSession
    rarity, other, vectors = _weights()
    rare = F.broadcast(spark.createDataFrame(rarity, "t string, rarity double"))  # some hundred terms, fixed above
    template = F.broadcast(spark.createDataFrame(vectors, "template int, license string, t string, weight double"))
    terms = passages(files).select("file_id", "path", "passage", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("t"))
    key = ["file_id", "path", "passage"]
    weighed = terms.groupBy(*key, "t").agg(F.count("*").alias("tf")).join(rare, "t", "left")
    weighed = weighed.select(*key, "t", (F.col("tf") * F.coalesce("rarity", F.lit(other))).alias("w"))
    # One row of a term for each template that has it, and one of no template for the norm.
    met = weighed.join(template, "t", "left").withColumn("share", F.col("w") * F.col("weight"))
    norm = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = met.where("template IS NOT NULL").groupBy(*key, "template", "license").agg(F.sum("share").alias("dot"))
    norm = norm.withColumnsRenamed({k: f"n_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in key]
    found = dots.join(norm, same).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= THRESHOLD)
    # The greatest similarity; of equal ones the lesser name.
    best = F.min_by(F.struct("similarity", "license"), F.struct(-F.col("similarity"), "license"))
    return found.groupBy("file_id", "path").agg(best.alias("own"))


def scan(files: DataFrame) -> DataFrame:
    """file_id, path, own_license, similarity, license, inherited_from for `files` (file_id, path, text)."""
    found = own_licenses(files).withColumnsRenamed({"file_id": "of_id", "path": "of_path"})
    same = [F.col("file_id").eqNullSafe(F.col("of_id")), F.col("path").eqNullSafe(F.col("of_path"))]
    directory = F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit(""))
    own = files.select("file_id", "path").join(found, same, "left").select("file_id", "path", directory.alias("directory"), "own")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    licensed = (
        own.where(F.col("own").isNotNull() & name.rlike(LICENSE_FILE) & F.col("directory").isNotNull())
        .groupBy("directory")
        .agg(F.min_by("own", F.struct(-F.col("own.similarity"), "own.license")).alias("best"))
        .select(F.col("directory").alias("ancestor"), F.col("best.license").alias("from_directory"))
    )
    # Each directory once, with all its ancestors; the deepest with a licence wins.
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))
    directories = files.select(directory.alias("directory")).where("directory IS NOT NULL").distinct().select("directory", F.explode(above).alias("a")).select("directory", "a.*")
    nearest = (
        directories.join(licensed, "ancestor")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "ancestor", "from_directory")).alias("n"))
        .select(F.col("directory").alias("place"), F.col("n.ancestor").alias("ancestor"), F.col("n.from_directory").alias("from_directory"))
    )
    # Files without a directory inherit nothing; a key of their own keeps them from meeting in one task.
    placed = own.withColumn("at", F.coalesce("directory", F.concat(F.lit("/"), F.xxhash64("file_id", "path").cast("string"))))
    return placed.join(nearest, F.col("at") == F.col("place"), "left").select(
        "file_id",
        "path",
        F.col("own.license").alias("own_license"),
        F.col("own.similarity").alias("similarity"),
        F.coalesce("own.license", "from_directory").alias("license"),
        F.when(F.col("own").isNull(), F.col("ancestor")).alias("inherited_from"),
    )


# -- the query --------------------------------------------------------------


def files_of(docs: DataFrame) -> DataFrame:
    """Documents have no paths; a tree below their source follows from the id, one file in 16 a licence file."""
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    step = [F.when(h % 4 > k, F.concat(F.lit("dabc"[k + 1]), ((h / 4 ** (k + 1)).cast("long") % 4).cast("string"))) for k in range(3)]
    name = F.when((h / 65536).cast("long") % 16 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), *step, name).alias("path"), "text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(files_of(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def oracle() -> str:
    rarity, other, vectors = _weights()
    terms = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in rarity)
    weights = ", ".join(f"({k}, '{name}', '{t}', {x!r}::DOUBLE)" for k, name, t, x in vectors)
    step = " || ".join(f"CASE WHEN h % 4 > {k} THEN '{'abc'[k]}' || ((h // {4 ** (k + 1)}) % 4)::VARCHAR || '/' ELSE '' END" for k in range(3))
    return f"""
WITH rarity(t, r) AS (VALUES {terms}),
template(k, license, t, w) AS (VALUES {weights}),
files AS (
  SELECT doc_id, text, coalesce(source, 'unknown') || '/' || {step} ||
    CASE WHEN (h // 65536) % 16 = 0 THEN 'LICENSE' ELSE 'doc-' || doc_id::VARCHAR || '.txt' END AS path
  FROM (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT::BIGINT AS h FROM documents)),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos
  FROM files WHERE regexp_matches(lower(text), '{CUE}')),
near AS (
  SELECT l.doc_id, l.pos, l.line, l.pos - row_number() OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS run FROM lines l
  WHERE EXISTS (SELECT 1 FROM lines c WHERE c.doc_id = l.doc_id AND abs(c.pos - l.pos) <= {AROUND} AND regexp_matches(lower(c.line), '{CUE}'))),
passage AS (
  SELECT doc_id, min(pos) AS p, string_agg(line, chr(10) ORDER BY pos) AS body FROM near GROUP BY doc_id, run
  UNION ALL SELECT doc_id, -pos, line FROM lines WHERE regexp_matches(lower(line), '{CUE}')
  UNION ALL SELECT doc_id, 0, text FROM files WHERE path LIKE '%/LICENSE' AND text IS NOT NULL),
terms AS (SELECT doc_id, p, t, count(*) AS tf FROM (SELECT doc_id, p, unnest(regexp_extract_all(lower(body), '{TERM}')) AS t FROM passage) GROUP BY ALL),
weighed AS (SELECT doc_id, p, t, tf * coalesce(r, {other!r}::DOUBLE) AS w FROM terms LEFT JOIN rarity USING (t)),
norms AS (SELECT doc_id, p, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
sims AS (
  SELECT doc_id, license, round(sum(x.w * y.w) / any_value(norm), 6) AS s
  FROM weighed x JOIN template y USING (t) JOIN norms USING (doc_id, p) GROUP BY doc_id, p, k, license),
own AS (SELECT doc_id, s, license FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, license) = 1),
placed AS (
  SELECT f.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, CASE WHEN s >= {THRESHOLD} THEN license END AS own_license,
    CASE WHEN s >= {THRESHOLD} THEN s END AS similarity
  FROM files f LEFT JOIN own USING (doc_id)),
licensed AS (
  SELECT directory AS ancestor, own_license AS found FROM placed WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE'
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY similarity DESC, own_license) = 1),
nearest AS (
  SELECT d.directory, ancestor, found FROM (SELECT DISTINCT directory FROM placed) d
  JOIN licensed ON d.directory = ancestor OR starts_with(d.directory, ancestor || '/')
  QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(ancestor) DESC) = 1)
SELECT doc_id, path, own_license, similarity, coalesce(own_license, found) AS license,
  CASE WHEN own_license IS NULL THEN ancestor END AS inherited_from
FROM placed LEFT JOIN nearest USING (directory)
"""
