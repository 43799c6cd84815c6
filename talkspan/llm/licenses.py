"""License scans with DataFrame functions only.

Templates and documents are cut into word shingles. Windows of a document overlap by half and come in sizes of powers
of two; a template belongs to the size that holds it wherever it stands. A window and a template whose MinHash
signatures agree in a whole band are a candidate; exact containment of the template's shingles in the window decides.
A window of size w holds a template of n shingles with Jaccard similarity n * CONTAINED / w or more, w at most 4n, so
s >= 0.2; BANDS bands of one row miss such a pair with probability (1 - s)^BANDS or less: below 1 in 10^6 for a copy
that is whole and below 1 in 600 for one at the limit. Templates of one to four shingles are compared at window
sizes where s is higher still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.llm.common import SPACE, stored

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32
#: Texts of public license notices; fixed values.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def words(text: Column) -> Column:
    """Words in lower case, without punctuation at their ends; words of punctuation alone are none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}{SPACE}.+-]+|[.+-]+(?=[{SPACE}]|$)|(?<=[{SPACE}]|^)[.+-]+", " ")
    return F.filter(F.split(plain, f"[{SPACE}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of SHINGLE neighbouring words; of the whole sequence if it is shorter; none of no words."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<long>"))


def signature(hashes: Column) -> Column:
    """BANDS minima of seeded hashes: a band each."""
    return F.array(*[_least(hashes, b) for b in range(BANDS)])


def _least(hashes: Column, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed))))


def _windows(s: Column, size: int, every: Column) -> Column:
    """array<struct<size, start, w>>: windows of s with a template's shingle, overlapping by half."""
    step = max(1, size // 2)
    starts = F.sequence(F.lit(1), F.greatest(F.size(s) - (size - step), F.lit(1)), F.lit(step))
    windows = F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("start"), F.slice(s, i, size).alias("w")))
    return F.filter(windows, lambda x: F.arrays_overlap(x["w"], every))


def template_table(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    """license, t (distinct shingles), n, size (of the windows that hold it), sig."""
    each = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(body).alias("body")) for name, body in templates])
    rows = spark.range(1).select(F.explode(each).alias("x")).select("x.license", words(F.col("x.body")).alias("w"))
    rows = rows.select("license", F.array_distinct(shingles(F.col("w"))).alias("t")).withColumn("n", F.size("t"))
    # windows overlap by half, so one of twice the template's size holds all of it; single shingles need no slack
    size = F.when(F.col("n") == 1, F.lit(1)).otherwise(F.pow(F.lit(2), F.ceil(F.log2(F.col("n"))) + 1)).cast("int")
    return rows.withColumn("size", size).withColumn("sig", signature(F.col("t")))


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, found array<struct<license, containment, start int>>: a row for each row of docs (doc_id, text).

    A license is found if a window holds CONTAINED or more of its shingles; containment is the best over windows, and
    start the first word of the earliest window at that (from 1). Null and empty texts have an empty array. The
    templates are part of the plan: their number and length are fixed parameters. Documents without any template's
    shingle are passed over before windows are made, as no window of theirs can hold one.
    """
    spark = docs.sparkSession
    table = stored(template_table(spark, templates))
    known = table.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t"))))).first()[0]
    every = F.array(*[F.lit(h) for h in known])
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "row_key", shingles(F.col("w")).alias("s"))
    rows = rows.withColumn("hit", F.arrays_overlap("s", every))
    rows = stored(rows.select("doc_id", "row_key", F.when(F.col("hit"), F.concat(*[_windows(F.col("s"), z, every) for z in sizes])).alias("windows")))
    windows = rows.where("windows is not null").dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", F.explode("windows").alias("x"))
    windows = windows.select("doc_id", "row_key", "x.size", "x.start", "x.w")
    bands = windows.select("*", F.posexplode(signature(F.col("w"))).alias("band", "least"))
    keys = table.select("license", "t", "n", "size", F.posexplode("sig").alias("band", "least"))
    hits = bands.join(F.broadcast(keys), ["size", "band", "least"])  # a template's BANDS rows, whatever the data
    hits = hits.dropDuplicates(["doc_id", "row_key", "size", "start", "license"])
    held = hits.withColumn("c", F.size(F.array_intersect("w", "t")) / F.col("n")).where(F.col("c") >= CONTAINED)
    best = held.groupBy("doc_id", "row_key", "license").agg(F.max(F.struct("c", (-F.col("start")).alias("m"))).alias("b"))
    one = F.struct("license", F.col("b.c").alias("containment"), (-F.col("b.m")).alias("start"))
    found = best.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(one)).alias("found"))
    found = found.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "found")
    joined = rows.select("doc_id", "row_key").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left")
    none = F.array().cast("array<struct<license:string,containment:double,start:int>>")
    return joined.select("doc_id", F.coalesce("found", none).alias("found"))
