"""License scans: entire texts looked up by the digest of their canonical form.

The canonical form drops case, punctuation, white space and copyright lines and writes equivalent
spellings one way, as the public license-matching guidelines do. A text whose digest is that of a
known license is that license, whatever its layout. The known texts are a small table of the
caller; their digests are broadcast only up to a checked number, and joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings (fixed values of the public matching guidelines).
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("merchantability", "merchantability"),
    ("modelling", "modeling"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Known texts (fixed values): license notices, and short licenses in full.
KNOWN = [
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT-notice", "Released under the MIT License."),
    ("BSD-3-Clause-notice", "Released under the BSD 3-Clause License."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
BROADCAST_ROWS = 1_000_000


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation and spacing, equivalent spellings written one way."""
    c = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    c = F.concat(F.lit(" "), F.array_join(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "), F.lit(" "))
    for old, new in EQUIVALENT:
        if old != new:
            c = F.replace(c, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(c)


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, license_text string")


def license_matches(docs: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id", lines: bool = True) -> DataFrame:
    """``doc_id, unit, license_id, n`` for each document that is, or holds as an entire line, a known license.

    ``unit`` is ``document`` or ``line``; ``n`` counts equal units. Null texts and units without a letter
    or digit match nothing. Two known licenses of one canonical form both match. Repeated rows of a
    document count together. A text that follows only a copyright line is still an entire license.
    """
    digest = F.sha2(F.col("canonical"), 256)
    ids = known.select("license_id", canonical(F.col("license_text")).alias("canonical")).filter("canonical != ''")
    ids = ids.select("license_id", digest.alias("digest")).distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    body = F.col(text)
    whole = F.array(F.struct(F.lit("document").alias("unit"), body.alias("t")))
    if lines:
        each = F.transform(F.split(body, "\n"), lambda t: F.struct(F.lit("line").alias("unit"), t.alias("t")))
        whole = F.concat(whole, F.when(F.contains(body, F.lit("\n")), each).otherwise(F.array().cast(each_type())))
    units = docs.filter(body.isNotNull()).select(F.col(key).alias("doc_id"), F.inline(whole))
    units = units.select("doc_id", "unit", canonical(F.col("t")).alias("canonical")).filter("canonical != ''")
    found = units.select("doc_id", "unit", digest.alias("digest")).join(ids, "digest")
    return found.groupBy("doc_id", "unit", "license_id").agg(F.count(F.lit(1)).alias("n"))


def each_type() -> str:
    return "array<struct<unit:string,t:string>>"
