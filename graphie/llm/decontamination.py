"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A document is read as five-word shingles. Item-sized windows are laid where they can match at all:
a window of similarity 0.8 shares a shingle with its item, so every shared shingle lays the window
that puts it at the item's place. Each window gets a 64-bit SimHash of its shingles, each repeat
weighing again. With one block more than the radius, two fingerprints within the radius agree in a
whole block, so a join on (block, value) misses none of them. Candidates are verified by the exact
weighted similarity: shared over united shingle counts.

Everything is DataFrame operations. The benchmark is looked up as a constant and broadcast only
while its shingles number at most ``lookup_rows``; beyond that both are joined by shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphie.functions.plan import computed_once

SHINGLE, SIMILARITY = 5, 0.8
RADIUS = 15  # 16 blocks of 4 bits
LOOKUP_ROWS = 200_000


def shingles(text: str) -> Column:
    """Hashes of the five-word shingles in order; of the whole sequence where it is shorter; empty without words."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        # beyond the end there are nulls, which a hash skips: the first one of a short text covers all of it
        each = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
        return F.slice(each, F.lit(1), F.greatest(F.lit(1), F.size(w) - (SHINGLE - 1)))

    return F.coalesce(F.transform(F.array(words), hashes)[0], F.array().cast("array<bigint>"))


def fingerprint(hashes: str) -> Column:
    """SimHash: bit b is set where more than half of the shingle hashes have it."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(CAST(2 * aggregate({hashes}, 0L, "
        f"(n, x) -> n + (shiftright(x, b) & 1L)) > size({hashes}) AS BIGINT), b))"
    )


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of least counts over sum of greatest counts of two lists."""
    shared = (
        f"aggregate(array_intersect({a}, {b}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    )
    return F.expr(f"{shared} / CAST(size({a}) + size({b}) - {shared} AS DOUBLE)")


def _windows_by_lookup(docs: DataFrame, places: list) -> DataFrame:
    """Windows of each document from a constant table of shingle buckets, read once as a scalar subquery."""
    size = 1
    while size < len(places):
        size *= 2
    buckets: list[list] = [[] for _ in range(size)]
    bits = [0] * size  # 64 for each bucket: most shingles of a document are dismissed by one of them
    for r in places:
        buckets[r["h"] % size].append({"h": r["h"], "at": r["at"], "n": r["n"]})
        bits[r["h"] % size] |= 1 << (r["h"] >> 40 & 63)
    text = json.dumps({"bits": [x - (1 << 64) if x >> 63 else x for x in bits], "buckets": buckets})
    table = docs.sparkSession.createDataFrame([(text,)], "t string")
    table = table.select(F.from_json("t", "bits array<bigint>, buckets array<array<struct<h:bigint,at:int,n:int>>>")).scalar()

    def laid(t: Column) -> Column:
        def slot(h: Column) -> Column:
            return F.pmod(h, F.lit(size)).cast("int")

        def maybe(h: Column, i: Column) -> Column:
            bit = F.call_function("shiftright", F.get(t["bits"], slot(h)), F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int"))
            return F.when(bit.bitwiseAND(F.lit(1)) == 1, F.struct(h.alias("h"), i.alias("i")))

        def places_of(hit: Column) -> Column:
            same = F.filter(F.get(t["buckets"], slot(hit["h"])), lambda e: e["h"] == hit["h"])
            return F.transform(same, lambda e: F.struct((hit["i"] - e["at"]).alias("start"), e["n"].alias("n")))

        hits = F.filter(F.transform("hashes", maybe), lambda x: x.isNotNull())
        return F.array_distinct(F.flatten(F.transform(hits, places_of)))

    # the table is bound as a lambda variable, so no row carries it; the window lists are computed once for each row
    rows = docs.select("doc_id", "hashes", table.alias("_table"))
    rows = rows.select("doc_id", "hashes", computed_once(F.transform(F.array("_table"), laid)[0]).alias("laid"))
    return rows.select("doc_id", "hashes", F.inline("laid"))


def _windows_by_join(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The same by shuffle: shingles meet the benchmark's, windows go back to their documents."""
    each = docs.select("doc_id", F.xxhash64("hashes").alias("own"), F.posexplode("hashes").alias("i", "h"))
    laid = each.join(places, "h").select("doc_id", "own", (F.col("i") - F.col("at")).alias("start"), "n").distinct()
    laid = laid.select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), "start", "n")
    back = docs.withColumn("own", F.xxhash64("hashes")).distinct()
    return back.join(laid, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own"))).select("doc_id", "hashes", "start", "n")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text",
    similarity: float = SIMILARITY, lookup_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """``doc_id, item_id, similarity, n_windows``: the items each document contains, with the best window's similarity.

    Documents without a match give no row. Null texts, and texts and items without a word, match
    nothing; an item shorter than a shingle matches only a document of exactly its words. Repeated
    documents and items count once each. An empty table gives no rows.
    """
    items = benchmark.select(F.col(item).alias("item_id"), shingles(item_text).alias("item")).filter("size(item) > 0").distinct()
    places = items.select(F.size("item").alias("n"), F.posexplode("item").alias("at", "h")).distinct()
    few = places.limit(lookup_rows + 1).collect()  # bounded
    rows = docs.select(F.col(key).alias("doc_id"), computed_once(shingles(text)).alias("hashes"))
    items = items.withColumn("item_print", fingerprint("item"))
    if len(few) <= lookup_rows:
        laid, items = _windows_by_lookup(rows, few), F.broadcast(items)
    else:
        laid = _windows_by_join(rows, places)
    first = F.greatest(F.col("start"), F.lit(0))
    last = F.least(F.col("start") + F.col("n"), F.size("hashes"))
    windows = laid.select("doc_id", "start", F.slice("hashes", first + 1, last - first).alias("window"))
    windows = windows.distinct().withColumn("print", fingerprint("window"))
    keyed = "transform(sequence(0, {r}), b -> struct(b AS {p}block, shiftrightunsigned({c}, 4 * b) & 15L AS {p}value))"
    windows = windows.select("*", F.inline(F.expr(keyed.format(r=RADIUS, p="", c="print"))))
    known = items.select("*", F.inline(F.expr(keyed.format(r=RADIUS, p="item_", c="item_print"))))
    sizes = (F.size("window") >= F.size("item") * similarity) & (F.size("item") >= F.size("window") * similarity)
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    pairs = windows.join(known, (F.col("block") == F.col("item_block")) & (F.col("value") == F.col("item_value")) & sizes & near)
    pairs = pairs.groupBy("doc_id", "start", "item_id", "window", "item").agg(F.count(F.lit(1)).alias("blocks"))
    pairs = pairs.withColumn("similarity", weighted_similarity("window", "item")).filter(F.col("similarity") >= similarity)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.count_distinct("start").alias("n_windows"))
