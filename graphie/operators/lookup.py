"""Hash lookup of a small keyed table from inside an array expression.

A join needs one row per word, so rewriting a text through a join means
exploding the corpus and shuffling it back together. A keyed table whose size
has been checked can instead travel with the plan: an array of small maps,
addressed by the hash of the key. ``get(array, hash)`` is O(1) and each map holds
about one entry, so a lookup costs the same for ten entries or a million, stays in
the JVM, and the corpus is read once with no shuffle at all.

The array is the result of an uncorrelated scalar subquery: Spark computes it once and
hands tasks the row format itself, one flat block of bytes with nothing to rebuild.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphie.functions.plan import computed_once
from graphie.sources.files import stored

Find = Callable[[Column], Column]
MAX_ROWS = 1_000_000
MAX_BYTES = 48 << 20


def fits(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """True when the table may be sent to every task. One aggregate, no collect."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and b <= max_bytes


def bounded_rows(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list | None:
    """The rows of a table whose size has been checked first, or None.

    The table is kept between the check and the read so that it is computed once.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return kept.collect() if fits(kept, max_rows, max_bytes) else None
    finally:
        kept.unpersist()


class Lookup:
    """``key -> value`` for use in a column of a DataFrame: see ``with_lookups``."""

    def __init__(self, table: DataFrame, buckets: int):
        self.table = table
        self.buckets = buckets

    def finder(self, table: Column) -> Find:
        n = F.lit(self.buckets)
        return lambda k: F.try_element_at(F.get(table, F.pmod(F.hash(k), n)), k)


class RowLookup:
    """``key -> value`` from a map that each row carries for itself, after a constant of its commonest keys: see ``row_lookup``."""

    def __init__(self, column: str, head: Lookup | None):
        self.column = column
        self.head = head

    def finder(self, table: Column | None) -> Find:
        own = lambda k: F.try_element_at(F.col(self.column), k)
        if table is None:
            return own
        common = self.head.finder(table)
        return lambda k: F.coalesce(common(k), own(k))


def with_lookups(df: DataFrame, lookups: list[Lookup | RowLookup], name: str, build: Callable[..., Column]) -> DataFrame:
    """Add column ``name = build(find, ...)``, one ``find`` per lookup.

    Each table is bound once, as a lambda variable, however often ``find`` is used.
    The subquery stands in a projection of its own, which the optimizer merges into the
    one that uses it (a single reference), so no row ever carries the table. The marker
    below keeps that projection from being merged downwards instead, with columns that
    could not be moved up again.
    """
    cols = [F.col(c) for c in df.columns if c != name]
    constants = [x.head if isinstance(x, RowLookup) else x for x in lookups]
    tables = {i: f"_lookup{i}" for i, x in enumerate(constants) if x is not None}

    def bind(i: int, finds: list[Find]) -> Column:
        if i == len(lookups):
            return build(*finds)
        if i not in tables:
            return bind(i + 1, finds + [lookups[i].finder(None)])
        return F.get(
            F.transform(F.array(tables[i]), lambda t: bind(i + 1, finds + [lookups[i].finder(t)])), F.lit(0)
        )

    if not tables:
        return df.select(*cols, bind(0, []).alias(name))
    marked = df.withColumn("_row", computed_once(F.lit(True)))
    inner = marked.select("*", *[constants[i].table.scalar().alias(t) for i, t in tables.items()])
    return inner.select(*cols, F.when(F.col("_row"), bind(0, [])).alias(name))


HEAD_WORDS, HEAD_ROWS = 10_000, 100_000


def row_lookup(
    df: DataFrame, row_key: list[str], asked: Column, table: DataFrame, key: str, value: str | list[str], column: str
) -> tuple[DataFrame, RowLookup]:
    """``df`` with a map of what its rows can look up in a table of any size, and the lookup on it.

    ``asked`` are all keys a row may ask for. Each is counted over the rows first. A key that more than
    ``HEAD_ROWS`` rows ask for, and more than one in ``HEAD_WORDS`` of all questions, would be a hot key of
    the join; there are at most ``HEAD_WORDS`` such keys, so they travel as a constant. The rest is joined,
    and no task gets more than that many rows of one key. Rows that share a row key share their map.
    """
    values = [value] if isinstance(value, str) else list(value)
    packed = F.col(value) if isinstance(value, str) else F.struct(*values)
    entries = table.filter(F.length(key) > 0).select(F.col(key).alias("_k"), *values)
    questions = df.select(*row_key, F.explode(F.array_distinct(asked)).alias("_k"))
    known = stored(questions.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).join(entries, "_k"), "entries")
    most = max(HEAD_ROWS, (known.agg(F.sum("_n")).first()[0] or 0) // HEAD_WORDS)
    common = known.filter(F.col("_n") > most)
    head = None if common.isEmpty() else constant_lookup(common, "_k", value, max_rows=HEAD_WORDS)
    tail = known if head is None else known.filter(F.col("_n") <= most)
    own = F.map_from_entries(F.collect_set(F.struct("_k", packed.alias("_v")))).alias(column)
    names = [f"_key{i}" for i in range(len(row_key))]
    maps = questions.join(tail, "_k").groupBy(*row_key).agg(own).toDF(*names, column)
    same = F.lit(True)
    for k, n in zip(row_key, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(maps, same, "left").drop(*names), RowLookup(column, head)


def constant_lookup(
    df: DataFrame, key: str, value: str | list[str], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> Lookup | None:
    """``key -> value`` (or a struct of values).

    ``None`` when the table is over the bound: the caller then joins. Keys must be
    unique; empty and null keys are dropped.
    """
    cols = [value] if isinstance(value, str) else list(value)
    types = dict(df.dtypes)
    kind = types[value] if isinstance(value, str) else (
        "struct<" + ",".join(f"{c}:{types[c]}" for c in cols) + ">"
    )
    packed = F.col(value) if isinstance(value, str) else F.struct(*cols)
    small = df.filter(F.length(key) > 0).select(
        F.hash(key).alias("h"), F.col(key).alias("k"), F.to_json(F.struct(packed.alias("v"))).alias("v")
    )
    rows = bounded_rows(small, max_rows, max_bytes)
    if rows is None:
        return None
    n = 1
    while n < 2 * len(rows):
        n *= 2
    buckets: list[dict] = [{} for _ in range(n)]
    for h, k, v in rows:
        buckets[h % n][k] = json.loads(v).get("v")
    text = pa.table({"j": [json.dumps(buckets, ensure_ascii=False)]})
    one_row = df.sparkSession.createDataFrame(text)
    return Lookup(one_row.select(F.from_json("j", f"array<map<string,{kind}>>").alias("t")), n)
