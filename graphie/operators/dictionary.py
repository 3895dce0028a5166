"""Dictionaries ``old -> new``: metadata, merging, compression, comparison."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNSET: Any = object()


@dataclass(frozen=True)
class Metadata:
    """``plurals_in_s``: UNSET, None (no inference) or the marker added after a plural."""

    desc: str | None = None
    lang: str | None = None
    supports_repeated_rewrites: bool | None = None
    plurals_in_s: Any = UNSET

    @staticmethod
    def from_json_object(obj: dict) -> "Metadata":
        m = Metadata()
        if isinstance(obj.get("desc"), str):
            m = replace(m, desc=obj["desc"])
        if isinstance(obj.get("lang"), str):
            m = replace(m, lang=obj["lang"])
        if isinstance(obj.get("supports_repeated_rewrites"), bool):
            m = replace(m, supports_repeated_rewrites=obj["supports_repeated_rewrites"])
        p = obj.get("plurals_in_s")
        if isinstance(p, bool):
            m = replace(m, plurals_in_s="s" if p else None)
        elif isinstance(p, str):
            m = replace(m, plurals_in_s=p)
        return m

    def to_json_object(self) -> dict:
        out: dict = {}
        if self.desc is not None:
            out["desc"] = self.desc
        if self.lang is not None:
            out["lang"] = self.lang
        if self.supports_repeated_rewrites is not None:
            out["supports_repeated_rewrites"] = self.supports_repeated_rewrites
        if self.plurals_in_s is not UNSET:
            p = self.plurals_in_s
            out["plurals_in_s"] = False if p is None else True if p == "s" else p
        return out

    def merged_with(self, right: "Metadata") -> "Metadata":
        def pick(a, b, empty):
            return a if b is empty else b

        return Metadata(
            pick(self.desc, right.desc, None),
            pick(self.lang, right.lang, None),
            pick(self.supports_repeated_rewrites, right.supports_repeated_rewrites, None),
            pick(self.plurals_in_s, right.plurals_in_s, UNSET),
        )

    def marker(self, default: str | None = "s") -> str | None:
        return default if self.plurals_in_s is UNSET else self.plurals_in_s


@dataclass(frozen=True)
class Dictionary:
    """``df(old, new)`` with unique ``old``; ``new = ''`` means leave alone."""

    df: DataFrame
    meta: Metadata = field(default_factory=Metadata)

    @staticmethod
    def of(spark: SparkSession, entries: dict[str, str], **meta) -> "Dictionary":
        rows = pa.table({"old": list(entries), "new": list(entries.values())})
        df = spark.createDataFrame(rows)
        return Dictionary(df, Metadata(**meta))


def first_wins(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """One row per key: the one with the smallest ``order``."""
    best = F.min_by(F.struct(*cols), F.col(order)).alias("_b")
    return df.groupBy(key).agg(best, F.min(order).alias(order)).select(
        key, *[F.col(f"_b.{c}").alias(c) for c in cols], order
    )


def last_wins(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    best = F.max_by(F.struct(*cols), F.col(order)).alias("_b")
    return df.groupBy(key).agg(best, F.max(order).alias(order)).select(
        key, *[F.col(f"_b.{c}").alias(c) for c in cols], order
    )


def merge_dictionaries(left: Dictionary, right: Dictionary) -> Dictionary:
    """Lookups prefer ``right``; metadata is merged field by field, right first."""
    r = right.df.select("old", F.col("new").alias("_new"))
    df = left.df.select("old", "new").join(r, "old", "full_outer").select(
        "old", F.coalesce("_new", "new").alias("new")
    )
    return Dictionary(df, left.meta.merged_with(right.meta))


def with_stop_entries(d: Dictionary, stops: list[str]) -> Dictionary:
    """Append entries that protect words, such as proper nouns, from any change.

    Appended lines come last, so they replace an earlier entry of the same word.
    """
    spark = d.df.sparkSession
    s = spark.createDataFrame([(w,) for w in stops], "old string").distinct()
    kept = d.df.select("old", "new").join(s, "old", "left_anti")
    return Dictionary(kept.unionByName(s.withColumn("new", F.lit(""))), d.meta)


def expand_ligatures(df: DataFrame) -> DataFrame:
    """Add, for words with œ or æ, the spelling in two letters, unless it is an identity."""
    old2 = F.replace(F.replace("old", F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    extra = (
        df.select(old2.alias("old2"), "old", "new")
        .filter((F.col("old2") != F.col("old")) & (F.col("old2") != F.col("new")))
        .select(F.col("old2").alias("old"), "new")
    )
    return df.select("old", "new").unionByName(extra)


def clean_fields(df: DataFrame) -> DataFrame:
    """Drop quotes and ``(comments)``, then keep distinct pairs."""

    def tidy(c: str) -> Column:
        return F.regexp_replace(F.replace(c, F.lit('"')), r" *\([^)]*\)", "").alias(c)

    return df.select(tidy("old"), tidy("new")).distinct()


def exclude(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """Drop rows where a ``like`` pattern matches: ``patterns(field, pattern)``.

    Whole words are left out by an anti-join, however many there are. Only patterns with
    ``%``, ``_`` or an escape, which are written by hand, become a disjunction on the scan.
    ASCII case is ignored, other letters are exact, as in the source scripts.
    """
    rows = patterns.select("field", "pattern", F.col("pattern").rlike(r"[%_\\]").alias("wild")).filter("pattern IS NOT NULL")
    hit = F.lit(False)
    for fieldname, pattern, _ in rows.filter("wild").collect():
        hit = hit | F.coalesce(like_ascii(F.col(fieldname), pattern), F.lit(False))
    out = df.filter((F.col("old") != "") & ~hit)
    exact = rows.filter("NOT wild")
    for (fieldname,) in exact.select("field").distinct().collect():
        words = exact.filter(F.col("field") == fieldname).select(fold_ascii(F.col("pattern")).alias("_word")).distinct()
        out = out.join(words, fold_ascii(F.col(fieldname)) == F.col("_word"), "left_anti")
    return out


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(col: Column) -> Column:
    return F.translate(col, _UP, _UP.lower())


def like_ascii(col: Column, pattern: str) -> Column:
    """``like`` that folds ASCII letters only."""
    fold = str.maketrans(_UP, _UP.lower())
    return fold_ascii(col).like(pattern.translate(fold))


def simplify_mapping(df: DataFrame, marker: str | None) -> DataFrame:
    """Drop identities and plurals that the singular already implies.

    Whether a plural is kept depends on whether its singular is, which depends on
    *its* singular: words that differ only by trailing s form a chain. All links of
    a chain share a stem, so one shuffle on the stem brings a chain together (as
    many rows as the longest run of s) and a fold decides it from the short end.
    Kept identities are written as ''.
    """
    extra = [c for c in df.columns if c not in ("old", "new")]
    if marker is None:
        return df.filter(F.col("old") != F.col("new"))
    stem = F.regexp_replace("old", "s+$", "")
    chains = (
        df.withColumn("_stem", stem)
        .withColumn("_k", F.length("old") - F.length("_stem"))
        .groupBy("_stem")
        .agg(F.array_sort(F.collect_list(F.struct("_k", "old", "new", *extra))).alias("rows"))
    )
    m = F.lit(marker)

    def decide(acc: Column, r: Column) -> Column:
        prev = F.try_element_at(acc, F.lit(-1))
        is_id = r["old"] == r["new"]
        adjacent = F.coalesce(prev["r"]["_k"] == r["_k"] - 1, F.lit(False))
        ends = F.endswith(r["new"], m)
        implied = prev["r"]["new"] == F.substr(r["new"], F.lit(1), F.length(r["new"]) - F.length(m))
        keep = (
            F.when(~(adjacent & ends), ~is_id)
            .when(implied, ~prev["keep"] & ~is_id)
            .otherwise(F.lit(True))
        )
        return F.concat(acc, F.array(F.struct(r.alias("r"), keep.alias("keep"))))

    fields = ["_k int", "old string", "new string"] + [f"{c} {dict(df.dtypes)[c]}" for c in extra]
    inner = ",".join(f.replace(" ", ":", 1) for f in fields)
    start = F.from_json(F.lit("[]"), f"array<struct<r:struct<{inner}>,keep:boolean>>")
    # A chain of one row, by far the most common, needs no fold.
    single = F.size("rows") == 1
    lone = F.element_at("rows", 1)
    decided = F.when(
        single, F.array(F.struct(lone.alias("r"), (lone["old"] != lone["new"]).alias("keep")))
    ).otherwise(F.aggregate("rows", start, decide))
    return (
        chains.select(F.explode(decided).alias("x"))
        .filter("x.keep")
        .select(
            F.col("x.r.old").alias("old"),
            F.when(F.col("x.r.old") == F.col("x.r.new"), "").otherwise(F.col("x.r.new")).alias("new"),
            *[F.col(f"x.r.{c}").alias(c) for c in extra],
        )
    )


def diff_dictionaries(before: DataFrame, after: DataFrame) -> DataFrame:
    """``old, before, after, change`` for every entry that is not the same on both sides."""
    a = before.select("old", F.col("new").alias("before"))
    b = after.select("old", F.col("new").alias("after"))
    return (
        a.join(b, "old", "full_outer")
        .filter(~F.col("before").eqNullSafe(F.col("after")))
        .withColumn(
            "change",
            F.when(F.col("before").isNull(), "added")
            .when(F.col("after").isNull(), "removed")
            .otherwise("changed"),
        )
    )


def disagreements(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """Words that both sides rewrite, differently."""
    g = generated.select("old", F.col("new").alias("generated"))
    r = reference.select("old", F.col("new").alias("reference"))
    return r.join(g, "old").filter(F.col("reference") != F.col("generated")).orderBy("old")


def chained_entries(df: DataFrame) -> DataFrame:
    """Entries whose result is rewritten again: a second pass would change the text.

    An empty result means the dictionary may be applied to its own output.
    """
    a = df.filter((F.col("new") != "") & (F.col("old") != F.col("new")))
    b = a.select(F.col("old").alias("new"), F.col("new").alias("then"))
    return a.select("old", "new").join(b, "new").select("old", "new", "then")


def collision_words(d: DataFrame, foreign: DataFrame, ignore: list[str] = []) -> DataFrame:
    """Entries that could rewrite a foreign word, directly or through their plural."""
    forms = d.select(
        F.col("old").alias("entry"), F.explode(F.array("old", F.concat("old", F.lit("s")))).alias("word")
    )
    f = foreign.select("word").distinct()
    if ignore:
        f = f.filter(~F.col("word").isin(ignore))
    return forms.join(f, "word", "left_semi").select("entry").distinct()


def register_lookup(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Make a dictionary a SQL function: ``name(word)`` is its entry or null.

    ``name_entries(word)`` is the same as a table function, for a lateral join. Both are SQL functions
    over the table, so a call is planned as a join with it, of any size.
    """
    df.select("old", "new").createOrReplaceTempView(f"{name}_table")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(w STRING) RETURNS STRING RETURN (SELECT max(new) FROM {name}_table WHERE old = w)")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_entries(w STRING) RETURNS TABLE (old STRING, new STRING) "
        f"RETURN SELECT old, new FROM {name}_table WHERE old = w"
    )
