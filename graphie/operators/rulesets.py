"""Rule sets as tables: parsing, ordering, combined properties, plain rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Where a named rule runs relative to the others (0 when absent).
RANKS = {
    "emment/ament": -3, "qua-o-u/ca-o-u": -2, "que/c": -2, "qu/q": -1, "qu/qou": -1, "accent-plat": 1, "ou/omega": 2,
}
# Rules that must not see their own output, and their plural markers.
NOT_REPEATABLE = ["sound-net", "alfonic"]
MARKERS = {"sound-net": "+", "alfonic": ""}
LOOKUP_RULES = ["oe", "1990"]
DEFAULT_RULES = ["flagship", "1990", "oe"]


def parse_custom_rules(specs: DataFrame, key: str, spec: str) -> DataFrame:
    """``key, step, target, repl, kind`` from texts like ``'eaux/ôs é/E'``.

    ``kind`` is ``accent`` when the result holds exactly one E, to be written é or è
    by its syllable. Texts and numbers of rules have no limit.
    """
    steps = F.filter(F.split(F.col(spec), " "), lambda p: F.instr(p, "/") > 1)
    at = F.instr("p", "/")
    e = F.length("repl") - F.length(F.replace("repl", F.lit("E"), F.lit("")))
    return (
        specs.select(key, F.posexplode(steps).alias("i", "p"))
        .select(key, (F.col("i") + 1).alias("step"), F.substr("p", F.lit(1), at - 1).alias("target"), F.substr("p", at + 1).alias("repl"))
        .withColumn("kind", F.when(e == 1, "accent").otherwise("text"))
    )


def rank_of(name: Column) -> Column:
    r = F.lit(0)
    for rule, rank in RANKS.items():
        r = F.when(name == rule, rank).otherwise(r)
    return r


def order_rules(rules: DataFrame, key: str = "ruleset") -> DataFrame:
    """Add ``step``: by rank, then as given (``pos``). Rule sets are a handful of rows."""
    w = W.partitionBy(key).orderBy(rank_of(F.col("name")), "pos")
    return rules.withColumn("step", F.row_number().over(w))


def interpret_rules(rules: DataFrame, key: str = "ruleset") -> DataFrame:
    """One row per rule set ``(ruleset, name, pos)``: ``desc, lang,
    supports_repeated_rewrites, marker, oe, rect1990``.

    The plural marker is that of the first rule that has one, and only none or 's' is
    passed on.
    """
    name = F.col("name")
    special = name.isin(list(MARKERS))
    marker = F.lit(None).cast("string")
    for rule, m in MARKERS.items():
        marker = F.when(name == rule, m).otherwise(marker)
    return rules.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list("name")), " ").alias("desc"),
        F.lit("fr").alias("lang"),
        F.bool_and(~name.isin(NOT_REPEATABLE)).alias("supports_repeated_rewrites"),
        F.coalesce(F.min_by(marker, F.when(special, F.col("pos"))), F.lit("s")).alias("_m"),
        F.bool_or(name == "oe").alias("oe"),
        F.bool_or(name == "1990").alias("rect1990"),
    ).withColumn("marker", F.when(F.col("_m") == "s", "s")).drop("_m")


def apply_plain_rules(words: DataFrame, col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules without phonetics: ordered replacements on words that hold any target."""
    hit = F.lit(False)
    new = F.col(col)
    for target, repl in rules:
        hit = hit | F.contains(F.col(col), F.lit(target))
        new = F.replace(new, F.lit(target), F.lit(repl))
    return words.filter(hit).withColumn("new", new)
