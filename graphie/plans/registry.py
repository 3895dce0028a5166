"""Each registered query has a name, a Spark form and, where SQL can say it, a twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphie.functions import text as T
from graphie.operators.dictionary import Dictionary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


SPREAD_BELOW = 16 << 20  # bytes per core


def table(spark: SparkSession, sf: str, name: str, spread: str | None = None) -> DataFrame:
    """A given table. ``spread`` names a key to redistribute a *small* table by.

    A scan has at most one task per row group, and a small file is one row group: all
    the text work would run on one core. Below a size where every core would have a
    decent share anyway, rows are spread first; larger tables are read as they are,
    with no shuffle.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread is not None and 0 < _size(df) < cores * SPREAD_BELOW:
        return df.repartition(cores, spread)
    return df


def _size(df: DataFrame) -> int:
    """Catalyst's size estimate: for a file scan, the bytes of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def documents(spark, sf, *cols: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id").select(*(cols or ("*",)))


# --- inputs shared by many queries, with their SQL -------------------------------

WORD_SQL = T.WORD.replace("++", "+").replace("*+", "*")

SMOKE_DICTIONARY = {
    "pour": "pur", "avec": "avèc", "eau": "ô", "que": "qe", "qui": "qi", "dans": "dan",
    "sur": "sûr", "est": "", "pas": "pa", "elle": "ele", "Les": "", "une": "unne",
}


def values_sql(name: str, cols: str, rows) -> str:
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


SMOKE_SQL = values_sql("d", "old, new", SMOKE_DICTIONARY.items())


def smoke_dictionary(spark: SparkSession) -> Dictionary:
    return Dictionary.of(spark, SMOKE_DICTIONARY, lang="fr", plurals_in_s="s")


VOCAB_SQL = f"""
tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{WORD_SQL}')) AS w FROM documents),
vocab AS MATERIALIZED (SELECT lower(w) AS word, count(*) AS n FROM tok GROUP BY 1)"""


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """``word, n``: lower-cased words of the documents with their counts."""
    return (
        documents(spark, sf, "doc_id", "text")
        .select(F.explode(T.words("text")).alias("w"))
        .groupBy(F.lower("w").alias("word"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Pseudo-phonetics for words of invented prose: longest graphemes first.
_SOUNDS = [
    ("eaux", "o"), ("eau", "o"), ("aux", "o"), ("au", "o"), ("oi", "wa"), ("ou", "u"), ("ch", "S"),
    ("qu", "k"), ("en", "@"), ("an", "@"), ("on", "§"), ("ai", "E"), ("è", "E"), ("ê", "E"), ("é", "e"),
    ("ç", "s"),
]


def sound(col):
    c = F.col(col) if isinstance(col, str) else col
    for a, b in _SOUNDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sound_sql(expr: str) -> str:
    for a, b in _SOUNDS:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


LEXICON_SQL = f"""{VOCAB_SQL},
lexicon AS MATERIALIZED (SELECT word AS ortho, {sound_sql('word')} AS phon,
  regexp_replace(word, 's$', '') AS lemme, n AS freq,
  row_number() OVER (ORDER BY n DESC, word) AS rank FROM vocab)"""


def lexicon(spark: SparkSession, sf: str, words: DataFrame | None = None) -> DataFrame:
    """``ortho, phon, lemme, freq`` derived from the vocabulary."""
    return (vocabulary(spark, sf) if words is None else words).select(
        F.col("word").alias("ortho"),
        sound("word").alias("phon"),
        F.regexp_replace("word", "s$", "").alias("lemme"),
        F.col("n").alias("freq"),
    )


# Two dictionaries over the vocabulary that overlap and disagree.
DICTS_SQL = f"""{VOCAB_SQL},
d1 AS (SELECT word AS old, replace(word, 'eau', 'ô') AS new FROM vocab WHERE contains(word, 'eau')),
d2 AS (SELECT word AS old, replace(replace(word, 'que', 'qe'), 'eau', 'o') AS new FROM vocab WHERE contains(word, 'que'))"""


def dict_eau(spark, sf) -> DataFrame:
    return vocabulary(spark, sf).filter(F.contains("word", F.lit("eau"))).select(
        F.col("word").alias("old"), F.replace("word", F.lit("eau"), F.lit("ô")).alias("new")
    )


def dict_que(spark, sf) -> DataFrame:
    return vocabulary(spark, sf).filter(F.contains("word", F.lit("que"))).select(
        F.col("word").alias("old"),
        F.replace(F.replace("word", F.lit("que"), F.lit("qe")), F.lit("eau"), F.lit("o")).alias("new"),
    )
