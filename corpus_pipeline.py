"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Every stage is written as Parquet to the shared folder and read again. Columns stay those of
``documents``; the last stage adds ``copies``, how often the mix reads a document.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphie.llm import decontamination, jaccard_join, mixing, private, toxicity
from graphie.llm.shared import fold_of, shared_folder, table

TOXIC_FROM = 0.3
NEAR_GRAM, NEAR_FROM = 5, (80, 100)  # near copies: word 5-grams, Jaccard similarity of 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_FROM``. The tagger learns from the labelled rows of the given documents."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2)
    columns = docs.columns
    scored = toxicity.score_toxicity(docs, model, keep=tuple(columns))
    return scored.filter(F.col("score") < TOXIC_FROM).select(*[F.col(f"`{c}`") for c in columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their word 5-grams, the one with the smallest id."""
    return jaccard_join.first_of_each(docs, gram=NEAR_GRAM, needed=NEAR_FROM)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_found"), "left_anti")


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for private data in the text; ``n_chars`` follows the new text."""
    done = private.anonymise(docs, private.collision_salts(docs)).drop("entities")
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often."""
    return mixing.mix_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Stage) -> Stage:
    """The stage on a table whose other columns have names that no stage uses; they get their own back.

    A column that the stage itself adds replaces one of that name.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c if c in OWN else f"other_column_{i}": c for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*names), sf_dir)
        added = [c for c in out.columns if c not in names]
        kept = [c for c in out.columns if c in names and names[c] not in added]
        return out.select(*kept, *added).toDF(*[names[c] for c in kept], *added)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", apart(drop_toxic)),
    ("jaccard_join", apart(drop_near_copies)),
    ("decontamination", apart(drop_benchmark)),
    ("private_surrogates", apart(replace_private)),
    ("mix_sources", apart(mix_sources)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}") + "/t"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
