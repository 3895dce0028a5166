"""Lexicons, auxiliary word tables and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DUMP_SCHEMA = "word string, tags array<string>, sounds array<struct<ipa:string,tags:array<string>>>"


def read_tsv(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, schema: str | None = None) -> DataFrame:
    """A table bound by header names, without quoting."""
    reader = spark.read.option("sep", sep).option("header", header).option("quote", "").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``ortho, phon, lemme, h_aspire, rank``: rank is the position in the file."""
    raw = read_tsv(spark, path).select(
        "ortho", F.coalesce("phon", F.lit("")).alias("phon"), F.coalesce("lemme", F.lit("")).alias("lemme"),
        "h_aspire", F.col("_metadata.file_block_start").alias("_b"),
    )
    flag = F.when(F.col("h_aspire") == "t", True).when(F.col("h_aspire") == "f", False).otherwise(
        F.raise_error(F.concat(F.lit("unknown value of h_aspire: "), F.coalesce("h_aspire", F.lit("")))).cast("boolean")
    )
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select("ortho", "phon", "lemme", flag.alias("h_aspire"), (F.col("_b") * (1 << 20) + row).alias("rank"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, word, tags, sounds`` from JSON lines in the order of files, blocks and rows; other lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("r")
    lines = lines.select("value", F.struct("f", "b", row).alias("line_no")).filter(F.startswith("value", F.lit("{")))
    return lines.select("line_no", F.from_json("value", DUMP_SCHEMA).alias("j")).select("line_no", "j.*")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``word, count`` separated by a space."""
    return read_tsv(spark, path, sep=" ", header=False, schema="word string, count bigint")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An auxiliary table with a header and ordinary CSV quoting; every column text."""
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)
