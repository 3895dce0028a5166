"""Dictionary and word-list files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphie.operators import lexicon as X
from graphie.operators.dictionary import Dictionary, Metadata, first_wins, last_wins


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, line_no`` of the text files of a path: increasing in the order of file names, blocks and rows."""
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("r")
    return df.select("value", F.struct("f", "b", row).alias("line_no"))


def _pair(value: str, message: str) -> tuple[Column, Column, Column]:
    parts = F.split(value, ",", -1)
    bad = F.raise_error(F.concat(F.lit(message), F.col(value)))
    ok = F.when(F.size(parts) == 2, True).otherwise(bad.cast("boolean"))
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), ok


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """``old,new`` lines after an optional JSON line. The last definition of a word wins;
    a line without exactly two fields is an error."""
    lines = _lines(spark, path)
    head = lines.agg(F.min(F.struct("line_no", "value")).alias("h")).first().h
    has_meta = head is not None and head.value.startswith("{")
    meta = Metadata.from_json_object(json.loads(head.value)) if has_meta else Metadata()
    old, new, ok = _pair("value", "didn't get exactly 2 items in line ")
    body = lines
    if has_meta:
        first = head.line_no
        body = lines.filter(~((F.col("line_no.f") == first.f) & (F.col("line_no.b") == first.b) & (F.col("line_no.r") == first.r)))
    pairs = body.filter(ok).select(old.alias("old"), new.alias("new"), "line_no")
    return Dictionary(last_wins(pairs, "old", "line_no", "new").select("old", "new"), meta)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """``old,new`` lines without a header. The first definition of a word wins."""
    old, new, ok = _pair("value", "bad line ")
    pairs = _lines(spark, path).filter(ok).select(old.alias("old"), new.alias("new"), "line_no")
    return first_wins(pairs, "old", "line_no", "new").select("old", "new")


def dictionary_lines(df: DataFrame, meta: Metadata | None, all_words: bool = False) -> DataFrame:
    """``section, rank, old, line``: the lines of a dictionary file, by rank and word.

    ``all_words`` leaves out the metadata and marks each entry M (modified) or =.
    """
    line = F.concat_ws(",", "old", "new")
    if all_words:
        mark = F.when(F.col("old") == F.col("new"), "=").otherwise("M")
        line = F.concat_ws(",", "old", "new", mark)
    body = df.select(F.lit(1).alias("section"), F.col("rank").cast("bigint").alias("rank"), "old", line.alias("line"))
    if all_words or meta is None:
        return body
    text = json.dumps(meta.to_json_object(), ensure_ascii=False, separators=(",", ":"))
    head = df.sparkSession.createDataFrame([(0, 0, "", text)], "section int, rank bigint, old string, line string")
    return head.unionByName(body)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of text files, counted from 1 over all of them: for lists that people read."""
    return X.numbered(_lines(spark, path).select(F.col("value").alias("line"), "line_no"), [F.col("line_no")], "n").select(
        F.col("n").alias("line_no"), "line"
    )


def _write_in_order(lines: DataFrame, order: list[str], path: str) -> None:
    """Lines in text files whose names are in the order of the lines; no task sees them all."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_dictionary(df: DataFrame, meta: Metadata | None, path: str, all_words: bool = False) -> None:
    """A folder of text files, in rank order over all of them; the metadata line begins the first."""
    _write_in_order(dictionary_lines(df, meta, all_words), ["section", "rank", "old"], path)


def write_keyboard_list(words: DataFrame, path: str) -> None:
    """Tab-separated shortcut, word, language under the two header lines of the format."""
    head = words.sparkSession.createDataFrame(
        [(0, "", "# Gboard Dictionary version:1"), (1, "", "")], "section int, new string, line string"
    )
    body = words.select(F.lit(2).alias("section"), "new", F.concat_ws("\t", "shortcut", "new", "lang").alias("line"))
    _write_in_order(head.unionByName(body), ["section", "new"], path)
