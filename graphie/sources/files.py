"""Folders of documents, and the shared folder for data a job must write."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphie.operators.segments import document_kind


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, length, content`` of every file of a supported kind."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.withColumn("kind", document_kind("path")).filter("kind is not null")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, only a local session gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"graphie-{name}-")
    return os.path.join(base, f"graphie-{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once and read back, where a plan would compute it repeatedly.

    Files in the shared folder outlive the executors that wrote them.
    """
    path = work_folder(df.sparkSession, name) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
