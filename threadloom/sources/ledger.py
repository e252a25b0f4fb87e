"""Restart ledgers, resumable output and cached side tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where nothing is written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def todo(inputs: DataFrame, ledger: DataFrame | None, key: str) -> DataFrame:
    """Inputs that the ledger does not name."""
    return inputs if ledger is None else inputs.join(ledger.select(key).distinct(), key, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def resumed(inputs: DataFrame, path: str, key: str, work) -> DataFrame:
    """Run ``work`` on what ``path`` lacks, append it, and return all of it."""
    spark = inputs.sparkSession
    append(work(todo(inputs, read_or_none(spark, path), key)), path)
    return spark.read.parquet(path)


def cached_vectors(texts: DataFrame, path: str, encode) -> DataFrame:
    """Side table ``key, vector`` of texts by the SHA-1 of their first 1,000 characters; only missing keys are encoded.

    ``encode`` maps a DataFrame ``key, text`` to ``key, vector``.
    """
    keyed = texts.select(F.sha1(F.substring(F.coalesce("text", F.lit("")), 1, 1000)).alias("key"), "text").dropDuplicates(["key"])
    return resumed(keyed, path, "key", encode)
