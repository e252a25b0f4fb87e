"""Corpus statistics: manifests, distributions, histograms, several groupings in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GONE = ("[removed]", "[deleted]")


def described(df: DataFrame, cols: list[str]) -> DataFrame:
    """``name, n, mean, median, p90, p99, low, high`` per column, nulls left out; exact, linear percentiles from one pass over value counts."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*").filter("v is not null")
    counts = long.groupBy("name", "v").agg(F.count("*").alias("f"))
    p = lambda q: F.percentile("v", q, F.col("f"))
    return counts.groupBy("name").agg(
        F.sum("f").alias("n"), (F.sum(F.col("v") * F.col("f")) / F.sum("f")).alias("mean"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def manifest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell: comments, distinct posts and authors, share without replies, share controversial (rounded to 4)."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("comments"), F.count_distinct("link_key").alias("posts"), F.count_distinct("author").alias("authors"),
        F.round(F.avg((F.col("width") == 0).cast("double")), 4).alias("width0_frac"), F.round(F.avg((F.coalesce("controversiality", F.lit(0)) == 1).cast("double")), 4).alias("contr_rate"),
    )


def grouped(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Conditional counters for several groupings from one pass; ``level`` is Spark's grouping id."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_if(F.col("controversiality") == 1).alias("contr"), F.count_if(F.col("width") == 0).alias("width0"), F.count_if(F.col("body").isin(*GONE)).alias("gone")
    )


def histogram(df: DataFrame, x: Column, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` over equal bins from ``low`` to ``high``; what lies outside counts in the end bins."""
    b = F.least(F.greatest(F.floor((x - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def month_profile(rows: DataFrame) -> DataFrame:
    """Per month and subreddit: rows, rows with a flag, share of controversial among those (null without)."""
    return rows.groupBy("month", "subreddit").agg(F.count("*").alias("rows"), F.count("controversiality").alias("flagged"), F.round(F.try_divide(F.sum("controversiality").cast("double"), F.count("controversiality")), 6).alias("contr_rate"))
