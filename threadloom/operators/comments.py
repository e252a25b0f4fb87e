"""The comment dump as a table of distinct comments, and parent-child operators on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import bare_id, ordinal

DUMP_COLUMNS = [
    "id", "parent_id", "link_id", "subreddit", "author", "body", "score", "controversiality", "created_utc",
    "distinguished", "edited", "author_flair_text", "gilded", "stickied", "_source_file",
]
#: The projection the pipeline works on.
CORE_COLUMNS = DUMP_COLUMNS[:9]
_PICK = ["_source_file", "score", "created_utc", "controversiality", "edited", "gilded", "author_flair_text", "distinguished", "stickied", "parent_id", "link_id", "subreddit", "author", "body"]


def latest(comments: DataFrame, *more: str, columns: list[str] | None = None) -> DataFrame:
    """One row per id, the greatest by source file, then score and the rest; nulls lose.

    Ids repeat where a dump was read twice; every row counting once keeps widths right. A struct
    maximum combines before the shuffle, so a much repeated id costs one row per task. The struct
    holds what decides and ``columns`` (all of the core ones if not given): texts stay out of the
    shuffle where nobody asks for them. Adds ``parent_key``, ``link_key`` and ``ord``, the order among
    siblings. Rows without id are dropped.
    """
    keep = [c for c in dict.fromkeys([*(CORE_COLUMNS if columns is None else ["parent_id", "link_id", "created_utc", *columns]), *more]) if c != "id"]
    order = [c for c in _PICK if c in keep or c in _PICK[:4]]
    best = comments.filter("id is not null").groupBy("id").agg(F.max(F.struct(*order)).alias("r"))
    out = best.select("id", *[F.col(f"r.{c}").alias(c) for c in keep])
    return out.withColumns({"parent_key": bare_id(F.col("parent_id")), "link_key": bare_id(F.col("link_id")), "ord": ordinal(F.col("created_utc"), F.col("id"))})


def with_parent(c: DataFrame) -> DataFrame:
    """Parent lookup: ``c`` plus ``has_parent``; a parent outside the table, or none, makes a root."""
    ids = c.select(F.col("id").alias("parent_key"), F.lit(True).alias("has_parent"))
    return c.join(ids, "parent_key", "left").withColumn("has_parent", F.coalesce("has_parent", F.lit(False)))


def orphans(c: DataFrame) -> DataFrame:
    """Comments whose parent is a comment that the table lacks."""
    return c.filter(F.col("parent_id").startswith("t1_")).join(c.select(F.col("id").alias("parent_key")), "parent_key", "left_anti")


def child_counts(c: DataFrame) -> DataFrame:
    """``id, width`` for comments with children."""
    return c.filter("parent_key is not null").groupBy(F.col("parent_key").alias("id")).agg(F.count("*").alias("width"))


def with_width(c: DataFrame) -> DataFrame:
    """``c`` plus ``width``, its number of direct children (0 without)."""
    return c.join(child_counts(c), "id", "left").withColumn("width", F.coalesce("width", F.lit(0)))
