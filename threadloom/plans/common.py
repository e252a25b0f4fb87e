"""Table access and SQL prefixes shared by the query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators import comments as C
from threadloom.session import table


def dump(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return C.latest(table(spark, d, "comments"), *more)


def narrow(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Distinct comments without texts and names."""
    return C.latest(table(spark, d, "comments"), *more, columns=["subreddit", "score", "controversiality"])


#: Distinct comments as SQL.
SQL_C = """c AS (
  SELECT *, regexp_replace(parent_id, '^[^_]*_', '') AS parent_key, regexp_replace(link_id, '^[^_]*_', '') AS link_key,
    lpad(CAST(coalesce(created_utc, 0) AS VARCHAR), 12, '0') || ':' || id AS ord
  FROM comments WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY _source_file DESC NULLS LAST, score DESC NULLS LAST, created_utc DESC NULLS LAST, controversiality DESC NULLS LAST) = 1)"""
SQL_W = "w AS (SELECT c.*, coalesce(k.n, 0) AS width FROM c LEFT JOIN (SELECT parent_key, count(*) AS n FROM c WHERE parent_key IS NOT NULL GROUP BY 1) k ON k.parent_key = c.id)"
SQL_F = """f AS (
  SELECT id, id AS root_id, 0 AS depth, [ord] AS path FROM c WHERE parent_key IS NULL OR parent_key NOT IN (SELECT id FROM c)
  UNION ALL SELECT c.id, f.root_id, f.depth + 1, list_append(f.path, c.ord) FROM c JOIN f ON c.parent_key = f.id)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


def sql_hash(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT)"
