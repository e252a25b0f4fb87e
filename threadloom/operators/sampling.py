"""Seeded samples, caps and limits in hash order: exact sizes without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.ids import hash_unit

#: Hash ranges used to find the boundary of an exact sample.
RANGES = 4096


def first_by_hash(df: DataFrame, n: int | Column | None, seed: str, key: str, fraction: float | None = None) -> DataFrame:
    """``df`` plus boolean ``chosen`` for the first ``n`` rows (or ``int(rows * fraction)``) in seeded hash order of ``key``.

    Rows are counted per hash range; ranges beside the boundary are chosen or left whole, without a shuffle, and only
    the rows of the range on the boundary are ranked. Ties go by key; an empty table stays empty.
    """
    h = df.withColumn("_h", hash_unit(seed, F.col(key))).withColumn("_r", F.floor(F.col("_h") / (2**32 // RANGES)).cast("int"))
    sums = h.groupBy("_r").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")
    sums = sums.select("_r", "_n", before.alias("_before"), F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    limit = F.floor(F.col("_all") * F.lit(fraction)) if fraction is not None else (F.lit(n) if isinstance(n, int) else n)
    placed = h.join(F.broadcast(sums), "_r").withColumn("_limit", limit)
    extra = ["_h", "_r", "_before", "_all", "_n", "_limit"]
    edge = (F.col("_before") < F.col("_limit")) & (F.col("_before") + F.col("_n") > F.col("_limit"))
    rank = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)) + F.col("_before")
    clear = placed.filter(~edge).withColumn("chosen", F.col("_before") < F.col("_limit"))
    return clear.unionByName(placed.filter(edge).withColumn("chosen", rank <= F.col("_limit"))).drop(*extra)


def hash_limit(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """Subsample of exactly ``n`` rows (all of a smaller table)."""
    return first_by_hash(df, n, seed, key).filter("chosen").drop("chosen")


def cap_per_group(df: DataFrame, group: list[str], k: int, seed: str, key: str) -> DataFrame:
    """At most ``k`` rows of every group in hash order; the rank limit is applied before the shuffle as well."""
    w = Window.partitionBy(*group).orderBy(hash_unit(seed, F.col(key)), key)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def pps_posts(c: DataFrame, n: int, seed: str) -> DataFrame:
    """``link_key, size``: ``n`` posts without replacement, weight = thread size (exponential keys, smallest first)."""
    sizes = c.filter("link_key is not null").groupBy("link_key").agg(F.count("*").alias("size"))
    u = (hash_unit(seed, F.col("link_key")) + F.lit(0.5)) / F.lit(2.0**32)
    return sizes.withColumn("k", -F.log(u) / F.col("size")).orderBy("k", "link_key").limit(n).select("link_key", "size")


def balanced(df: DataFrame, positive: Column, ratio: float, seed: str, key: str) -> DataFrame:
    """All positives and ``int(positives * ratio)`` negatives in hash order; null counts as negative."""
    marked = df.withColumn("_p", F.coalesce(positive, F.lit(False)))
    n = int(marked.filter("_p").count() * ratio)
    return marked.filter("_p").unionByName(hash_limit(marked.filter("not _p"), n, seed, key)).drop("_p")


def round_robin(df: DataFrame, strata: list[str], month: str, target: int, seed: str, key: str) -> DataFrame:
    """Stratified sample that rotates over the months of a stratum, ``max(1, target // strata)`` each, cut to ``target``.

    A row's turn is its rank within (stratum, month) times the months of the stratum plus the
    month's place; the turn limit ``2 * rows + months`` is the loop guard of the sequential form.
    """
    cells = df.groupBy(*strata, month).agg(F.count("*").alias("n"))
    months = Window.partitionBy(*strata)
    cells = cells.withColumn("months", F.count("*").over(months)).withColumn("at", F.row_number().over(months.orderBy(month)) - 1).withColumn("rows", F.sum("n").over(months))
    quota = max(1, target // max(1, cells.select(*strata).distinct().count()))
    rank = F.row_number().over(Window.partitionBy(*strata, month).orderBy(hash_unit(seed, F.col(key)), key))
    ranked = df.withColumn("rn", rank).filter(F.col("rn") <= quota).join(F.broadcast(cells.drop("n")), [*strata, month])
    turn = ranked.withColumn("turn", (F.col("rn") - 1) * F.col("months") + F.col("at")).filter(F.col("turn") <= 2 * F.col("rows") + F.col("months"))
    first = turn.withColumn("q", F.row_number().over(Window.partitionBy(*strata).orderBy("turn"))).filter(F.col("q") <= quota)
    return hash_limit(first.drop("rn", "months", "at", "rows", "turn", "q"), target, seed + "|cut", key)
