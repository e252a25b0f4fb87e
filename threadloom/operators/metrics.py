"""Pointwise, ranking and resampling metrics as aggregations.

Undefined values (no rows, constant ranks, only ties) are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.ids import hash_unit
from threadloom.functions.text import months_between
from threadloom.session import staged

#: Rows over which all pairs are compared; larger sets are subsampled to this many in hash order.
PAIR_ROWS = 5000


def scored_rows(predictions: DataFrame) -> DataFrame:
    """One valid row per record: ``record_id, ps, pw, pc, ts, tw, tc``; a null prediction, truth or number skips the row."""
    cols = [F.col(f"{a}.{b}").alias(n) for a, b, n in (("predicted", "score", "ps"), ("predicted", "width", "pw"), ("predicted", "controversiality", "pc"), ("ground_truth", "score", "ts"), ("ground_truth", "width", "tw"), ("ground_truth", "controversiality", "tc"))]
    return predictions.select("record_id", *cols).dropna().dropDuplicates(["record_id"])


def mse(p: Column, t: Column) -> Column:
    return F.avg((p - t).cast("double") * (p - t))


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t).cast("double"))


def f1_macro(p: Column, t: Column) -> Column:
    """Mean F1 of both classes, class 1 where the value is 1; an empty denominator counts 0."""
    n = lambda a, b: F.count_if(((p == 1) == F.lit(a)) & ((t == 1) == F.lit(b)))
    tp, fp, fn, tn = n(True, True), n(True, False), n(False, True), n(False, False)
    f = lambda hit, x, y: F.coalesce(F.try_divide(2.0 * hit, 2.0 * hit + x + y), F.lit(0.0))
    return (f(tp, fp, fn) + f(tn, fn, fp)) / 2


def average_ranks(df: DataFrame, keys: list[str], x: str, rank: str) -> DataFrame:
    """``df`` plus the average rank of ``x`` within ``keys``; equal values share their mean rank.

    Values are counted first, so a window holds distinct values only, whatever the ties. Without keys the
    values are laid on ranges whose sums are added up, so no task sorts more than one range.
    """
    counts = df.groupBy(*keys, x).agg(F.count("*").alias("_n"))
    mean = F.col("_n") / F.lit(2.0) - F.lit(0.5)
    if keys:
        ranks = counts.withColumn(rank, F.sum("_n").over(Window.partitionBy(*keys).orderBy(x)) - mean)
    else:
        parts = staged(counts.repartitionByRange(F.col(x)).withColumn("_p", F.spark_partition_id()), "values")
        sums = parts.groupBy("_p").agg(F.sum("_n").alias("_s"))
        before = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_b"))
        inside = F.sum("_n").over(Window.partitionBy("_p").orderBy(x))
        ranks = parts.join(F.broadcast(before), "_p").withColumn(rank, F.col("_b") + inside - mean).drop("_p", "_b")
    return df.join(ranks.drop("_n"), [*keys, x])


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """``keys, name, n``: rank correlation per group, null below two rows or on a constant side."""
    ranked = average_ranks(average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.nullif(F.stddev_pop("_rx") * F.stddev_pop("_ry"), F.lit(0.0)))
    return ranked.groupBy(*keys).agg(F.when(F.count("*") >= 2, rho).alias(name), F.count("*").alias("n"))


def p_value(spark, rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a rank correlation by Student's t."""
    if rho is None or n < 3 or abs(rho) >= 1:
        return None
    t = rho * ((n - 2) / (1 - rho * rho)) ** 0.5
    return 2 * (1 - spark.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 2)).cumulativeProbability(abs(t)))


def pairwise_accuracy(df: DataFrame, p: str, t: str, name: str = "pairwise_accuracy") -> DataFrame:
    """Share of pairs with untied truth whose predictions are in the same order; a tied prediction is wrong.

    ``df`` holds at most ``PAIR_ROWS`` rows, so one task compares them a row against the rest at a time.
    """

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[p].to_numpy(dtype=float), rows[t].to_numpy(dtype=float)
        good = all_ = 0
        for i in range(len(a) - 1):
            dt = np.sign(b[i + 1 :] - b[i])
            all_ += int((dt != 0).sum())
            good += int(((np.sign(a[i + 1 :] - a[i]) == dt) & (dt != 0)).sum())
        return pd.DataFrame({name: [good / all_ if all_ else None], "n_pairs": [all_]})

    return df.select(F.lit(1).alias("_g"), p, t).groupBy("_g").applyInPandas(run, f"{name} double, n_pairs bigint")


def hurdle(df: DataFrame) -> DataFrame:
    """Width as two questions: any reply at all (F1 and rates), and how many given one (rank correlation, over two rows at least)."""
    any_ = df.agg(f1_macro((F.col("pw") > 0).cast("int"), (F.col("tw") > 0).cast("int")).alias("width_any_f1"), F.avg((F.col("tw") > 0).cast("double")).alias("rate_true"), F.avg((F.col("pw") > 0).cast("double")).alias("rate_pred"), F.count_if(F.col("tw") > 0).alias("n_width_pos"))
    rho = spearman(df.filter("tw > 0"), [], "pw", "tw", "width_rho_pos").select(F.when(F.col("n") > 2, F.col("width_rho_pos")).alias("width_rho_pos"))
    return any_.crossJoin(rho)


def ordinals(df: DataFrame, key: str) -> DataFrame:
    """``df`` plus ``ord`` from 0 in the order of ``key``, by range partitions and their sizes."""
    parts = staged(df.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return parts.join(F.broadcast(before), "_p").withColumn("ord", F.col("_b") + rank).drop("_p", "_b")


def resampled(df: DataFrame, key: str, replicates: int, seed: str) -> DataFrame:
    """Bootstrap rows: ``replicates`` times as many draws with replacement as rows; the draws depend on seed and place only, so they pair across models."""
    rows = staged(ordinals(df, key), "ordinals")
    n = rows.count()
    if not n:
        return rows.withColumn("b", F.lit(0)).limit(0)
    draw = rows.select("ord", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")).select("b", F.pmod(hash_unit(seed, F.col("b"), F.col("ord")), F.lit(n)).alias("ord"))
    return draw.join(rows, "ord")


def interval(df: DataFrame, x: str) -> DataFrame:
    """``low, high``: the 2.5 and 97.5 percentiles, linear, nulls left out."""
    return df.agg(F.percentile(x, 0.025).alias("low"), F.percentile(x, 0.975).alias("high"))


def paired_delta(a: DataFrame, b: DataFrame, x: str) -> DataFrame:
    """Difference of two models by replicate: ``delta, low, high, p`` with the two-sided bootstrap p-value."""
    d = a.select("b", F.col(x).alias("u")).join(b.select("b", F.col(x).alias("v")), "b").select((F.col("u") - F.col("v")).alias("d"))
    return d.agg(
        F.avg("d").alias("delta"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"),
        (2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))).alias("p"),
    )


def horizon_slope(by_month: DataFrame, x: str, home: Column) -> DataFrame:
    """Yearly change of a monthly metric over its distance from the home month; null below three points."""
    h = by_month.filter(F.col(x).isNotNull()).withColumn("h", months_between(home, F.col("month")).cast("double"))
    return h.agg(F.count("*").alias("points"), F.when(F.count("*") > 2, F.try_divide(F.covar_pop("h", x), F.nullif(F.var_pop("h"), F.lit(0.0))) * 12).alias("slope_per_year"))
