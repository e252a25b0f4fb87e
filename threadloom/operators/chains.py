"""Root-to-leaf chains and the records cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import hash_unit
from threadloom.operators.comments import with_width


def chains(c: DataFrame, f: DataFrame, min_length: int = 3, min_root_score: int = 20) -> DataFrame:
    """``root_id, branch, leaf_id, length, path``: the longest path below every child of a root.

    Paths that share an edge share the root's child, so greedy edge-disjoint selection keeps one per
    branch; among equal lengths the greatest sibling order wins. A maximum of structs needs no sort.
    """
    leaves = f.join(c.select(F.col("parent_key").alias("id")).filter("id is not null").distinct(), "id", "left_anti").filter("depth >= 1")
    good = c.filter(F.col("score") >= min_root_score).select(F.col("id").alias("root_id"))
    long = leaves.join(good, "root_id", "left_semi").select("root_id", F.substring_index(F.col("path")[1], ":", -1).alias("branch"), F.struct(F.size("path").alias("length"), "path", "id").alias("x"))
    best = long.groupBy("root_id", "branch").agg(F.max("x").alias("x"))
    return best.select("root_id", "branch", F.col("x.id").alias("leaf_id"), F.col("x.length").alias("length"), F.col("x.path").alias("path")).filter(F.col("length") >= min_length)


def chain_sets(c: DataFrame, ch: DataFrame, seed: str = "42") -> DataFrame:
    """One record per chain: a seeded cut in [0, length - 2] names the stimulus, what is above is context."""
    cut = F.pmod(hash_unit(seed, F.col("leaf_id")), F.col("length") - 1)
    rows = ch.withColumn("cut", cut.cast("int")).select("leaf_id", "root_id", "length", "cut", F.substring_index(F.element_at("path", F.col("cut") + 1), ":", -1).alias("id"))
    facts = with_width(c).select("id", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("controversiality", F.lit(0)).alias("controversiality"), "width")
    return rows.join(facts, "id").select("leaf_id", "root_id", F.col("id").alias("stimulus_id"), F.col("cut").alias("n_context"), "score", "controversiality", "width")
