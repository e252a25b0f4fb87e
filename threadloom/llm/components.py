"""Connected components by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import staged


def jumped(parent: DataFrame) -> DataFrame:
    """Pointer jumping: ``node, root`` until every pointer names a root (log of the chain length rounds)."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        nxt = staged(
            parent.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")),
            "jump",
        )
        parent = nxt.select("node", "root")
        if nxt.filter("moved").isEmpty():
            return parent


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v`` strings); the root is the smallest node of its component.

    Each round hooks every remaining root to its smallest neighbour, shortens the chains
    and contracts the edges, so at least half of the roots with an edge vanish. Edges are
    made distinct before each shuffle, so a hub costs its distinct neighbours only. Nulls
    and self-loops relate nothing; an empty input gives an empty table.
    """
    link = edges.filter("u is not null and v is not null")
    assign = None
    todo = staged(link.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = todo.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    todo = todo.filter("u <> v")
    while not todo.isEmpty():
        hook = todo.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        parent = jumped(staged(hook, "hook"))
        if assign is None:
            assign = parent
        else:
            moved = parent.select(F.col("node").alias("root"), F.col("root").alias("to"))
            was = assign.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            assign = staged(was.unionByName(parent.join(assign, "node", "left_anti")), "assign")
        to_u = parent.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = parent.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        mapped = todo.join(to_u, "u", "left").join(to_v, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        todo = staged(mapped.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if assign is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(assign, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
