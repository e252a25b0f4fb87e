"""Reply forests: roots, depths and paths by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.comments import with_parent
from threadloom.session import staged


def forest(c: DataFrame) -> DataFrame:
    """``id, root_id, depth, path`` of every comment under a root; ``path`` holds the ``ord`` of root to comment.

    Every open node points to an ancestor; a round replaces the pointer by the ancestor's own, so a
    thread of depth d takes log2(d) joins instead of d. Comments on a cycle never reach a root and
    are dropped: a round that closes nothing has only those left.
    """
    start = with_parent(c).select("id", F.when(F.col("has_parent"), F.col("parent_key")).alias("anc"), F.array("ord").alias("path"))
    state = staged(start.select("id", "anc", F.when(F.col("anc").isNull(), F.col("id")).alias("root_id"), "path"), "pointers")
    left = state.filter("root_id is null").count()
    while left:
        up = state.select(F.col("id").alias("anc"), F.col("anc").alias("up"), F.col("root_id").alias("up_root"), F.col("path").alias("up_path"))
        moved = state.filter("root_id is null").join(up, "anc")
        moved = moved.select("id", F.when(F.col("up_root").isNull(), F.col("up")).alias("anc"), F.col("up_root").alias("root_id"), F.concat("up_path", "path").alias("path"))
        state = staged(state.filter("root_id is not null").unionByName(moved), "pointers")
        now = state.filter("root_id is null").count()
        if now == left:
            break
        left = now
    return state.filter("root_id is not null").select("id", "root_id", (F.size("path") - 1).alias("depth"), "path")


def context_ids(f: DataFrame, most: int = 65) -> DataFrame:
    """``id, context``: ids of the ancestors, root first, the nearest ``most`` of them."""
    above = F.slice("path", 1, F.size("path") - 1)
    kept = F.slice(above, F.greatest(F.size(above) - most + 1, F.lit(1)), most)
    return f.select("id", "root_id", "depth", F.transform(kept, lambda p: F.substring_index(p, ":", -1)).alias("context"))


def heights(f: DataFrame) -> DataFrame:
    """``root_id, height, size`` of every tree."""
    return f.groupBy("root_id").agg(F.max("depth").alias("height"), F.count("*").alias("size"))


def with_context(rows: DataFrame, f: DataFrame, c: DataFrame) -> DataFrame:
    """``rows`` (with ``id``) plus ``context``, the ancestors as structs, root first.

    Only the paths of ``rows`` are exploded and joined, so the cost follows the rows asked for.
    """
    node = F.struct("id", "parent_id", "link_id", "subreddit", "author", "body", "score", "controversiality", "created_utc")
    steps = context_ids(f.join(rows.select("id"), "id", "left_semi")).select(F.col("id").alias("of"), F.posexplode("context").alias("pos", "id"))
    nodes = steps.join(c, "id").groupBy(F.col("of").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", node.alias("n")))).alias("ns"))
    empty = F.array().cast("array<struct<id:string,parent_id:string,link_id:string,subreddit:string,author:string,body:string,score:bigint,controversiality:bigint,created_utc:bigint>>")
    return rows.join(nodes.select("id", F.transform("ns", lambda x: x["n"]).alias("context")), "id", "left").withColumn("context", F.coalesce("context", empty))
