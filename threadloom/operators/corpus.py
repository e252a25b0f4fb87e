"""The corpus sampler: which comments become records, and the records themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import month_utc, width_bucket
from threadloom.operators import forest as FO
from threadloom.operators.comments import with_width
from threadloom.operators.sampling import cap_per_group, first_by_hash, hash_limit, pps_posts
from threadloom.session import staged


def tail_cut(c: DataFrame, days: float = 2.0) -> DataFrame:
    """Comments old enough to have their replies: not within ``days`` of the newest of the whole input. Null times stay out."""
    newest = c.agg(F.max("created_utc").alias("newest"))
    return c.crossJoin(F.broadcast(newest)).filter(F.col("created_utc") <= F.col("newest") - int(days * 86400)).drop("newest")


def root_gate(c: DataFrame, f: DataFrame, least: int) -> DataFrame:
    """``link_key, root_score`` of posts whose best root scores at least ``least`` (null scores are 0)."""
    roots = f.filter("depth = 0").select("id").join(c, "id")
    return roots.groupBy("link_key").agg(F.max(F.coalesce("score", F.lit(0))).alias("root_score")).filter(F.col("root_score") >= least)


def post_sample(c: DataFrame, n: int, sampling: str, seed: str) -> DataFrame:
    """``link_key`` of ``n`` sampled posts, ``uniform`` or ``pps``; anything else raises."""
    if sampling == "uniform":
        return hash_limit(c.select("link_key").filter("link_key is not null").distinct(), n, seed, "link_key")
    if sampling == "pps":
        return pps_posts(c, n, seed).select("link_key")
    raise ValueError(f"unknown post sampling: {sampling!r}")


def candidates(c: DataFrame, f: DataFrame, min_root_score: int = 0, tail_days: float = 2.0, max_depth: int = 12) -> DataFrame:
    """Comments that may become a stimulus, with ``depth, root_id, root_score, width``."""
    near = f.filter(F.col("depth") <= max_depth).select("id", "root_id", "depth")
    gate = root_gate(c, f, min_root_score)
    return tail_cut(with_width(c), tail_days).join(near, "id").join(gate, "link_key")


def records(c: DataFrame, max_posts: int | None = None, max_records: int | None = None, per_post_cap: int = 8, min_root_score: int = 0, tail_days: float = 2.0, max_depth: int = 12, sampling: str = "uniform", seed: str = "42") -> DataFrame:
    """The corpus build: tail cut before the post sample, sampled posts as a semi-join before the forest, caps, then context."""
    c = staged(c, "comments")
    cut = tail_cut(c, tail_days).select("id")
    if max_posts is not None:
        c = staged(c.join(post_sample(c, max_posts, sampling, seed), "link_key", "left_semi"), "sampled")
    f = FO.forest(c)
    rows = candidates(c, f, min_root_score, 0.0, max_depth).join(cut, "id", "left_semi")
    rows = cap_per_group(rows, ["link_key"], per_post_cap, seed, "id")
    if max_records is not None:
        rows = hash_limit(rows, max_records, seed, "id")
    rows = FO.with_context(staged(rows, "records"), f, c)
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.select(
        "id", "context", F.struct("id", "parent_id", "link_id", "subreddit", "author", "body", "created_utc").alias("stimulus"),
        F.struct(zero("score").alias("score"), zero("controversiality").cast("int").alias("controversiality"), F.col("width").alias("width"), F.lit("").alias("reply_summary")).alias("ground_truth"),
        F.struct("link_id", "subreddit", "depth", "root_score", zero("created_utc").alias("created_utc")).alias("meta"),
    )


def replies_of(stimuli: DataFrame, c: DataFrame) -> DataFrame:
    """``stimuli`` (``id, link_key``) plus ``replies``: direct children in sibling order, bodies cut to 1,500 characters.

    Comments are semi-joined to the posts of the stimuli, then to the stimuli themselves, before children are collected.
    """
    near = c.join(stimuli.select("link_key").distinct(), "link_key", "left_semi").join(stimuli.select(F.col("id").alias("parent_key")).distinct(), "parent_key", "left_semi")
    reply = F.struct("ord", F.struct("id", "author", F.substring(F.coalesce("body", F.lit("")), 1, 1500).alias("body"), "score", F.col("controversiality").cast("int").alias("controversiality"), "created_utc").alias("r"))
    kids = near.groupBy(F.col("parent_key").alias("id")).agg(F.transform(F.sort_array(F.collect_list(reply)), lambda x: x["r"]).alias("replies"))
    empty = F.array().cast("array<struct<id:string,author:string,body:string,score:bigint,controversiality:int,created_utc:bigint>>")
    return stimuli.join(kids, "id", "left").withColumn("replies", F.coalesce("replies", empty))


def live(replies: str = "replies"):
    """Number of replies that were not removed."""
    return F.size(F.filter(replies, lambda r: ~F.coalesce(r["body"], F.lit("")).isin("[removed]", "[deleted]")))


def strata(rows: DataFrame) -> DataFrame:
    """Replied comments with ``month`` and width ``bucket``."""
    return rows.filter("width >= 1 and created_utc is not null").withColumn("month", month_utc(F.col("created_utc"))).withColumn("bucket", width_bucket(F.col("width")))


def post_split(rows: DataFrame, fraction: float, seed: str, post: str = "link_key") -> DataFrame:
    """``rows`` plus ``split``: the first ``int(posts * fraction)`` posts in hash order are test, so no post is on both sides."""
    posts = first_by_hash(rows.select(post).filter(F.col(post).isNotNull()).distinct(), None, seed, post, fraction)
    return rows.join(posts, post).withColumn("split", F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen")


def without_posts(train: DataFrame, held_out: DataFrame, post: str = "link_key") -> DataFrame:
    """Training rows whose post is not held out."""
    return train.join(held_out.select(post).distinct(), post, "left_anti")


def temporal_split(rows: DataFrame, last_months: int, post: str = "link_key") -> DataFrame:
    """The last months are test and kept whole; training rows on their posts are dropped."""
    dated = rows.filter("created_utc is not null").withColumn("month", month_utc(F.col("created_utc")))
    months = dated.select("month").distinct().orderBy(F.desc("month")).limit(last_months)
    test = dated.join(F.broadcast(months), "month", "left_semi")
    train = dated.join(F.broadcast(months), "month", "left_anti")
    return test.withColumn("split", F.lit("test")).unionByName(without_posts(train, test, post).withColumn("split", F.lit("train")))


def overlap(rows: DataFrame, post: str, stimulus: str) -> DataFrame:
    """``posts, stimuli, duplicates``: what train and the other splits share, and rows that repeat a stimulus."""
    both = lambda key, name: rows.groupBy(key).agg(F.max((F.col("split") == "train").cast("int")).alias("a"), F.max((F.col("split") != "train").cast("int")).alias("b")).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias(name))
    repeats = rows.agg((F.count(stimulus) - F.count_distinct(stimulus)).alias("duplicates"))
    return both(post, "posts").crossJoin(both(stimulus, "stimuli")).crossJoin(repeats)


def checked_disjoint(rows: DataFrame, post: str) -> DataFrame:
    """``rows``, or an error where train and the other splits share a post."""
    n = overlap(rows, post, post).first()["posts"]
    if n:
        raise ValueError(f"{n} posts are on both sides of the split")
    return rows
