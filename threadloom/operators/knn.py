"""Exact nearest neighbours: queries in bounded blocks against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import staged

#: Queries held by every task at once (a block of 64-dimensional vectors is half a megabyte).
BLOCK = 1024


def dense_neighbours(rows: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query, key, sim``: the ``k`` rows of greatest dot product for every query, itself left out, ties by key.

    Queries go in blocks of ``BLOCK``; a block is broadcast, every partition of ``rows`` keeps its own
    best ``k`` per query, and only those are merged, so the shuffle holds k rows per query and partition.
    Null vectors match nothing.
    """
    q = queries.filter(F.col(vec).isNotNull()).select(F.col(key).alias("q"), F.col(vec).alias("v"))
    q = staged(q, "queries")
    out, spark = None, rows.sparkSession
    n = q.count()
    blocks = max(1, -(-n // BLOCK))
    data = rows.filter(F.col(vec).isNotNull()).select(key, vec)
    for b in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()
        if part.empty:
            continue
        shared = spark.sparkContext.broadcast((part["q"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float32)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for batch in batches:
                if batch.empty:
                    continue
                keys = batch[key].to_numpy()
                order = np.argsort(keys, kind="stable")
                keys, x = keys[order], np.stack(batch[vec].to_numpy()).astype(np.float32)[order]
                sim = m @ x.T
                sim[ids[:, None] == keys[None, :]] = -np.inf
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                at = np.repeat(np.arange(len(ids)), best.shape[1])
                s = sim[at, best.ravel()]
                out = pd.DataFrame({"query": ids[at], key: keys[best.ravel()], "sim": s.astype(float)})
                yield out[np.isfinite(s)]

        found = data.mapInPandas(run, f"query bigint, {key} bigint, sim double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query bigint, {key} bigint, sim double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tfidf(rows: DataFrame, key: str, text: str, max_terms: int = 30000) -> DataFrame:
    """``key, term, w``: L2-normed smoothed TF-IDF over words of two characters at least and pairs of neighbouring words.

    The vocabulary is the ``max_terms`` most frequent terms, ties in term order.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)[^\w]+"), lambda w: F.length(w) >= 2)
    base = rows.select(key, tokens.alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    tf = staged(base.select(key, F.explode(F.concat("t", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), "tf")
    n = rows.select(key).distinct().count()
    terms = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).orderBy(F.desc("cf"), "term").limit(max_terms)
    weighed = tf.join(terms, "term").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1))
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def sparse_neighbours(vectors: DataFrame, queries: DataFrame, k: int, key: str, block: int = 256, among: DataFrame | None = None) -> DataFrame:
    """``query, key, sim``: the ``k`` rows of greatest cosine for every query, itself left out, ties by key;
    neighbours are only the rows of ``among`` (``key``) where it is given.

    No join on terms, which would meet in every common word: blocks of queries go to all tasks as a
    matrix over the block's own terms, and every partition keeps its best ``k`` per query.
    """
    spark = vectors.sparkSession
    asked = staged(vectors.join(queries.select(key), key, "left_semi").groupBy(key).agg(F.collect_list("term").alias("ts"), F.collect_list("w").alias("ws")), "queries")
    docs = vectors if among is None else vectors.join(among.select(key), key, "left_semi")
    docs = staged(docs.groupBy(key).agg(F.collect_list("term").alias("ts"), F.collect_list("w").alias("ws")), "vectors")
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas()
        if part.empty:
            continue
        terms = {t: i for i, t in enumerate(sorted({t for ts in part["ts"] for t in ts}))}
        m = np.zeros((len(terms), len(part)), dtype=np.float32)
        for j, (ts, ws) in enumerate(zip(part["ts"], part["ws"])):
            m[[terms[t] for t in ts], j] = ws
        shared = spark.sparkContext.broadcast((part[key].to_numpy(), terms, m))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, terms, m = shared.value
            for batch in batches:
                batch = batch.sort_values(key)
                sims = np.zeros((len(batch), len(ids)), dtype=np.float32)
                for r, (ts, ws) in enumerate(zip(batch["ts"], batch["ws"])):
                    hit = [(terms[t], w) for t, w in zip(ts, ws) if t in terms]
                    if hit:
                        at, w = zip(*hit)
                        sims[r] = np.asarray(w, dtype=np.float32) @ m[list(at)]
                keys = batch[key].to_numpy()
                sims[keys[:, None] == ids[None, :]] = 0
                best = np.argsort(-sims, axis=0, kind="stable")[:k]
                q = np.tile(np.arange(len(ids)), (best.shape[0], 1))
                s = sims[best, q].ravel()
                found = pd.DataFrame({"query": ids[q.ravel()], key: keys[best.ravel()], "sim": s.astype(float)})
                yield found[s > 0]

        near = docs.mapInPandas(run, f"query bigint, {key} bigint, sim double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], f"query bigint, {key} bigint, sim double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def aggregated(neighbours: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Prediction per query: similarity-weighted score and width (weights at least 1e-8), class 1 where its weight is no less, summary of the nearest."""
    w = neighbours.join(truth, key).withColumn("wt", F.greatest(F.col("sim"), F.lit(1e-8)))
    mean = lambda x: F.sum(F.col("wt") * F.col(x)) / F.sum("wt")
    return w.groupBy("query").agg(
        F.bround(F.greatest(mean("score"), F.lit(0.0))).cast("bigint").alias("score"), F.bround(F.greatest(mean("width"), F.lit(0.0))).cast("bigint").alias("width"),
        (F.sum(F.when(F.col("contr") == 1, F.col("wt")).otherwise(0.0)) >= F.sum(F.when(F.col("contr") == 1, 0.0).otherwise(F.col("wt")))).cast("int").alias("controversiality"),
        F.max_by("reply_summary", F.struct("sim", -F.col(key))).alias("reply_summary"),
    )
