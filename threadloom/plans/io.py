"""Queries of sources, sinks, ledgers and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from threadloom.operators.comments import DUMP_COLUMNS
from threadloom.plans.corpus import SQL_R, once
from threadloom.plans.common import with_
from threadloom.session import shared_dir, table
from threadloom.sources import ledger as L
from threadloom.sources import ndjson as J
from threadloom.sources import probe as PB
from threadloom.streaming import ingest as ST

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


_KEY = "md5(concat_ws('|', id, parent_id, link_id, subreddit, nullif(author, ''), body, score, controversiality, created_utc, edited, gilded))"


@query("ingest_zst", f"SELECT _source_file, count(*) AS n, count(id) AS ids, sum(score) AS score, count(stickied) AS stickied, min({_KEY.replace('edited', chr(39) + 'x' + chr(39))}) AS first_key FROM comments GROUP BY 1")
def ingest_zst(spark, d):
    """Dump written as zstd NDJSON per source file, read back through the lenient parser."""
    files = J.write_zst(table(spark, d, "comments"), _folder(spark))
    rows = J.parsed(J.compressed_lines(spark, files)).filter("not bad")
    return rows.groupBy("_source_file").agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.sum("score").alias("score"), F.count("stickied").alias("stickied"), F.min(F.expr(_KEY.replace("edited", "'x'"))).alias("first_key"))


@query("bad_lines", "SELECT 3 AS bad, 2 AS good, 1 AS null_scores")
def bad_lines(spark, d):
    """Malformed lines are counted and skipped; bad numbers become null."""
    lines = ['{"id": "a", "score": "7", "edited": false}', "{broken", "[1, 2]", "", '"text"', '{"id": "", "score": "x", "edited": 1700000000}']
    rows = J.parsed(spark.createDataFrame([(x, "f") for x in lines], "line string, _source_file string"))
    return rows.agg(F.count_if("bad").cast("int").alias("bad"), F.count_if(~F.col("bad")).cast("int").alias("good"), F.count_if(~F.col("bad") & F.col("score").isNull()).cast("int").alias("null_scores"))


@query("jsonl_lean", with_(SQL_R) + "SELECT record_id, split, n_live_replies FROM r")
def jsonl_lean(spark, d):
    """Gzip JSONL of a few keys, read back with a narrow schema."""
    path = _folder(spark)
    J.write_jsonl(once(spark, d).select("record_id", "split", "meta", "ground_truth", "n_live_replies"), path, gzip=True)
    return J.read_jsonl(spark, path, "record_id bigint, split string, n_live_replies int")


@query("partitioned_extract", "SELECT subreddit, count(*) AS n, count(DISTINCT id) AS ids FROM comments WHERE subreddit IN ('newsdesk', 'gadgetry') GROUP BY 1")
def partitioned_extract(spark, d):
    """One scan written as a partition per subreddit; reading one of them prunes the rest."""
    path = _folder(spark)
    J.write_parquet(table(spark, d, "comments").filter(F.col("subreddit").isin("newsdesk", "gadgetry")).select("id", "subreddit", "score"), path, "subreddit")
    return spark.read.parquet(path).groupBy("subreddit").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("resume_ledger", with_(SQL_R) + "SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM r")
def resume_ledger(spark, d):
    """A second run does only what the first left."""
    path, rows = _folder(spark), once(spark, d).select("record_id")
    L.resumed(rows.filter("record_id % 3 = 0"), path, "record_id", lambda x: x.withColumn("run", F.lit(1)))
    return L.resumed(rows, path, "record_id", lambda x: x.withColumn("run", F.lit(2)))


@query("vector_cache", "SELECT DISTINCT sha1(left(coalesce(text, ''), 1000)) AS key FROM documents")
def vector_cache(spark, d):
    """Vectors by content key, encoded once; a second pass over the same texts adds nothing."""
    path, texts = _folder(spark), table(spark, d, "documents").select("text")
    encode = lambda x: x.select("key", F.array(F.length("text").cast("float")).alias("vector"))
    L.cached_vectors(texts, path, encode)
    return L.cached_vectors(texts, path, encode).select("key")


@query("row_group_probe")
def row_group_probe(spark, d):
    path = f"{d}/comments.parquet"
    files = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".parquet")] if os.path.isdir(path) else [path]
    return PB.rates(PB.probe(spark, files))


@query("stream_ingest", "SELECT subreddit, count(*) AS n FROM comments GROUP BY 1")
def stream_ingest(spark, d):
    """Files streamed into Parquet in two runs; the second takes only the new files."""
    base, rows = _folder(spark), table(spark, d, "comments")
    body = F.to_json(F.struct(*[c for c in DUMP_COLUMNS if c != "_source_file"]), {"ignoreNullFields": "false"})
    for late in (False, True):
        rows.filter((F.pmod(F.xxhash64("id"), F.lit(2)) == 1) == F.lit(late)).select(body.alias("value")).write.mode("append").text(f"{base}/in")
        ST.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/check")
    return spark.read.parquet(f"{base}/out").filter("not bad").groupBy("subreddit").agg(F.count("*").alias("n"))


@query("windowed_counts", "SELECT date_trunc('day', make_timestamp(created_utc * 1000000)) AS start, subreddit, count(*) AS n FROM comments WHERE created_utc IS NOT NULL GROUP BY ALL")
def windowed_counts(spark, d):
    return ST.windowed(table(spark, d, "comments").filter("created_utc is not null")).withColumn("start", F.col("start").cast("timestamp_ntz"))
