"""Queries of scans, projections and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.text import month_utc
from threadloom.operators import aggregate as A
from threadloom.operators.comments import CORE_COLUMNS, with_width
from threadloom.plans.common import SQL_C, SQL_W, dump, narrow, with_
from threadloom.plans.corpus import MONTH, SQL_R, once
from threadloom.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


SQL_MM = f"mm AS (SELECT *, {MONTH} AS month FROM w)"


def monthly(spark, d):
    return with_width(dump(spark, d)).withColumn("month", month_utc(F.col("created_utc")))


@query("subreddit_scan", "SELECT id, parent_id, link_id, subreddit, author, score, created_utc FROM comments WHERE subreddit = 'gadgetry'")
def subreddit_scan(spark, d):
    """Projected scan with an equality filter that reaches the Parquet reader."""
    return table(spark, d, "comments").filter("subreddit = 'gadgetry'").select("id", "parent_id", "link_id", "subreddit", "author", "score", "created_utc")


@query("subreddit_head", "SELECT id, created_utc FROM comments WHERE subreddit = 'newsdesk' ORDER BY created_utc NULLS FIRST, id, _source_file LIMIT 500")
def subreddit_head(spark, d):
    """The row limit of a single-subreddit load, on an explicit order."""
    return table(spark, d, "comments").filter("subreddit = 'newsdesk'").orderBy("created_utc", "id", "_source_file").limit(500).select("id", "created_utc")


@query("multi_extract", with_(f"e AS (SELECT *, {MONTH} AS month FROM comments WHERE subreddit IN ('civicforum', 'newsdesk', 'rightlane'))") + "SELECT month, subreddit, count(*) AS n FROM e GROUP BY ALL")
def multi_extract(spark, d):
    """One scan for several subreddits, by month."""
    rows = table(spark, d, "comments").filter(F.col("subreddit").isin("civicforum", "newsdesk", "rightlane"))
    return rows.groupBy(month_utc(F.col("created_utc")).alias("month"), "subreddit").agg(F.count("*").alias("n"))


@query("core_projection", "SELECT id, parent_id, link_id, subreddit, author, md5(body) AS body_key, score, controversiality, created_utc FROM comments")
def core_projection(spark, d):
    return table(spark, d, "comments").select(*[c for c in CORE_COLUMNS if c != "body"], F.md5("body").alias("body_key"))


@query("strip_solution", with_(SQL_R) + "SELECT record_id, pos, x.id AS id, x.author AS author, x.created_utc AS created_utc FROM (SELECT record_id, unnest(context) AS x, unnest(range(len(context))) AS pos FROM r)")
def strip_solution(spark, d):
    """Context nodes without the fields that would give the answer away."""
    rows = once(spark, d).select("record_id", F.posexplode(F.transform("context", lambda n: n.dropFields("score", "controversiality"))).alias("pos", "n"))
    return rows.select("record_id", F.col("pos").cast("bigint").alias("pos"), "n.id", "n.author", "n.created_utc")


@query("source_lineage", "SELECT _source_file, count(*) AS n, count(DISTINCT id) AS ids, min(created_utc) AS first, max(created_utc) AS last FROM comments GROUP BY 1")
def source_lineage(spark, d):
    return table(spark, d, "comments").groupBy("_source_file").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("created_utc").alias("first"), F.max("created_utc").alias("last"))


@query("thread_sizes", with_(SQL_C) + "SELECT link_key, count(*) AS size FROM c GROUP BY 1")
def thread_sizes(spark, d):
    return narrow(spark, d).groupBy("link_key").agg(F.count("*").alias("size"))


@query("author_counts", with_(SQL_C) + "SELECT subreddit, count(DISTINCT author) AS authors, count(DISTINCT link_key) AS posts FROM c GROUP BY 1")
def author_counts(spark, d):
    return dump(spark, d).groupBy("subreddit").agg(F.count_distinct("author").alias("authors"), F.count_distinct("link_key").alias("posts"))


@query("cell_manifest", with_(SQL_C, SQL_W, SQL_MM) + "SELECT month, subreddit, count(*) AS comments, count(DISTINCT link_key) AS posts, count(DISTINCT author) AS authors, round(avg(CAST(width = 0 AS DOUBLE)), 4) AS width0_frac, round(avg(CAST(coalesce(controversiality, 0) = 1 AS DOUBLE)), 4) AS contr_rate FROM mm GROUP BY ALL")
def cell_manifest(spark, d):
    return A.manifest(monthly(spark, d), ["month", "subreddit"])


@query(
    "dataset_stats",
    with_(SQL_C, SQL_W, "l AS (SELECT 'score' AS name, CAST(score AS DOUBLE) AS v FROM w UNION ALL SELECT 'width', CAST(width AS DOUBLE) FROM w UNION ALL SELECT 'n_chars', CAST(length(body) AS DOUBLE) FROM w)")
    + "SELECT name, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99, min(v) AS low, max(v) AS high FROM l WHERE v IS NOT NULL GROUP BY name",
)
def dataset_stats(spark, d):
    s = A.described(with_width(dump(spark, d)).withColumn("n_chars", F.length("body")), ["score", "width", "n_chars"])
    return s.select("name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "p99")], "low", "high")


@query(
    "group_sets",
    with_(SQL_C, SQL_W, SQL_MM)
    + "SELECT month, subreddit, CAST(grouping_id(month, subreddit) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (controversiality = 1) AS contr, count(*) FILTER (width = 0) AS width0, count(*) FILTER (body IN ('[removed]', '[deleted]')) AS gone FROM mm GROUP BY GROUPING SETS ((month), (subreddit), (month, subreddit), ())",
)
def group_sets(spark, d):
    return A.grouped(monthly(spark, d), [["month"], ["subreddit"], ["month", "subreddit"], []]).select("month", "subreddit", "level", "n", "contr", "width0", "gone")


@query("subreddit_medians", with_(SQL_C) + "SELECT subreddit, round(quantile_cont(score, 0.5), 6) AS median_score, round(avg(score), 6) AS mean_score FROM c WHERE score IS NOT NULL GROUP BY 1")
def subreddit_medians(spark, d):
    """Exact medians: no capped sample is needed."""
    return narrow(spark, d).filter("score is not null").groupBy("subreddit").agg(F.round(F.percentile("score", 0.5), 6).alias("median_score"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("depth_histogram", with_(SQL_R) + "SELECT CAST(least(len(context), 6) AS INTEGER) AS depth, count(*) AS n FROM r GROUP BY 1")
def depth_histogram(spark, d):
    return once(spark, d).groupBy(F.least(F.size("context"), F.lit(6)).alias("depth")).agg(F.count("*").alias("n"))


@query("score_histogram", with_(SQL_C) + "SELECT CAST(least(greatest(floor((log10(greatest(score, 1)) - 0.0) / ((4.0 - 0.0) / 60)), 0), 59) AS INTEGER) AS bin, count(*) AS n FROM c WHERE score IS NOT NULL GROUP BY 1")
def score_histogram(spark, d):
    return A.histogram(narrow(spark, d).filter("score is not null"), F.log10(F.greatest("score", F.lit(1))), 0.0, 4.0, 60)


@query("month_profile", with_(SQL_C, SQL_W, SQL_MM) + "SELECT month, subreddit, count(*) AS rows, count(controversiality) AS flagged, round(sum(controversiality) / nullif(CAST(count(controversiality) AS DOUBLE), 0), 6) AS contr_rate FROM mm GROUP BY ALL")
def month_profile(spark, d):
    return A.month_profile(monthly(spark, d))


@query(
    "reply_totals",
    with_(SQL_R, "x AS (SELECT split, len(coalesce(replies, [])) AS n, coalesce(list_sum(list_transform(replies, lambda y: length(y.body))), 0) AS chars, ground_truth.width AS width FROM r)")
    + "SELECT split, count(*) AS records, round(avg(n), 6) AS mean_replies, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_replies, max(n) AS most, round(avg(chars), 6) AS mean_chars, count(*) FILTER (n <> width) AS mismatched FROM x GROUP BY split",
)
def reply_totals(spark, d):
    n = F.size(F.coalesce("replies", F.array()))
    chars = F.coalesce(F.aggregate("replies", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["body"])), F.lit(0))
    x = once(spark, d).select("split", n.cast("bigint").alias("n"), chars.alias("chars"), F.col("ground_truth.width").alias("width"))
    return x.groupBy("split").agg(F.count("*").alias("records"), F.round(F.avg("n"), 6).alias("mean_replies"), F.percentile("n", 0.5).alias("median_replies"), F.max("n").alias("most"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.count_if(F.col("n") != F.col("width")).alias("mismatched"))


@query("union_cells", with_(SQL_C) + "SELECT subreddit, count(*) AS n FROM (SELECT * FROM c WHERE subreddit = 'newsdesk' UNION ALL SELECT * FROM c WHERE subreddit = 'gadgetry') GROUP BY 1")
def union_cells(spark, d):
    c = narrow(spark, d)
    return c.filter("subreddit = 'newsdesk'").unionByName(c.filter("subreddit = 'gadgetry'")).groupBy("subreddit").agg(F.count("*").alias("n"))


@query("class_balance", with_(SQL_R) + "SELECT split, count(*) AS n, count(*) FILTER (ground_truth.controversiality = 1) AS positives FROM r GROUP BY 1")
def class_balance(spark, d):
    return once(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("ground_truth.controversiality") == 1).alias("positives"))


@query(
    "star_revenue",
    """SELECT r_name, l_returnflag, CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""",
)
def star_revenue(spark, d):
    """Ad-hoc SQL over registered views."""
    for t in ("lineitem", "orders", "customer", "nation", "region"):
        table(spark, d, t).createOrReplaceTempView(f"tl_{t}")
    return spark.sql(
        """SELECT r_name, l_returnflag, year(o_orderdate) AS order_year, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM tl_lineitem JOIN tl_orders ON o_orderkey = l_orderkey
        JOIN tl_customer ON c_custkey = o_custkey JOIN tl_nation ON n_nationkey = c_nationkey JOIN tl_region ON r_regionkey = n_regionkey WHERE l_shipdate >= TIMESTAMP_NTZ '1995-01-01' GROUP BY r_name, l_returnflag, year(o_orderdate)"""
    )
