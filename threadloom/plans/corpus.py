"""Queries of the corpus sampler: gates, samples, splits, reply recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.ids import bare_id, hash_unit
from threadloom.operators import corpus as K
from threadloom.operators import forest as FO
from threadloom.operators import sampling as S
from threadloom.operators.comments import with_width
from threadloom.plans.common import SQL_C, SQL_F, SQL_W, dump, narrow, sql_hash, with_
from threadloom.session import staged, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def once(spark, d):
    """Summary records, whole-row repeats once."""
    return table(spark, d, "summary_records").dropDuplicates(["record_id"])


SQL_R = "r AS (SELECT * FROM summary_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY record_id) = 1)"
MONTH = "strftime(make_timestamp(created_utc * 1000000), '%Y-%m')"
SQL_CUT = "cut AS (SELECT * FROM w WHERE created_utc <= (SELECT max(created_utc) FROM c) - 172800)"
SQL_GATE = "gate AS (SELECT c.link_key, max(coalesce(c.score, 0)) AS root_score FROM f JOIN c USING (id) WHERE f.depth = 0 GROUP BY 1 HAVING max(coalesce(c.score, 0)) >= 3)"
SQL_CAND = "cand AS (SELECT cut.*, f.depth, f.root_id, gate.root_score FROM cut JOIN f USING (id) JOIN gate USING (link_key) WHERE f.depth <= 12)"
BUCKET = "CASE WHEN width <= 1 THEN '1' WHEN width <= 3 THEN '2-3' WHEN width <= 9 THEN '4-9' ELSE '10+' END"


def _parts(spark, d):
    c = staged(narrow(spark, d), "comments")
    return c, FO.forest(c)


@query("tail_cutoff", with_(SQL_C, SQL_W, SQL_CUT) + "SELECT id, created_utc FROM cut")
def tail_cutoff(spark, d):
    return K.tail_cut(narrow(spark, d)).select("id", "created_utc")


@query("root_score_gate", with_(SQL_C, SQL_F, SQL_GATE) + "SELECT link_key, root_score FROM gate")
def root_score_gate(spark, d):
    return K.root_gate(*_parts(spark, d), 3)


@query("corpus_candidates", with_(SQL_C, SQL_W, SQL_F, SQL_CUT, SQL_GATE, SQL_CAND) + "SELECT id, link_key, root_id, CAST(depth AS INTEGER) AS depth, root_score, width FROM cand")
def corpus_candidates(spark, d):
    return K.candidates(*_parts(spark, d), min_root_score=3).select("id", "link_key", "root_id", "depth", "root_score", "width")


_CAP = f"capped AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY {sql_hash('42', 'id')}, id) <= 6)"


@query("per_post_cap", with_(SQL_C, SQL_W, SQL_F, SQL_CUT, SQL_GATE, SQL_CAND, _CAP) + "SELECT id, link_key FROM capped")
def per_post_cap(spark, d):
    return S.cap_per_group(K.candidates(*_parts(spark, d), min_root_score=3), ["link_key"], 6, "42", "id").select("id", "link_key")


@query("uniform_posts", with_(SQL_C) + f"SELECT link_key FROM (SELECT DISTINCT link_key FROM c WHERE link_key IS NOT NULL) ORDER BY {sql_hash('7', 'link_key')}, link_key LIMIT 100")
def uniform_posts(spark, d):
    return K.post_sample(narrow(spark, d), 100, "uniform", "7")


@query(
    "pps_sample",
    with_(SQL_C) + f"SELECT link_key, size FROM (SELECT link_key, count(*) AS size FROM c WHERE link_key IS NOT NULL GROUP BY 1) ORDER BY -ln(({sql_hash('7', 'link_key')} + 0.5) / 4294967296.0) / size, link_key LIMIT 100",
)
def pps_sample(spark, d):
    return S.pps_posts(narrow(spark, d), 100, "7")


@query(
    "corpus_records",
    with_(
        SQL_C,
        SQL_W.replace("w AS", "w0 AS"),
        f"posts AS (SELECT link_key FROM (SELECT DISTINCT link_key FROM c WHERE link_key IS NOT NULL) ORDER BY {sql_hash('42', 'link_key')}, link_key LIMIT 400)",
        "cs AS (SELECT * FROM c WHERE link_key IN (SELECT link_key FROM posts))",
        "w AS (SELECT cs.*, coalesce(k.n, 0) AS width FROM cs LEFT JOIN (SELECT parent_key, count(*) AS n FROM cs WHERE parent_key IS NOT NULL GROUP BY 1) k ON k.parent_key = cs.id)",
        SQL_F.replace("FROM c ", "FROM cs ").replace("FROM c)", "FROM cs)").replace("FROM c JOIN", "FROM cs JOIN").replace("c.", "cs."),
        SQL_CUT,
        "gate AS (SELECT cs.link_key, max(coalesce(cs.score, 0)) AS root_score FROM f JOIN cs USING (id) WHERE f.depth = 0 GROUP BY 1 HAVING max(coalesce(cs.score, 0)) >= 0)",
        SQL_CAND,
        f"capped AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY {sql_hash('42', 'id')}, id) <= 8)",
    )
    + """SELECT capped.id, coalesce(score, 0) AS score, coalesce(controversiality, 0) AS controversiality, width, CAST(capped.depth AS INTEGER) AS depth, root_score,
      CAST(least(capped.depth, 65) AS INTEGER) AS n_context, coalesce(split_part(f.path[len(f.path) - 1], ':', 2), '') AS parent_in_context
    FROM capped JOIN f ON f.id = capped.id""",
)
def corpus_records(spark, d):
    r = K.records(dump(spark, d), max_posts=400)
    return r.select("id", "ground_truth.score", F.col("ground_truth.controversiality").cast("bigint").alias("controversiality"), "ground_truth.width", "meta.depth", "meta.root_score", F.size("context").alias("n_context"), F.coalesce(F.try_element_at("context", F.lit(-1))["id"], F.lit("")).alias("parent_in_context"))


SQL_SPLIT = f"""posts AS (SELECT link_key, CASE WHEN row_number() OVER (ORDER BY {sql_hash('42', 'link_key')}, link_key) <= floor((SELECT count(DISTINCT link_key) FROM c) * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT DISTINCT link_key FROM c WHERE link_key IS NOT NULL))"""


@query("post_disjoint_split", with_(SQL_C, SQL_SPLIT) + "SELECT id, split FROM c JOIN posts USING (link_key)")
def post_disjoint_split(spark, d):
    return K.post_split(narrow(spark, d), 0.2, "42").select("id", "split")


@query("random_regime", with_(SQL_C, SQL_SPLIT) + "SELECT subreddit, split, count(*) AS n, count(DISTINCT link_key) AS posts FROM c JOIN posts USING (link_key) GROUP BY ALL")
def random_regime(spark, d):
    return K.post_split(narrow(spark, d), 0.2, "42").groupBy("subreddit", "split").agg(F.count("*").alias("n"), F.count_distinct("link_key").alias("posts"))


SQL_TEMPORAL = f"""m AS (SELECT *, {MONTH} AS month FROM c WHERE created_utc IS NOT NULL), tm AS (SELECT DISTINCT month FROM m ORDER BY month DESC LIMIT 2),
  ts AS (SELECT id, month, link_key, 'test' AS split FROM m WHERE month IN (SELECT month FROM tm)),
  tr AS (SELECT id, month, link_key, 'train' AS split FROM m WHERE month NOT IN (SELECT month FROM tm) AND link_key NOT IN (SELECT link_key FROM ts WHERE link_key IS NOT NULL))"""


@query("temporal_split", with_(SQL_C, SQL_TEMPORAL) + "SELECT id, month, split FROM ts UNION ALL SELECT id, month, split FROM tr")
def temporal_split(spark, d):
    return K.temporal_split(narrow(spark, d), 2).select("id", "month", "split")


@query(
    "overlap_check",
    with_(SQL_R)
    + """SELECT (SELECT count(*) FROM (SELECT meta.link_id AS k FROM r WHERE split = 'train' AND meta.link_id IS NOT NULL INTERSECT SELECT meta.link_id FROM r WHERE split <> 'train')) AS posts,
  (SELECT count(*) FROM (SELECT stimulus.id FROM r WHERE split = 'train' INTERSECT SELECT stimulus.id FROM r WHERE split <> 'train')) AS stimuli,
  (SELECT count(stimulus.id) - count(DISTINCT stimulus.id) FROM r) AS duplicates""",
)
def overlap_check(spark, d):
    r = once(spark, d).select("split", F.col("meta.link_id").alias("post"), F.col("stimulus.id").alias("stimulus"))
    return K.overlap(r.filter("post is not null"), "post", "post").select("posts").crossJoin(K.overlap(r, "stimulus", "stimulus").select("stimuli", "duplicates"))


@query(
    "balance_binary",
    with_(SQL_R, "p AS (SELECT record_id, coalesce(ground_truth.controversiality = 1, false) AS positive FROM r)")
    + f"SELECT * FROM p WHERE positive UNION ALL (SELECT * FROM p WHERE NOT positive ORDER BY {sql_hash('3', 'CAST(record_id AS VARCHAR)')}, record_id LIMIT (SELECT CAST(floor(count(*) * 2.0) AS BIGINT) FROM p WHERE positive))",
)
def balance_binary(spark, d):
    rows = once(spark, d).select("record_id", F.coalesce(F.col("ground_truth.controversiality") == 1, F.lit(False)).alias("positive"))
    return S.balanced(rows, F.col("positive"), 2.0, "3", "record_id")


@query(
    "stratified_round_robin",
    with_(
        SQL_C,
        SQL_W,
        f"s AS (SELECT id, subreddit, {MONTH} AS month, {BUCKET} AS bucket FROM w WHERE width >= 1 AND created_utc IS NOT NULL)",
        "q AS (SELECT greatest(1, 300 // (SELECT count(*) FROM (SELECT DISTINCT subreddit, bucket FROM s))) AS quota)",
        f"a AS (SELECT s.*, row_number() OVER (PARTITION BY subreddit, bucket, month ORDER BY {sql_hash('5', 'id')}, id) AS rn, dense_rank() OVER (PARTITION BY subreddit, bucket ORDER BY month) - 1 AS place, count(*) OVER (PARTITION BY subreddit, bucket) AS n_rows FROM s)",
        "b AS (SELECT *, max(place) OVER (PARTITION BY subreddit, bucket) + 1 AS months FROM a)",
        "t AS (SELECT *, (rn - 1) * months + place AS turn FROM b WHERE (rn - 1) * months + place <= 2 * n_rows + months)",
        "k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY subreddit, bucket ORDER BY turn) <= (SELECT quota FROM q))",
    )
    + f"SELECT id, subreddit, bucket, month FROM k ORDER BY {sql_hash('5|cut', 'id')}, id LIMIT 300",
)
def stratified_round_robin(spark, d):
    rows = K.strata(with_width(narrow(spark, d))).select("id", "subreddit", "bucket", "month")
    return S.round_robin(staged(rows, "strata"), ["subreddit", "bucket"], "month", 300, "5", "id")


@query(
    "reply_recovery",
    with_(SQL_C, SQL_W, f"s AS (SELECT id, link_key FROM w WHERE width >= 1 QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY {sql_hash('9', 'id')}, id) <= 4)")
    + """SELECT s.id, CAST(count(k.id) AS INTEGER) AS n_replies, coalesce(string_agg(k.id, ',' ORDER BY k.ord), '') AS replies, coalesce(sum(length(left(coalesce(k.body, ''), 1500))), 0) AS n_chars
    FROM s LEFT JOIN (SELECT * FROM c WHERE link_key IN (SELECT link_key FROM s)) k ON k.parent_key = s.id GROUP BY s.id""",
)
def reply_recovery(spark, d):
    c = staged(dump(spark, d), "comments")
    stimuli = S.cap_per_group(with_width(c).filter("width >= 1"), ["link_key"], 4, "9", "id").select("id", "link_key")
    r = K.replies_of(stimuli, c)
    chars = F.aggregate("replies", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["body"]))
    return r.select("id", F.size("replies").alias("n_replies"), F.array_join(F.col("replies.id"), ",").alias("replies"), chars.alias("n_chars"))


@query(
    "live_replies",
    with_(SQL_R) + "SELECT record_id, CAST(len(list_filter(coalesce(replies, []), lambda x: coalesce(x.body, '') NOT IN ('[removed]', '[deleted]'))) AS INTEGER) AS n_live, len(list_filter(coalesce(replies, []), lambda x: coalesce(x.body, '') NOT IN ('[removed]', '[deleted]'))) > 0 AS summarizable FROM r",
)
def live_replies(spark, d):
    return once(spark, d).select("record_id", K.live().alias("n_live"), (K.live() > 0).alias("summarizable"))


@query("row_split", with_(SQL_R) + f"SELECT record_id, CASE WHEN row_number() OVER (ORDER BY {sql_hash('42', 'CAST(record_id AS VARCHAR)')}, record_id) <= floor((SELECT count(*) FROM r) * (1 - 0.2)) THEN 'train' ELSE 'test' END AS part FROM r")
def row_split(spark, d):
    return S.first_by_hash(once(spark, d).select("record_id"), None, "42", "record_id", 1 - 0.2).select("record_id", F.when(F.col("chosen"), "train").otherwise("test").alias("part"))


@query("shuffled_limit", with_(SQL_R) + f"SELECT record_id, split FROM r ORDER BY {sql_hash('11', 'CAST(record_id AS VARCHAR)')}, record_id LIMIT 200")
def shuffled_limit(spark, d):
    return S.hash_limit(once(spark, d).select("record_id", "split"), 200, "11", "record_id")


@query("shards", with_(SQL_R) + f"SELECT record_id, CAST({sql_hash('s', 'CAST(record_id AS VARCHAR)')} % 4 AS INTEGER) AS shard FROM r")
def shards(spark, d):
    return once(spark, d).select("record_id", F.pmod(hash_unit("s", F.col("record_id")), F.lit(4)).cast("int").alias("shard"))


@query(
    "forecast_splits",
    with_(SQL_R, "e AS (SELECT record_id, split, regexp_replace(meta.link_id, '^[^_]*_', '') AS post FROM r)")
    + "SELECT record_id, split FROM e WHERE split <> 'train' UNION ALL SELECT record_id, split FROM e WHERE split = 'train' AND (post IS NULL OR post NOT IN (SELECT post FROM e WHERE split <> 'train' AND post IS NOT NULL))",
)
def forecast_splits(spark, d):
    e = once(spark, d).select("record_id", "split", bare_id(F.col("meta.link_id")).alias("post"))
    held = e.filter("split <> 'train'")
    return held.unionByName(K.without_posts(e.filter("split = 'train'"), held, "post").select("record_id", "split", "post")).select("record_id", "split")


@query("month_difference", with_(SQL_C, SQL_TEMPORAL) + "SELECT DISTINCT month FROM m EXCEPT SELECT month FROM tm")
def month_difference(spark, d):
    months = narrow(spark, d).filter("created_utc is not null").select(F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM").alias("month")).distinct()
    return months.exceptAll(months.orderBy(F.desc("month")).limit(2))
