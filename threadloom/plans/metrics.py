"""Queries of metrics, judging and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import parse as P
from threadloom.functions.text import month_utc
from threadloom.operators import metrics as M
from threadloom.operators.sampling import hash_limit
from threadloom.plans.common import sql_hash, with_
from threadloom.plans.corpus import MONTH, SQL_R, once
from threadloom.session import staged, table

QUERIES, ORACLE_SQL = {}, {}
SQL_M = """m AS (SELECT DISTINCT record_id, predicted.score AS ps, predicted.width AS pw, predicted.controversiality AS pc, ground_truth.score AS ts, ground_truth.width AS tw, ground_truth.controversiality AS tc
  FROM predictions WHERE predicted.score IS NOT NULL AND predicted.width IS NOT NULL AND predicted.controversiality IS NOT NULL AND ground_truth.score IS NOT NULL AND ground_truth.width IS NOT NULL AND ground_truth.controversiality IS NOT NULL)"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def scored(spark, d):
    return M.scored_rows(table(spark, d, "predictions"))


def sql_f1(p: str, t: str, rows: str) -> str:
    n = lambda a, b: f"count(*) FILTER (({p}) = {a} AND ({t}) = {b})"
    f = lambda h, x, y: f"coalesce(2.0 * {h} / nullif(2.0 * {h} + {x} + {y}, 0), 0)"
    tp, fp, fn, tn = n("true", "true"), n("true", "false"), n("false", "true"), n("false", "false")
    return f"({f(tp, fp, fn)} + {f(tn, fn, fp)}) / 2"


def sql_rank(x: str, keys: str = "") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    more = f"PARTITION BY {keys + ', ' if keys else ''}{x}"
    return f"rank() OVER ({by}ORDER BY {x}) + (count(*) OVER ({more}) - 1) / 2.0"


SQL_RHO = "CASE WHEN count(*) >= 2 THEN round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) END"


@query("mse_mae", with_(SQL_M) + "SELECT count(*) AS n, round(avg(power(ps - ts, 2)), 6) AS score_mse, round(avg(abs(ps - ts)), 6) AS score_mae, round(avg(power(pw - tw, 2)), 6) AS width_mse, round(avg(abs(pw - tw)), 6) AS width_mae FROM m")
def mse_mae(spark, d):
    c = F.col
    return scored(spark, d).agg(F.count("*").alias("n"), F.round(M.mse(c("ps"), c("ts")), 6).alias("score_mse"), F.round(M.mae(c("ps"), c("ts")), 6).alias("score_mae"), F.round(M.mse(c("pw"), c("tw")), 6).alias("width_mse"), F.round(M.mae(c("pw"), c("tw")), 6).alias("width_mae"))


@query("f1_macro", with_(SQL_M) + f"SELECT round({sql_f1('pc = 1', 'tc = 1', 'm')}, 6) AS f1, round(coalesce(avg(CAST(pc = 1 AS DOUBLE)), 0), 6) AS rate_pred, round(coalesce(avg(CAST(tc = 1 AS DOUBLE)), 0), 6) AS rate_true FROM m")
def f1_macro(spark, d):
    rate = lambda x: F.round(F.coalesce(F.avg((F.col(x) == 1).cast("double")), F.lit(0.0)), 6)
    return scored(spark, d).agg(F.round(M.f1_macro(F.col("pc"), F.col("tc")), 6).alias("f1"), rate("pc").alias("rate_pred"), rate("tc").alias("rate_true"))


@query("spearman", with_(SQL_M, f"s AS (SELECT {sql_rank('ps')} AS rx, {sql_rank('ts')} AS ry FROM m)", f"w AS (SELECT {sql_rank('pw')} AS rx, {sql_rank('tw')} AS ry FROM m)") + f"SELECT 'score' AS target, {SQL_RHO} AS rho, count(*) AS n FROM s UNION ALL SELECT 'width', {SQL_RHO}, count(*) FROM w")
def spearman(spark, d):
    m = staged(scored(spark, d), "scored")
    one = lambda t, x, y: M.spearman(m, [], x, y).select(F.lit(t).alias("target"), F.round("rho", 6).alias("rho"), "n")
    return one("score", "ps", "ts").unionByName(one("width", "pw", "tw"))


@query("average_ranks", with_(SQL_M) + f"SELECT record_id, {sql_rank('ps')} AS rank_pred, {sql_rank('ts')} AS rank_true FROM m")
def average_ranks(spark, d):
    m = scored(spark, d)
    return M.average_ranks(M.average_ranks(m, [], "ps", "rank_pred"), [], "ts", "rank_true").select("record_id", "rank_pred", "rank_true")


@query(
    "pairwise_accuracy",
    with_(SQL_M, f"s AS (SELECT * FROM m ORDER BY {sql_hash('pairs', 'CAST(record_id AS VARCHAR)')}, record_id LIMIT 5000)")
    + "SELECT round(count(*) FILTER (sign(a.ps - b.ps) = sign(a.ts - b.ts)) / nullif(count(*), 0), 6) AS pairwise_accuracy, count(*) AS n_pairs FROM s a JOIN s b ON a.record_id < b.record_id AND a.ts <> b.ts",
)
def pairwise_accuracy(spark, d):
    return M.pairwise_accuracy(hash_limit(scored(spark, d), M.PAIR_ROWS, "pairs", "record_id"), "ps", "ts").select(F.round("pairwise_accuracy", 6).alias("pairwise_accuracy"), "n_pairs")


@query(
    "hurdle",
    with_(SQL_M, f"p AS (SELECT {sql_rank('pw')} AS rx, {sql_rank('tw')} AS ry FROM m WHERE tw > 0)")
    + f"SELECT round({sql_f1('pw > 0', 'tw > 0', 'm')}, 6) AS width_any_f1, round(avg(CAST(tw > 0 AS DOUBLE)), 6) AS rate_true, round(avg(CAST(pw > 0 AS DOUBLE)), 6) AS rate_pred, count(*) FILTER (tw > 0) AS n_width_pos, (SELECT CASE WHEN count(*) > 2 THEN {SQL_RHO} END FROM p) AS width_rho_pos FROM m",
)
def hurdle(spark, d):
    h = M.hurdle(staged(scored(spark, d), "scored"))
    return h.select(*[F.round(c, 6).alias(c) if c != "n_width_pos" else F.col(c) for c in h.columns])


@query(
    "tie_diagnosis",
    with_(SQL_M, f"s AS (SELECT {sql_rank('round_even(ps / 3.0, 0)')} AS rx, {sql_rank('ts')} AS ry FROM m)", f"u AS (SELECT {sql_rank('ps')} AS rx, {sql_rank('ts')} AS ry FROM m)")
    + f"SELECT count(DISTINCT round_even(ps / 3.0, 0)) AS unique_rounded, count(DISTINCT ps) AS unique_raw, (SELECT {SQL_RHO} FROM s) AS rho_rounded, (SELECT {SQL_RHO} FROM u) AS rho_raw FROM m",
)
def tie_diagnosis(spark, d):
    """Rank correlation before and after predictions are rounded to coarse steps."""
    m = staged(scored(spark, d).withColumn("rounded", F.bround(F.col("ps") / 3.0)), "scored")
    n = m.agg(F.count_distinct("rounded").alias("unique_rounded"), F.count_distinct("ps").alias("unique_raw"))
    rho = lambda x, name: M.spearman(m, [], x, "ts", name).select(F.round(name, 6).alias(name))
    return n.crossJoin(rho("rounded", "rho_rounded")).crossJoin(rho("ps", "rho_raw"))


B = 40
SQL_BOOT = f"""o AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS ord FROM m), n AS (SELECT count(*) AS n FROM m),
  draw AS (SELECT b, {sql_hash('boot', "b || '|' || ord")} % n AS ord FROM (SELECT ord, unnest(range({B})) AS b FROM o), n),
  x AS (SELECT draw.b, o.* FROM draw JOIN o USING (ord)),
  xr AS (SELECT b, {sql_rank('ps', 'b')} AS rx, {sql_rank('ts', 'b')} AS ry FROM x), yr AS (SELECT b, {sql_rank('pw', 'b')} AS rx, {sql_rank('ts', 'b')} AS ry FROM x),
  rs AS (SELECT b, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM xr GROUP BY b), rw AS (SELECT b, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM yr GROUP BY b)"""


def _replicates(spark, d):
    x = staged(M.resampled(scored(spark, d), "record_id", B, "boot"), "replicates")
    return M.spearman(x, ["b"], "ps", "ts"), M.spearman(x, ["b"], "pw", "ts")


@query("bootstrap_ci", with_(SQL_M, SQL_BOOT) + "SELECT round(quantile_cont(rho, 0.025), 6) AS low, round(quantile_cont(rho, 0.975), 6) AS high FROM rs")
def bootstrap_ci(spark, d):
    ci = M.interval(_replicates(spark, d)[0], "rho")
    return ci.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "paired_delta",
    with_(SQL_M, SQL_BOOT, "dl AS (SELECT rs.rho - rw.rho AS d FROM rs JOIN rw USING (b))")
    + "SELECT round(avg(d), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(2 * least(avg(CAST(d <= 0 AS DOUBLE)), avg(CAST(d >= 0 AS DOUBLE))), 6) AS p FROM dl",
)
def paired_delta(spark, d):
    """Score against width prediction as two models of the same target, on shared draws."""
    out = M.paired_delta(*_replicates(spark, d), "rho")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


SQL_MONTHLY = f"""e AS (SELECT m.*, {MONTH.replace('created_utc', 'r.meta.created_utc')} AS month, r.meta.subreddit AS subreddit FROM m JOIN r USING (record_id)),
  k AS (SELECT month, {sql_rank('ps', 'month')} AS rx, {sql_rank('ts', 'month')} AS ry FROM e), g AS (SELECT month, {SQL_RHO} AS rho, count(*) AS n FROM k GROUP BY month)"""


def _monthly(spark, d):
    r = once(spark, d).select("record_id", month_utc(F.col("meta.created_utc")).alias("month"), "meta.subreddit")
    e = staged(scored(spark, d).join(r, "record_id"), "monthly")
    return e, M.spearman(e, ["month"], "ps", "ts").withColumn("rho", F.round("rho", 6))


@query("temporal_decay", with_(SQL_M, SQL_R, SQL_MONTHLY) + "SELECT month, rho, n, CAST((CAST(month[1:4] AS INT) - (SELECT CAST(min(month)[1:4] AS INT) FROM g)) * 12 + CAST(month[6:7] AS INT) - (SELECT CAST(min(month)[6:7] AS INT) FROM g) AS INTEGER) AS horizon FROM g")
def temporal_decay(spark, d):
    from threadloom.functions.text import months_between

    g = staged(_monthly(spark, d)[1], "months")
    home = g.agg(F.min("month").alias("home"))
    return g.crossJoin(F.broadcast(home)).select("month", "rho", "n", months_between(F.col("home"), F.col("month")).alias("horizon"))


@query(
    "horizon_slope",
    with_(SQL_M, SQL_R, SQL_MONTHLY, "h AS (SELECT rho, (CAST(month[1:4] AS INT) * 12 + CAST(month[6:7] AS INT)) - (SELECT min(CAST(month[1:4] AS INT) * 12 + CAST(month[6:7] AS INT)) FROM g) AS h FROM g WHERE rho IS NOT NULL)")
    + "SELECT count(*) AS points, CASE WHEN count(*) > 2 THEN round(covar_pop(h, rho) / nullif(var_pop(h), 0) * 12, 6) END AS slope_per_year FROM h",
)
def horizon_slope(spark, d):
    g = staged(_monthly(spark, d)[1], "months")
    home = g.agg(F.min("month").alias("home")).first()["home"]
    return M.horizon_slope(g, "rho", F.lit(home)).select("points", F.round("slope_per_year", 6).alias("slope_per_year"))


@query("cross_domain", with_(SQL_M, SQL_R, SQL_MONTHLY, f"q AS (SELECT subreddit, ps, ts, {sql_rank('ps', 'subreddit')} AS rx, {sql_rank('ts', 'subreddit')} AS ry FROM e)") + f"SELECT subreddit, {SQL_RHO} AS rho, count(*) AS n, round(avg(abs(ps - ts)), 6) AS score_mae FROM q GROUP BY subreddit")
def cross_domain(spark, d):
    """One scored table, metrics per test set."""
    e, _ = _monthly(spark, d)
    rho = M.spearman(e, ["subreddit"], "ps", "ts")
    err = e.groupBy("subreddit").agg(F.round(M.mae(F.col("ps"), F.col("ts")), 6).alias("score_mae"))
    return rho.join(err, "subreddit").select("subreddit", F.round("rho", 6).alias("rho"), "n", "score_mae")


SQL_PARSE = r"""t AS (SELECT DISTINCT record_id, raw_output AS raw, trim(coalesce(nullif(regexp_extract(raw_output, '(?s)```(?:json)?\s*(.*?)\s*```', 1), ''), raw_output)) AS cand FROM predictions),
  j AS (SELECT record_id, raw, CASE WHEN json_valid(cand) AND json_type(CAST(cand AS JSON)) = 'OBJECT' AND cand <> '{}' THEN CAST(cand AS JSON) END AS j FROM t)"""


def _sql_int(key: str, rx: str) -> str:
    return f"""CASE WHEN j IS NOT NULL THEN CASE json_type(j, '$.{key}') WHEN 'VARCHAR' THEN coalesce(TRY_CAST(nullif(regexp_extract(json_extract_string(j, '$.{key}'), '^\\s*[+-]?\\d+\\s*$'), '') AS BIGINT), 0)
      WHEN 'BOOLEAN' THEN CAST(json_extract_string(j, '$.{key}') = 'true' AS BIGINT) ELSE coalesce(CAST(trunc(TRY_CAST(json_extract_string(j, '$.{key}') AS DOUBLE)) AS BIGINT), 0) END
    ELSE coalesce(TRY_CAST(nullif(regexp_extract(raw, '(?i){rx}', 1), '') AS BIGINT), 0) END"""


@query(
    "parse_prediction",
    with_(SQL_PARSE)
    + f"""SELECT record_id, {_sql_int('score', P.RX['score'])} AS score, {_sql_int('controversiality', P.RX['controversiality'])} AS controversiality, {_sql_int('width', P.RX['width'])} AS width,
    coalesce(CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.reply_summary') ELSE regexp_extract(raw, '(?s){P.RX_SUMMARY}', 1) END, '') AS reply_summary FROM j""",
)
def parse_prediction(spark, d):
    rows = table(spark, d, "predictions").select("record_id", "raw_output").distinct()
    return rows.select("record_id", P.prediction(F.col("raw_output")).alias("p")).select("record_id", "p.*")


_RAW_RATING = "CASE record_id % 4 WHEN 0 THEN '```json\n{\"rating\": ' || vs_replies || '}\n```' WHEN 1 THEN 'rating = ' || vs_replies WHEN 2 THEN '{\"rating\": ' || (vs_replies + 3) || '}' ELSE 'I would say ' || vs_replies END"


@query(
    "parse_rating",
    with_(f"t AS (SELECT DISTINCT record_id, {_RAW_RATING} AS raw FROM ratings)", r"f AS (SELECT record_id, raw, trim(coalesce(nullif(regexp_extract(raw, '(?s)```(?:json)?\s*(.*?)\s*```', 1), ''), raw)) AS cand FROM t)")
    + r"""SELECT record_id, CAST(coalesce(CASE WHEN json_valid(cand) AND TRY_CAST(json_extract_string(CASE WHEN json_valid(cand) THEN cand END, '$.rating') AS INT) BETWEEN 1 AND 5 THEN TRY_CAST(json_extract_string(cand, '$.rating') AS INT) END,
      TRY_CAST(nullif(regexp_extract(raw, '"?rating"?\s*[:=]\s*([1-5])', 1), '') AS INT)) AS INTEGER) AS rating FROM f""",
)
def parse_rating(spark, d):
    rows = table(spark, d, "ratings").select("record_id", F.expr(_RAW_RATING.replace("\n", "\\n")).alias("raw")).distinct()
    return rows.select("record_id", P.rating(F.col("raw")).alias("rating"))


_RAW_SUMMARY = "CASE record_id % 3 WHEN 0 THEN '{\"summary\": \"' || replace(predicted_summary, '\"', '') || '\"}' WHEN 1 THEN '\"' || replace(predicted_summary, '\"', '') || '\"' ELSE predicted_summary END"


@query(
    "parse_summary",
    with_(f"t AS (SELECT DISTINCT record_id, model, trim({_RAW_SUMMARY}) AS raw FROM predicted_summaries)")
    + "SELECT record_id, model, CASE WHEN json_valid(raw) THEN nullif(CASE json_type(CAST(raw AS JSON)) WHEN 'OBJECT' THEN CASE WHEN trim(json_extract_string(raw, '$.summary')) <> '' THEN json_extract_string(raw, '$.summary') END WHEN 'VARCHAR' THEN CASE WHEN trim(json_extract_string(raw, '$')) <> '' THEN json_extract_string(raw, '$') END END, '') END AS summary FROM t",
)
def parse_summary(spark, d):
    rows = table(spark, d, "predicted_summaries").select("record_id", "model", F.expr(_RAW_SUMMARY).alias("raw")).select("record_id", "model", F.trim("raw").alias("raw")).distinct()
    return rows.select("record_id", "model", P.summary(F.col("raw")).alias("summary"))


SQL_COMMON = "u AS (SELECT record_id, model FROM predicted_summaries WHERE trim(predicted_summary) <> '' GROUP BY ALL), common AS (SELECT record_id FROM u GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM u))"


def _common(spark, d):
    u = table(spark, d, "predicted_summaries").filter("trim(predicted_summary) <> ''").select("record_id", "model").distinct()
    n = u.agg(F.count_distinct("model").alias("n"))
    return u.groupBy("record_id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).filter("k = n").select("record_id")


@query("common_ids", with_(SQL_COMMON) + "SELECT record_id FROM common")
def common_ids(spark, d):
    """Records that every model answered."""
    return _common(spark, d)


@query("nonempty_summaries", "SELECT DISTINCT record_id, predicted_summary, model FROM predicted_summaries WHERE trim(predicted_summary) <> ''")
def nonempty_summaries(spark, d):
    return table(spark, d, "predicted_summaries").filter("trim(predicted_summary) <> ''").select("record_id", "predicted_summary", "model").distinct()


@query(
    "usable_summaries",
    with_(SQL_R) + "SELECT DISTINCT p.record_id, p.model FROM predicted_summaries p JOIN r USING (record_id) WHERE length(trim(p.predicted_summary)) >= 10 AND length(trim(r.reply_summary)) >= 10 AND trim(r.reply_summary) NOT IN ('No replies.', 'Failed')",
)
def usable_summaries(spark, d):
    gold = once(spark, d).filter("length(trim(reply_summary)) >= 10 and trim(reply_summary) not in ('No replies.', 'Failed')").select("record_id")
    return table(spark, d, "predicted_summaries").filter("length(trim(predicted_summary)) >= 10").select("record_id", "model").distinct().join(gold, "record_id", "left_semi")


@query("rating_distribution", "SELECT CAST(vs_replies AS INTEGER) AS rating, count(*) AS n FROM (SELECT DISTINCT * FROM ratings) GROUP BY 1")
def rating_distribution(spark, d):
    return table(spark, d, "ratings").distinct().groupBy(F.col("vs_replies").alias("rating")).agg(F.count("*").alias("n"))


@query(
    "judge_aggregate",
    with_(SQL_COMMON, "t AS (SELECT DISTINCT * FROM ratings), j AS (SELECT u.model, t.* FROM u JOIN common USING (record_id) JOIN t USING (record_id))")
    + "SELECT model, count(*) AS n, round(avg(vs_replies), 6) AS mean_replies, round(avg(vs_summary), 6) AS mean_summary, count(*) FILTER (vs_replies >= 4) AS n_good FROM j GROUP BY model",
)
def judge_aggregate(spark, d):
    u = table(spark, d, "predicted_summaries").filter("trim(predicted_summary) <> ''").select("record_id", "model").distinct()
    j = u.join(_common(spark, d), "record_id", "left_semi").join(table(spark, d, "ratings").distinct(), "record_id")
    return j.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("vs_replies"), 6).alias("mean_replies"), F.round(F.avg("vs_summary"), 6).alias("mean_summary"), F.count_if(F.col("vs_replies") >= 4).alias("n_good"))


@query("judge_todo", with_(SQL_R) + "SELECT record_id, split FROM r WHERE split <> 'train' AND summarizable AND record_id NOT IN (SELECT record_id FROM ratings)")
def judge_todo(spark, d):
    """What is left to judge: evaluation records without a rating yet."""
    return once(spark, d).filter("split <> 'train' and summarizable").select("record_id", "split").join(table(spark, d, "ratings").select("record_id"), "record_id", "left_anti")


@query("eval_pool", with_(SQL_R) + f"SELECT record_id, split FROM r WHERE summarizable ORDER BY CASE WHEN split = 'test' THEN 0 ELSE 1 END, {sql_hash('pool', 'CAST(record_id AS VARCHAR)')}, record_id LIMIT 250")
def eval_pool(spark, d):
    """Test records first, filled up from the others to the limit."""
    from threadloom.functions.ids import hash_unit

    rows = once(spark, d).filter("summarizable").select("record_id", "split")
    return rows.orderBy(F.when(F.col("split") == "test", 0).otherwise(1), hash_unit("pool", F.col("record_id")), "record_id").limit(250)


@query("usable_examples", with_(SQL_R) + "SELECT record_id FROM r WHERE stimulus.id IS NOT NULL AND ground_truth.score IS NOT NULL AND ground_truth.reply_summary IS NOT NULL")
def usable_examples(spark, d):
    return once(spark, d).filter("stimulus.id is not null and ground_truth.score is not null and ground_truth.reply_summary is not null").select("record_id")


@query("evaluate_results", with_("s AS (SELECT DISTINCT * FROM (SELECT record_id, predicted, ground_truth FROM predictions))") + "SELECT count(*) AS n, count(*) FILTER (predicted.score IS NULL OR ground_truth.score IS NULL) AS skipped FROM s")
def evaluate_results(spark, d):
    rows = table(spark, d, "predictions").select("record_id", "predicted", "ground_truth").distinct()
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("predicted.score").isNull() | F.col("ground_truth.score").isNull()).alias("skipped"))
