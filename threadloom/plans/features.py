"""Queries of features, neighbours, predictors and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import prompts as PR
from threadloom.functions.ids import hash_unit
from threadloom.operators import features as X
from threadloom.operators import knn as N
from threadloom.operators import predictors as B
from threadloom.plans.common import sql_hash, with_
from threadloom.plans.corpus import BUCKET, SQL_R, once
from threadloom.session import staged, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


_TS = "coalesce(stimulus.created_utc, 0)"
SQL_X = rf"""x AS (SELECT record_id, split, CAST(len(context) AS DOUBLE) AS depth,
  CASE WHEN {_TS} > 0 THEN CAST(hour(make_timestamp({_TS} * 1000000)) AS DOUBLE) ELSE 0.0 END AS hour, CASE WHEN {_TS} > 0 THEN CAST(isodow(make_timestamp({_TS} * 1000000)) - 1 AS DOUBLE) ELSE 0.0 END AS weekday,
  round(ln(1 + greatest(coalesce(context[-1].score, 0), 0)), 6) AS parent_score, CAST(coalesce(context[-1].controversiality, 0) AS DOUBLE) AS parent_contr, round(ln(1 + greatest(coalesce(context[1].score, 0), 0)), 6) AS root_score, CAST(len(context) AS DOUBLE) AS n_context,
  CAST(length(coalesce(stimulus.body, '')) AS DOUBLE) AS n_chars, CAST(len(list_filter(string_split_regex(coalesce(stimulus.body, ''), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda w: w <> '')) AS DOUBLE) AS n_words,
  CAST(length(regexp_replace(coalesce(stimulus.body, ''), '[^!?.,;:]', '', 'g')) AS DOUBLE) AS n_punct, round(coalesce(length(regexp_replace(coalesce(stimulus.body, ''), '[^\p{{Lu}}]', '', 'g')) / nullif(length(stimulus.body), 0), 0), 6) AS upper_ratio,
  CASE WHEN contains(stimulus.body, 'http://') OR contains(stimulus.body, 'https://') OR contains(stimulus.body, 'www.') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS has_url,
  CAST(length(coalesce(context[-1].body, '')) AS DOUBLE) AS parent_chars, CAST(length(coalesce(context[1].body, '')) AS DOUBLE) AS root_chars,
  ground_truth.score AS score, ground_truth.width AS width, ground_truth.controversiality AS contr FROM r)"""


def _features(spark, d, columns):
    r6 = lambda c: F.round(c, 6).alias(c) if c in ("parent_score", "root_score", "upper_ratio") else F.col(c)
    return X.featured(once(spark, d)).select("record_id", *[r6(c) for c in dict.fromkeys(columns)])


for _name, _cols in (("structural_features", X.STRUCTURAL), ("text_features", X.TEXT), ("lexical_features", X.LEXICAL), ("cascade_drivers", X.CASCADE)):
    QUERIES[_name] = lambda spark, d, cols=tuple(_cols): _features(spark, d, cols)
    ORACLE_SQL[_name] = with_(SQL_R, SQL_X) + f"SELECT record_id, {', '.join(_cols)} FROM x"


@query(
    "gnn_nodes",
    with_(
        SQL_R,
        "p AS (SELECT record_id, list_concat(list_transform(coalesce(context, []), lambda c: struct_pack(body := c.body, score := c.score, contr := c.controversiality, ts := c.created_utc, stim := 0)), [struct_pack(body := stimulus.body, score := CAST(NULL AS BIGINT), contr := CAST(NULL AS BIGINT), ts := stimulus.created_utc, stim := 1)]) AS path FROM r)",
        "u AS (SELECT record_id, len(path) AS n, unnest(path) AS x, unnest(range(len(path))) AS depth FROM p)",
    )
    + """SELECT record_id, CAST(depth - greatest(n - 12, 0) AS INTEGER) AS pos, round(ln(1 + greatest(coalesce(x.score, 0), 0)), 6) AS log_score, CAST(coalesce(x.contr, 0) AS DOUBLE) AS contr, CAST(depth AS DOUBLE) AS depth,
    round(ln(1 + length(coalesce(x.body, ''))), 6) AS log_chars, round(CASE WHEN coalesce(x.ts, 0) > 0 THEN hour(make_timestamp(x.ts * 1000000)) ELSE 0 END / 23.0, 6) AS hour, CAST(x.stim AS DOUBLE) AS is_stimulus FROM u WHERE depth >= n - 12""",
)
def gnn_nodes(spark, d):
    n = X.nodes(once(spark, d))
    return n.select("record_id", "pos", *[F.round(c, 6).alias(c) if c in ("log_score", "log_chars", "hour") else F.col(c) for c in n.columns[2:]])


def _sql_u(tag: str, j: int) -> str:
    return f"(({sql_hash(tag, f'coalesce(stimulus.id, CAST(record_id AS VARCHAR)) || {chr(39)}|{j}{chr(39)}')} + 0.5) / 4294967296.0)"


@query("noise_block", with_(SQL_R) + "SELECT record_id, " + ", ".join(f"round(sqrt(-2 * ln({_sql_u('u', j)})) * cos(2 * 3.141592653589793 * {_sql_u('v', j)}), 6) AS noise_{j}" for j in range(8)) + " FROM r")
def noise_block(spark, d):
    n = X.noise(once(spark, d), 8)
    return n.select("record_id", *[F.round(c, 6).alias(c) for c in n.columns[1:]])


@query("record_text", with_(SQL_R) + "SELECT record_id, md5(array_to_string(list_transform(coalesce(context, []), lambda c: coalesce(c.body, '')), ' \n ') || ' [SEP] ' || coalesce(stimulus.body, '')) AS text_key, sha1(left(coalesce(stimulus.body, ''), 1000)) AS embedding_key FROM r")
def record_text(spark, d):
    return once(spark, d).select("record_id", F.md5(X.record_text()).alias("text_key"), F.sha1(F.substring(F.coalesce(F.col("stimulus.body"), F.lit("")), 1, 1000)).alias("embedding_key"))


@query("width_buckets", with_(SQL_R, "b AS (SELECT record_id, meta.subreddit AS subreddit, ground_truth.width AS width FROM r)") + f"SELECT subreddit, {BUCKET} AS bucket, count(*) AS n FROM b GROUP BY ALL")
def width_buckets(spark, d):
    from threadloom.functions.text import width_bucket

    return once(spark, d).groupBy(F.col("meta.subreddit").alias("subreddit"), width_bucket(F.col("ground_truth.width")).alias("bucket")).agg(F.count("*").alias("n"))


@query("knn_dense", "WITH s AS (SELECT q.vec_id AS query, e.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) SELECT query, vec_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5")
def knn_dense(spark, d):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    e = table(spark, d, "embeddings")
    return N.dense_neighbours(e, e.filter("vec_id % 50 = 0"), 5).select("query", "vec_id", "rank")


@query("knn_label", "WITH s AS (SELECT q.vec_id AS query, e.vec_id, e.label, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) <= 5), v AS (SELECT query, label, round(sum(greatest(sim, 1e-8)), 4) AS w FROM k GROUP BY ALL) SELECT query, arg_max(label, w * 1000 - label) AS label FROM v GROUP BY query")
def knn_label(spark, d):
    """Label of greatest summed similarity among five neighbours, the smaller label on ties."""
    e = table(spark, d, "embeddings")
    near = N.dense_neighbours(e, e.filter("vec_id % 50 = 0"), 5).join(e.select("vec_id", "label"), "vec_id")
    votes = near.groupBy("query", "label").agg(F.round(F.sum(F.greatest("sim", F.lit(1e-8))), 4).alias("w"))
    return votes.groupBy("query").agg(F.max_by("label", F.col("w") * 1000 - F.col("label")).alias("label"))


@query("tfidf_weights")
def tfidf_weights(spark, d):
    rows = once(spark, d).select("record_id", F.col("stimulus.body").alias("body"))
    return N.tfidf(rows, "record_id", "body")


@query("knn_tfidf")
def knn_tfidf(spark, d):
    """Predictions for records whose id is divisible by 50 from the five nearest others by TF-IDF."""
    r = once(spark, d)
    v = staged(N.tfidf(r.select("record_id", F.col("stimulus.body").alias("body")), "record_id", "body"), "tfidf")
    near = N.sparse_neighbours(v, r.filter("record_id % 50 = 0").select("record_id"), 5, "record_id")
    truth = r.select("record_id", F.col("ground_truth.score").alias("score"), F.col("ground_truth.width").alias("width"), F.col("ground_truth.controversiality").alias("contr"), F.coalesce(F.col("ground_truth.reply_summary"), F.lit("")).alias("reply_summary"))
    return N.aggregated(near, truth, "record_id")


def _constants(spark, d, name):
    x = staged(X.featured(once(spark, d)), "features")
    return B.get(name)().fit(x.filter("split = 'train'")).predict(x.filter("split = 'test'"))


_FLAG = "CAST(count(*) FILTER (contr = 1) > count(contr) / 2 AS INTEGER) AS contr"


@query("constant_mean", with_(SQL_R, SQL_X, f"t AS (SELECT avg(score) AS s, avg(width) AS w, {_FLAG} FROM x WHERE split = 'train')") + "SELECT record_id, CAST(round_even(greatest(t.s, 0), 0) AS BIGINT) AS score, CAST(round_even(greatest(t.w, 0), 0) AS BIGINT) AS width, t.contr AS controversiality FROM x, t WHERE split = 'test'")
def constant_mean(spark, d):
    return _constants(spark, d, "constant_mean")


@query("constant_median", with_(SQL_R, SQL_X, f"t AS (SELECT quantile_cont(score, 0.5) AS s, quantile_cont(width, 0.5) AS w, {_FLAG} FROM x WHERE split = 'train')") + "SELECT record_id, CAST(round_even(greatest(t.s, 0), 0) AS BIGINT) AS score, CAST(round_even(greatest(t.w, 0), 0) AS BIGINT) AS width, t.contr AS controversiality FROM x, t WHERE split = 'test'")
def constant_median(spark, d):
    return _constants(spark, d, "constant_median")


def _fitted(spark, d, model):
    x = staged(X.featured(once(spark, d)), "features")
    return model.fit(x.filter("split = 'train'")).predict(x.filter("split <> 'train'")).select("record_id", "score", "width", "controversiality")


@query("gbdt")
def gbdt(spark, d):
    return _fitted(spark, d, B.get("feature_gbdt")(20))


@query("structural_prior")
def structural_prior(spark, d):
    return _fitted(spark, d, B.get("structural_prior")(20))


@query("quantile_gbm")
def quantile_gbm(spark, d):
    return _fitted(spark, d, B.get("quantile_gbm")(20))


@query("glm")
def glm(spark, d):
    return _fitted(spark, d, B.get("glm_poisson")())


@query("glm_tweedie")
def glm_tweedie(spark, d):
    return _fitted(spark, d, B.get("glm_tweedie")())


@query("hawkes")
def hawkes(spark, d):
    return _fitted(spark, d, B.get("hawkes")())


@query("feature_ablation")
def feature_ablation(spark, d):
    """Structural and lexical blocks with four noise columns."""
    r = once(spark, d)
    x = staged(X.featured(r).join(X.noise(r, 4), "record_id"), "features")
    return B.get("feature_ablation")(("structural", "lexical"), 10, 4).fit(x.filter("split = 'train'")).predict(x.filter("split <> 'train'")).select("record_id", "score", "width", "controversiality")


@query(
    "prompts",
    with_(SQL_R, "p AS (SELECT *, coalesce(nullif(meta.created_utc, 0), stimulus.created_utc, 0) AS ts, len(context) AS n FROM r)")
    + f"""SELECT record_id, md5('{PR.FORECAST_HEAD}Subreddit: r/' || coalesce(meta.subreddit, stimulus.subreddit, 'None') || '\nPosted: ' || CASE WHEN ts > 0 THEN strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M UTC') ELSE 'unknown' END
    || '\nDepth in thread: ' || coalesce(meta.depth, n) || '\nScore of the parent comment: ' || CASE WHEN n > 0 THEN coalesce(CAST(context[-1].score AS VARCHAR), 'None') ELSE 'n/a' END || '\nScore of the top-level comment in this thread: ' || coalesce(CAST(meta.root_score AS VARCHAR), 'n/a')
    || '\n\nConversation so far (oldest first):\n' || CASE WHEN n > 0 THEN array_to_string(list_transform(list_slice(context, greatest(n - 3, 1), n), lambda c: '- ' || left(coalesce(c.body, ''), 400)), '\n') ELSE '- (none; this is a top-level comment)' END
    || '\n\nThe COMMENT that was just posted:\n' || left(coalesce(stimulus.body, ''), 1500) || '\n\n{PR.FORECAST_TAIL}') AS prompt_key FROM p""",
)
def prompts(spark, d):
    return once(spark, d).select("record_id", F.md5(PR.forecast_prompt()).alias("prompt_key"))


@query("summary_messages", with_(SQL_R) + "SELECT record_id, md5(array_to_string(list_transform(coalesce(replies, []), lambda x: '- ' || coalesce(x.body, '')), '\n\n')) AS message_key FROM r")
def summary_messages(spark, d):
    return once(spark, d).select("record_id", F.md5(PR.summary_message(F.coalesce("replies", F.array()))).alias("message_key"))


@query("record_prompts")
def record_prompts(spark, d):
    return once(spark, d).select("record_id", PR.record_prompt(F.col("context"), F.col("stimulus")).alias("prompt"), PR.target(F.col("ground_truth")).alias("completion"))


@query("mock_generation")
def mock_generation(spark, d):
    """The generative predictor with a stand-in engine: length of the prompt as the score."""
    model = B.Generative(lambda ps: ['{"score": %d, "controversiality": 0, "width": 1, "reply_summary": "ok"}' % (len(p) % 97) for p in ps], PR.forecast_prompt())
    return model.predict(once(spark, d))


@query("pool_sample", with_(SQL_R) + f"SELECT record_id FROM r WHERE split = 'test' ORDER BY {sql_hash('b', 'CAST(record_id AS VARCHAR)')}, record_id LIMIT 50")
def pool_sample(spark, d):
    """Benchmark subset: a capped, shuffled projection."""
    return once(spark, d).filter("split = 'test'").orderBy(hash_unit("b", F.col("record_id")), "record_id").limit(50).select("record_id")
