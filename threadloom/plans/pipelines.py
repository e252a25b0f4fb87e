"""Queries of composed pipelines: domain builds, task sets, judging, summaries, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import prompts as PR
from threadloom.functions.ids import hash_order
from threadloom.operators import chains as CH
from threadloom.operators import experiments as E
from threadloom.operators import features as X
from threadloom.operators import forest as FO
from threadloom.operators import judging as G
from threadloom.operators import knn as N
from threadloom.operators import neural as _neural  # noqa: F401 - registers its predictors
from threadloom.operators import predictors as B
from threadloom.operators.sampling import first_by_hash
from threadloom.plans.common import SQL_C, SQL_F, SQL_W, narrow, sql_hash, with_
from threadloom.plans.corpus import SQL_R, once
from threadloom.plans.trees import SQL_CH
from threadloom.session import staged, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


_DOMAIN = f"""d AS (SELECT k.leaf_id, w.id AS stimulus_id, coalesce(w.score, 0) AS score, w.width FROM (SELECT id AS leaf_id, path, {sql_hash('8', 'id')} % (length - 1) AS cut FROM chain WHERE length >= 3) k JOIN w ON w.id = split_part(k.path[k.cut + 1], ':', 2))"""


@query("domain_records", with_(SQL_C, SQL_W, SQL_F, SQL_CH, _DOMAIN) + f"SELECT leaf_id, stimulus_id, score, width, CASE WHEN row_number() OVER (ORDER BY {sql_hash('8', 'leaf_id')}, leaf_id) <= floor((SELECT count(*) FROM d) * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split FROM d")
def domain_records(spark, d):
    """Chain records of a dump (a comment can recur), split by row in hash order."""
    c = staged(narrow(spark, d), "comments")
    rows = CH.chain_sets(c, CH.chains(c, FO.forest(c)), "8")
    marked = first_by_hash(staged(rows, "records"), None, "8", "leaf_id", 1 - 0.2)
    return marked.select("leaf_id", "stimulus_id", "score", "width", F.when(F.col("chosen"), "train").otherwise("test").alias("split"))


@query("task_summary_split", with_(SQL_R) + "SELECT record_id, CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS part FROM r WHERE summarizable")
def task_summary_split(spark, d):
    """Summarizable records: in the training ids or else test."""
    r = once(spark, d)
    ids = r.filter("split = 'train'").select("record_id", F.lit(True).alias("known"))
    return r.filter("summarizable").select("record_id").join(ids, "record_id", "left").select("record_id", F.when(F.col("known"), "train").otherwise("test").alias("part"))


@query("cell_names", r"SELECT DISTINCT _source_file, regexp_extract(_source_file, '^RC_(\d{4}-\d{2})', 1) AS month, subreddit || '_' || regexp_extract(_source_file, '^RC_(\d{4}-\d{2})', 1) || '_train' AS cell FROM comments")
def cell_names(spark, d):
    """Month out of a file name, and the name of a cell put together."""
    month = F.regexp_extract("_source_file", r"^RC_(\d{4}-\d{2})", 1)
    return table(spark, d, "comments").select("_source_file", month.alias("month"), F.concat("subreddit", F.lit("_"), month, F.lit("_train")).alias("cell")).distinct()


@query("validation_tail", with_(SQL_R) + f"SELECT record_id, row_number() OVER (ORDER BY {sql_hash('tail', 'CAST(record_id AS VARCHAR)')}, record_id) <= floor(count(*) OVER () * 0.8) AS fit FROM r WHERE split = 'train'")
def validation_tail(spark, d):
    return first_by_hash(once(spark, d).filter("split = 'train'").select("record_id"), None, "tail", "record_id", 0.8).select("record_id", F.col("chosen").alias("fit"))


@query("shuffle_order", with_(SQL_R) + "SELECT record_id, md5('42|' || record_id) AS place FROM r")
def shuffle_order(spark, d):
    return once(spark, d).select("record_id", hash_order("42", F.col("record_id")).alias("place"))


def _sql_cut(x: str, n: int) -> str:
    return f"CASE WHEN length(coalesce({x}, '')) <= {n} THEN coalesce({x}, '') ELSE left({x}, {n}) || '…' END"


_BY_SUMMARY = f"'REFERENCE summary:\n' || {_sql_cut('reference', 800)} || '\n\n'"
SQL_J = "j AS (SELECT p.record_id, r.stimulus.body AS body, r.reply_summary AS reference, p.predicted_summary AS candidate, coalesce(r.replies, []) AS replies FROM (SELECT DISTINCT record_id, predicted_summary FROM predicted_summaries WHERE model = (SELECT min(model) FROM predicted_summaries)) p JOIN r USING (record_id))"


def _to_judge(spark, d):
    s = table(spark, d, "predicted_summaries")
    one = s.join(F.broadcast(s.agg(F.min("model").alias("model"))), "model", "left_semi").select("record_id", F.col("predicted_summary").alias("candidate")).distinct()
    r = once(spark, d).select("record_id", F.col("stimulus.body").alias("body"), F.col("reply_summary").alias("reference"), F.coalesce("replies", F.array()).alias("replies"))
    return r.join(one, "record_id")


@query(
    "judge_prompts",
    with_(SQL_R, SQL_J)
    + f"""SELECT record_id, md5('{PR.JUDGE_HEAD}' || CASE WHEN len(replies) > 0 THEN '{PR.JUDGE_BY_REPLIES}' ELSE '{PR.JUDGE_BY_SUMMARY}' END || '.\n\nCOMMENT:\n' || {_sql_cut('body', 600)} || '\n\n'
    || CASE WHEN len(replies) > 0 THEN 'ACTUAL REPLIES the comment received:\n' || array_to_string(list_transform(list_slice(replies, 1, 12), lambda x: '  - ' || left(coalesce(x.body, ''), 300)), '\n') || '\n\n'
      || CASE WHEN coalesce(reference, '') <> '' THEN 'A neutral summary of those replies:\n' || {_sql_cut('reference', 600)} || '\n\n' ELSE '' END ELSE {_BY_SUMMARY} END
    || 'PREDICTED summary:\n' || {_sql_cut('candidate', 800)} || '\n\n' || '{PR.JUDGE_SCALE}') AS prompt_key FROM j""",
)
def judge_prompts(spark, d):
    c = F.col
    return _to_judge(spark, d).select("record_id", F.md5(PR.judge_prompt(c("body"), c("reference"), c("candidate"), c("replies"))).alias("prompt_key"))


@query("mock_judging")
def mock_judging(spark, d):
    return G.judged(_to_judge(spark, d), G.mock_judge)


@query("mock_summaries")
def mock_summaries(spark, d):
    return G.summarized(once(spark, d), lambda ps: ['{"summary": "%d replies"}' % (p.count("\n\n") + 1) if len(p) % 11 else "cut {" for p in ps])


@query("task_prompts")
def task_prompts(spark, d):
    tasks = ["score", "width", "summary"]
    return once(spark, d).select("record_id", PR.task_prompt(tasks, reason=True).alias("prompt"), PR.task_target(tasks, F.col("ground_truth"), F.col("reply_summary")).alias("target"))


@query("fewshot_prompts")
def fewshot_prompts(spark, d):
    """Four nearest training prompts by TF-IDF before the prompts of the records whose id is divisible by 50."""
    r = staged(once(spark, d).select("record_id", "split", F.col("stimulus.body").alias("body"), PR.forecast_prompt().alias("prompt"), PR.target(F.col("ground_truth")).alias("completion")), "prompts")
    asked = r.filter("record_id % 50 = 0")
    v = staged(N.tfidf(r.filter("split = 'train' or record_id % 50 = 0").select("record_id", "body"), "record_id", "body", 20000), "tfidf")
    near = N.sparse_neighbours(v, asked.select("record_id"), 4, "record_id").join(r.filter("split = 'train'"), "record_id")
    shots = near.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct("prompt", "completion").alias("e")))), lambda x: x["e"]).alias("shots"))
    return asked.join(shots, asked.record_id == shots.query).select("record_id", PR.fewshot(F.col("shots"), F.col("prompt")).alias("prompt"))


def _parts(spark, d):
    x = staged(X.featured(once(spark, d)), "features")
    return x.filter("split = 'train'"), {"validation": x.filter("split = 'validation'"), "test": x.filter("split = 'test'")}


@query("ablation_suite")
def ablation_suite(spark, d):
    """Feature blocks fitted once each and evaluated on both held-out sets."""
    train, tests = _parts(spark, d)
    make = lambda *b: lambda: B.get("feature_ablation")(b, 5)
    return E.sweep({"S": make("structural"), "S+L": make("structural", "lexical"), "mean": B.get("constant_mean")}, train, tests)


@query("data_scaling")
def data_scaling(spark, d):
    train, tests = _parts(spark, d)
    return E.scaling(lambda: B.get("hawkes")(), train, tests["test"], [0.25, 1.0])


@query("grid_search")
def grid_search(spark, d):
    train, _ = _parts(spark, d)
    params, value = E.grid_search(B.get("hawkes"), {"reg": [1e-3, 1.0]}, train)
    return spark.createDataFrame([(str(params), value)], "params string, value double")


@query("retrieval_dense", "WITH s AS (SELECT q.vec_id AS query, e.vec_id, e.label, greatest(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 1e-8) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) <= 5) SELECT query, round(sum(sim * label) / sum(sim), 4) AS value FROM k GROUP BY query")
def retrieval_dense(spark, d):
    """Similarity-weighted mean of a target over five dense neighbours."""
    e = table(spark, d, "embeddings")
    near = N.dense_neighbours(e, e.filter("vec_id % 50 = 0"), 5).join(e.select("vec_id", "label"), "vec_id").withColumn("w", F.greatest("sim", F.lit(1e-8)))
    return near.groupBy("query").agg(F.round(F.sum(F.col("w") * F.col("label")) / F.sum("w"), 4).alias("value"))




def _vectors(spark, d, vectors):
    x = X.featured(once(spark, d)).select("record_id", "split", "score", "width", "contr")
    return staged(x.join(vectors, "record_id"), "vectors")


@query("gnn")
def gnn(spark, d):
    """Path-graph network, fitted on the training records."""
    from threadloom.operators.neural import path_vectors

    rows = _vectors(spark, d, path_vectors(X.nodes(once(spark, d))))
    return B.get("gnn")(8).fit(rows.filter("split = 'train'")).predict(rows.filter("split <> 'train'"))


@query("frozen_mlp")
def frozen_mlp(spark, d):
    """Network over frozen vectors; record ids pick one of the given embeddings."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max("vec_id").alias("n")).first()["n"] or 1
    keyed = once(spark, d).select("record_id", F.pmod(F.col("record_id"), F.lit(n)).alias("vec_id"))
    rows = _vectors(spark, d, keyed.join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id"))
    return B.get("frozen_mlp")("vector", 6).fit(rows.filter("split = 'train'")).predict(rows.filter("split <> 'train'"))
