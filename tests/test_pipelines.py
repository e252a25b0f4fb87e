from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import prompts as PR
from threadloom.operators import experiments as E
from threadloom.operators import judging as G
from threadloom.operators import knn as N
from threadloom.operators import neural
from threadloom.operators import predictors as B

REPLIES = "array<struct<id:string,body:string>>"


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    net = neural.Net(4, (5, 3))
    x, y, w = rng.normal(size=(7, 4)), np.column_stack([rng.normal(size=(7, 2)), rng.integers(0, 2, 7)]), np.ones(7)
    g, v = net.gradient(x, y, w)[1:], net.flat()
    for i in rng.choice(len(v), 15, replace=False):
        up, down = v.copy(), v.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        losses = []
        for p in (up, down):
            n = neural.Net(4, (5, 3))
            n.load(p)
            losses.append(n.gradient(x, y, w)[0])
        assert g[i] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-3)


def test_network_learns(spark):
    rows = [(i, i % 7, i % 7, int(i % 7 > 3), [float(i % 7), 1.0, float(i % 2)]) for i in range(70)]
    df = spark.createDataFrame(rows, "record_id bigint, score bigint, width bigint, contr int, vector array<double>")
    m = neural.VectorNet("vector", (16, 8), 25, 0.03).fit(df)
    assert m.losses[-1] < 0.5 * m.losses[0]
    assert m.predict(df).count() == 70
    with pytest.raises(ValueError):
        neural.VectorNet("vector").fit(df.limit(0))


def test_path_vectors_do_not_wrap(spark):
    nodes = spark.createDataFrame([(1, p, float(p == 0), 0.0, float(p), 0.0, 0.0, float(p == 3)) for p in range(4)], "record_id bigint, pos int, log_score double, contr double, depth double, log_chars double, hour double, is_stimulus double")
    v = neural.path_vectors(nodes).first()["vector"]
    assert len(v) == 18 and v[0] == v[6] == v[12] == 0.0  # the root is three steps away, two rounds don't reach it


def test_judging_and_failing_engines(spark):
    rows = spark.createDataFrame([(1, "b", "ref", "cand", [("r", "x")]), (2, "b", None, None, [])], f"record_id bigint, body string, reference string, candidate string, replies {REPLIES}")
    ok = {r["record_id"]: r for r in G.judged(rows, G.mock_judge).collect()}
    assert ok[1]["n_replies"] == 1 and all(r[k] in (None, 1, 2, 3, 4, 5) for r in ok.values() for k in ("vs_replies", "vs_summary"))

    def broken(prompts):
        raise RuntimeError

    assert {r["vs_replies"] for r in G.judged(rows, broken).collect()} == {None}


def test_summaries(spark):
    rows = spark.createDataFrame([(1, [("a", "[removed]"), ("b", "hello")]), (2, []), (3, None), (4, [("a", "[deleted]")])], f"record_id bigint, replies {REPLIES}")
    seen = G.summarized(rows, lambda ps: ['{"summary": "%s"}' % p.replace("\n", " ") if "hello" in p else "garbage" for p in ps])
    got = {r["record_id"]: (r["reply_summary"], r["summary_ok"], r["summary_raw"]) for r in seen.collect()}
    assert got == {1: ("- hello", True, None), 2: ("No replies.", True, None), 3: ("No replies.", True, None), 4: (None, False, "garbage")}


def test_task_prompts_refuse_unknown_tasks():
    with pytest.raises(ValueError):
        PR.task_prompt(["score", "other"])


def test_sweep_grid_and_report(spark):
    rows = [(i, "train", i % 9, i % 4, i % 2, float(i % 9), float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id bigint, split string, score bigint, width bigint, contr int, a double, b double")
    make = lambda reg=0.1: B.Tabular(["a", "b"], B._glm(family="poisson", link="log", regParam=reg), log_target=False)
    long = E.sweep({"glm": make}, df, {"t": df})
    got = {r["metric"]: r["value"] for r in long.collect()}
    assert got["n"] == 60 and got["score_rho"] > 0.9
    assert "| glm | t |" in E.report(long)
    assert E.sweep({}, df, {}).count() == 0
    params, value = E.grid_search(make, {"reg": [0.0, 0.1]}, df)
    assert params["reg"] in (0.0, 0.1) and value > 0.8


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(60, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(99, None)], "vec_id bigint, embedding array<float>")
    got = {(r["query"], r["rank"]): r["vec_id"] for r in N.dense_neighbours(df, df.filter("vec_id % 10 = 0"), 3).collect()}
    for q in range(0, 60, 10):
        s = vecs @ vecs[q]
        s[q] = -np.inf
        assert [got[q, k + 1] for k in range(3)] == list(np.argsort(-s)[:3])
    assert N.dense_neighbours(df, df.limit(0), 3).count() == 0


def test_sparse_neighbours_equal_the_join(spark):
    docs = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 6))) for i in range(30)] + [(50, None), (51, "")]
    df = spark.createDataFrame(docs, "k bigint, t string")
    v = N.tfidf(df, "k", "t")
    norms = {r["k"]: r["n"] for r in v.groupBy("k").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()}
    assert all(abs(n - 1) < 1e-9 for n in norms.values())
    got = {(r["query"], r["k"]): r["sim"] for r in N.sparse_neighbours(v, df.filter("k % 5 = 0"), 4, "k").collect()}
    joined = v.alias("a").join(v.alias("b"), F.expr("a.term = b.term and a.k <> b.k and a.k % 5 = 0")).groupBy(F.col("a.k").alias("q"), F.col("b.k").alias("k")).agg(F.sum(F.expr("a.w * b.w")).alias("s"))
    want = {(r["q"], r["k"]): r["s"] for r in joined.collect()}
    assert all(abs(want[p] - s) < 1e-5 for p, s in got.items())
    for q in {q for q, _ in got}:
        least = min(s for (a, _), s in got.items() if a == q)
        assert sum(s > least + 1e-5 for (a, _), s in want.items() if a == q) <= 4
