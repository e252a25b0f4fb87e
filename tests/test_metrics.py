from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import parse as P
from threadloom.functions import text as T
from threadloom.operators import metrics as M
from threadloom.operators import predictors as B
from threadloom.operators import sampling as S
from threadloom.operators.aggregate import described


def frame(spark, p, t):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, t)], "p double, t double")


@pytest.mark.parametrize("p, rho, pair", [([100, 200, 300], 1.0, 1.0), ([300, 200, 100], -1.0, 0.0), ([5, 5, 5], None, 0.0)])
def test_ranking(spark, p, rho, pair):
    df = frame(spark, p, [10, 20, 30])
    got = M.spearman(df, [], "p", "t").first()["rho"]
    assert got is None if rho is None else got == pytest.approx(rho)
    assert M.pairwise_accuracy(df, "p", "t").first()[0] == pair


def test_ranking_of_nothing(spark):
    assert M.spearman(frame(spark, [], []), [], "p", "t").first()["rho"] is None
    assert M.pairwise_accuracy(frame(spark, [1, 2], [3, 3]), "p", "t").first()[0] is None


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=2, max_size=30))
def test_spearman_with_ties(spark, rows):
    p, t = zip(*rows)
    got = M.spearman(frame(spark, p, t), [], "p", "t").first()["rho"]
    if len(set(p)) < 2 or len(set(t)) < 2:
        assert got is None
    else:
        assert got == pytest.approx(np.corrcoef(ranks(p), ranks(t))[0, 1])


def test_p_value(spark):
    assert M.p_value(spark, 0.5, 20) == pytest.approx(0.0248, abs=1e-3)
    assert M.p_value(spark, None, 20) is None


def test_f1_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "p int, t int")
    assert df.agg(M.f1_macro(F.col("p"), F.col("t"))).first()[0] == 0.5


def test_bootstrap_draws_are_shared_and_sized(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "k bigint, x double")
    a = M.resampled(df, "k", 5, "s").groupBy("b").count().collect()
    assert {r["count"] for r in a} == {50} and len(a) == 5
    draws = lambda d: sorted((r["b"], r["ord"]) for r in M.resampled(d, "k", 5, "s").collect())
    assert draws(df) == draws(df.withColumn("x", F.lit(0.0)))
    assert M.resampled(df.limit(0), "k", 5, "s").count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 50, 80])
def test_hash_limit_is_exact_and_nested(spark, n):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = {r["k"] for r in S.hash_limit(df, n, "s", "k").collect()}
    assert len(got) == min(n, 50)
    assert got <= {r["k"] for r in S.hash_limit(df, n + 5, "s", "k").collect()}


def test_balanced(spark):
    df = spark.createDataFrame([(i, i < 6) for i in range(100)] + [(200, None)], "k bigint, y boolean")
    got = S.balanced(df, F.col("y"), 1.5, "s", "k").collect()
    assert sum(bool(r["y"]) for r in got) == 6 and len(got) == 15


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40))
def test_described_equals_numpy(spark, xs):
    r = described(spark.createDataFrame([(x,) for x in xs] + [(None,)], "x bigint"), ["x"]).first()
    assert r["n"] == len(xs) and r["p90"] == pytest.approx(np.percentile(xs, 90)) and r["median"] == pytest.approx(np.median(xs)) and r["mean"] == pytest.approx(np.mean(xs))


def test_text_functions(spark):
    df = spark.createDataFrame([("Hello, Wörld!  ÄB　x www.a.b", 2.5, 0), ("", 3.5, 1700000000), (None, -1.0, None)], "b string, x double, ts bigint")
    rows = df.select(T.n_words(F.col("b")), T.n_upper(F.col("b")), T.n_punct(F.col("b")), T.has_url(F.col("b")), T.upper_ratio(F.col("b")), T.round_half_even(F.col("x")), T.hour_utc(F.coalesce("ts", F.lit(0))), T.weekday_utc(F.coalesce("ts", F.lit(0)))).collect()
    assert tuple(rows[0])[:4] == (5, 4, 4, 1) and rows[0][5] == 2
    assert tuple(rows[1]) == (0, 0, 0, 0, 0.0, 4, 22, 1)
    assert rows[2][0] == 0 and rows[2][5] == 0


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"score": 3.7, "width": "2", "controversiality": true, "reply_summary": null}', (3, 1, 2, "")), ('```json\n{"score": 5}\n```', (5, 0, 0, "")), ('Sure: {"score": 7, "width": 2, "reply_summary": "a b"', (7, 0, 2, "")),
        ("Score = -4, controversial: 1", (-4, 1, 0, "")), ("[1, 2]", (0, 0, 0, "")), ("", (0, 0, 0, "")), (None, (0, 0, 0, "")), ('{"score": "3.7"}', (0, 0, 0, "")), ('{"score": 1, "reply_summary": "x"} trailing', (1, 0, 0, "x")),
    ],
)
def test_parse_prediction(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "raw string").select(P.prediction(F.col("raw")).alias("p")).first()["p"]
    assert (row["score"], row["controversiality"], row["width"], row["reply_summary"]) == want


@pytest.mark.parametrize("raw, want", [('{"rating": 4}', 4), ('```json\n{"rating": "2"}\n```', 2), ("rating: 5 because", 5), ('{"rating": 9}', None), ("no idea", None), (None, None)])
def test_parse_rating(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(P.rating(F.col("raw"))).first()[0] == want


def test_registry():
    assert {"constant_mean", "constant_median", "structural_prior", "feature_gbdt", "quantile_gbm", "glm_poisson", "glm_tweedie", "hawkes", "feature_ablation"} <= set(B.names())
    with pytest.raises(ValueError):
        B.register("hawkes")(object)
    with pytest.raises(KeyError, match="constant_mean"):
        B.get("nothing")
    with pytest.raises(ValueError):
        B.get("feature_ablation")(("nonsense",))


def test_constant_mean(spark):
    train = spark.createDataFrame([(1, 10, 1, 0), (2, 30, 3, 1)], "record_id bigint, score bigint, width bigint, contr int")
    r = B.get("constant_mean")().fit(train).predict(train).first()
    assert (r["score"], r["width"], r["controversiality"]) == (20, 2, 0)
    assert B.get("constant_mean")().fit(train.limit(0)).predict(train).first()["score"] == 0


def test_single_class_model(spark):
    rows = [(i, i * 2, i, 0, float(i), float(i % 3)) for i in range(20)]
    train = spark.createDataFrame(rows, "record_id bigint, score bigint, width bigint, contr int, a double, b double")
    out = B.Tabular(["a", "b"], B._trees(3, 2)).fit(train).predict(train).collect()
    assert {r["controversiality"] for r in out} == {0} and len(out) == 20


def test_retrieval_predictors(spark):
    rows = [(1, "train", "the bus is late again", [1.0, 0.0], 10, 2, 0), (2, "train", "the soup was cold", [0.0, 1.0], 30, 4, 1), (3, "test", "late bus again", [0.9, 0.1], 0, 0, 0), (4, "test", "zzz", [0.0, 0.0], 0, 0, 0)]
    df = spark.createDataFrame(rows, "record_id bigint, split string, text string, embedding array<float>, score bigint, width bigint, contr int")
    train, rest = df.filter("split = 'train'"), df.filter("split <> 'train'")
    got = {r["record_id"]: (r["score"], r["width"], r["controversiality"]) for r in B.get("retrieval_tfidf")(1).fit(train).predict(rest).collect()}
    assert got == {3: (10, 2, 0), 4: (0, 0, 0)}
    got = {r["record_id"]: (r["score"], r["width"]) for r in B.get("retrieval_sbert")(1).fit(train).predict(rest.filter("record_id = 3")).collect()}
    assert got == {3: (10, 2)}


def test_generative_predictors(spark):
    echo = lambda prompts: ['{"score": %d, "controversiality": 0, "width": 1, "reply_summary": "x"}' % len(p) for p in prompts]
    df = spark.createDataFrame([(1, "say", [("a", "b")])], "record_id bigint, prompt string, exemplars array<struct<prompt:string,completion:string>>")
    score = {n: B.get(n)(echo).fit(df).predict(df).first()["score"] for n in ("llm", "llm_cot", "llm_fewshot")}
    assert score["llm"] == 3 and score["llm_cot"] > 100 and score["llm_fewshot"] == len("a\nb\n\nsay")
