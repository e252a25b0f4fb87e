"""Engagement predictors: fit on a DataFrame of records, predict a DataFrame.

A predictor has ``fit(features)`` and ``predict(features)`` and returns ``record_id, score, width,
controversiality``. Features come from :func:`threadloom.operators.features.featured`. Statistics and
models are fitted on all training rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import round_half_even
from threadloom.operators import features as X

_REGISTRY: dict[str, Callable[..., Predictor]] = {}


def register(name: str):
    """Add a predictor under a name of its own; a second one of the name is an error."""

    def put(make: Callable[..., Predictor]):
        if name in _REGISTRY:
            raise ValueError(f"predictor {name!r} is registered already")
        _REGISTRY[name] = make
        return make

    return put


def get(name: str) -> Callable[..., Predictor]:
    if name not in _REGISTRY:
        raise KeyError(f"unknown predictor {name!r}; known: {', '.join(names())}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


class Predictor:
    def fit(self, train: DataFrame) -> Predictor:
        raise NotImplementedError

    def predict(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError


class _Constant(Predictor):
    """Mean or median of the training targets and the strict majority of the flag; 0 without rows."""

    def __init__(self, center: Callable):
        self.center = center

    def fit(self, train: DataFrame) -> _Constant:
        r = train.agg(self.center("score").alias("score"), self.center("width").alias("width"), (F.count_if(F.col("contr") == 1) > F.count("contr") / 2).cast("int").alias("contr")).first()
        self.value = {"score": r["score"] or 0.0, "width": r["width"] or 0.0, "contr": r["contr"] or 0}
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        v = self.value
        return rows.select("record_id", round_half_even(F.lit(float(v["score"]))).alias("score"), round_half_even(F.lit(float(v["width"]))).alias("width"), F.lit(v["contr"]).alias("controversiality"))


@register("constant_mean")
def constant_mean() -> Predictor:
    return _Constant(lambda c: F.avg(c))


@register("constant_median")
def constant_median() -> Predictor:
    return _Constant(lambda c: F.percentile(c, 0.5))


class Tabular(Predictor):
    """Standardized columns (population deviation), two regressions and a class-balanced logistic model.

    With one class in training the flag is that class. ``log_target`` regresses log1p of the clipped
    target and undoes it after.
    """

    def __init__(self, columns: list[str], regressor: Callable, log_target: bool = True):
        self.columns, self.regressor, self.log_target = list(dict.fromkeys(columns)), regressor, log_target

    def _matrix(self, rows: DataFrame) -> DataFrame:
        z = [((F.col(c) - self.mean[c]) / self.scale[c]).alias(c) for c in self.columns]
        keep = [c for c in rows.columns if c not in self.columns]
        return VectorAssembler(inputCols=self.columns, outputCol="x").transform(rows.select(*keep, *z))

    def fit(self, train: DataFrame) -> Tabular:
        train = train.filter("score is not null and width is not null")
        s = train.agg(*[F.avg(c).alias(f"m_{c}") for c in self.columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in self.columns], F.count("*").alias("n"), F.count_if(F.col("contr") == 1).alias("pos")).first()
        self.mean = {c: s[f"m_{c}"] or 0.0 for c in self.columns}
        self.scale = {c: s[f"s_{c}"] or 1.0 for c in self.columns}
        n, pos = s["n"], s["pos"]
        x = self._matrix(train)
        target = lambda c: F.greatest(F.col(c), F.lit(0)).cast("double")
        y = lambda c: F.log1p(target(c)) if self.log_target else target(c)
        x = x.withColumns({"y_score": y("score"), "y_width": y("width"), "y_contr": F.coalesce(F.col("contr"), F.lit(0)).cast("double")}).withColumn("wt", F.when(F.col("y_contr") == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1))))
        self.models = {c: self.regressor(f"y_{c}").fit(x) for c in ("score", "width")}
        self.flag = None
        self.majority = int(pos * 2 > n)
        if 0 < pos < n:
            self.flag = LogisticRegression(featuresCol="x", labelCol="y_contr", weightCol="wt", regParam=1.0 / n, predictionCol="p_contr", rawPredictionCol="raw", probabilityCol="prob").fit(x)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        x = self._matrix(rows)
        for c in ("score", "width"):
            x = self.models[c].setPredictionCol(f"p_{c}").transform(x)
        x = self.flag.transform(x) if self.flag else x.withColumn("p_contr", F.lit(self.majority))
        back = lambda c: F.expm1(F.col(c)) if self.log_target else F.col(c)
        return x.select("record_id", round_half_even(back("p_score")).alias("score"), round_half_even(back("p_width")).alias("width"), F.col("p_contr").cast("int").alias("controversiality"), back("p_score").alias("raw_score"), back("p_width").alias("raw_width"))


def _trees(rounds: int, depth: int, loss: str = "squared") -> Callable:
    return lambda y: GBTRegressor(featuresCol="x", labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=0.1, lossType=loss, seed=42)


def _glm(**kw) -> Callable:
    return lambda y: GeneralizedLinearRegression(featuresCol="x", labelCol=y, **kw)


@register("structural_prior")
def structural_prior(rounds: int = 150) -> Predictor:
    return Tabular(X.STRUCTURAL[:-1], _trees(rounds, 3))


@register("feature_gbdt")
def feature_gbdt(rounds: int = 200) -> Predictor:
    return Tabular(X.TEXT, _trees(rounds, 3))


@register("quantile_gbm")
def quantile_gbm(rounds: int = 400) -> Predictor:
    """Median regression: absolute loss is the pinball loss at one half."""
    return Tabular(X.TEXT, _trees(rounds, 4, "absolute"))


@register("glm_poisson")
def glm_poisson(reg: float = 1.0) -> Predictor:
    return Tabular(X.TEXT, _glm(family="poisson", link="log", regParam=reg), log_target=False)


@register("glm_tweedie")
def glm_tweedie(reg: float = 1.0) -> Predictor:
    return Tabular(X.TEXT, _glm(family="tweedie", variancePower=1.5, linkPower=0.0, regParam=reg), log_target=False)


@register("hawkes")
def hawkes(reg: float = 1e-3) -> Predictor:
    """Four cascade drivers under a Poisson log link."""
    return Tabular(X.CASCADE, _glm(family="poisson", link="log", regParam=reg), log_target=False)


BLOCKS = {"structural": X.STRUCTURAL[:-1], "lexical": X.LEXICAL}


@register("feature_ablation")
def feature_ablation(blocks: tuple[str, ...] = ("structural",), rounds: int = 50, noise: int = 0) -> Predictor:
    """Trees on the named blocks; ``noise`` names that many control columns (``noise_0`` ...). Unknown blocks are an error."""
    unknown = set(blocks) - set(BLOCKS)
    if unknown:
        raise ValueError(f"unknown feature blocks: {sorted(unknown)}")
    return Tabular([c for b in blocks for c in BLOCKS[b]] + [f"noise_{j}" for j in range(noise)], _trees(rounds, 3, "absolute"))


class Generative(Predictor):
    """A model that answers prompts: ``generate(list of prompts)`` returns as many texts, in Arrow batches."""

    def __init__(self, generate: Callable[[list[str]], list[str]], prompt):
        self.generate, self.prompt = generate, prompt

    def fit(self, train: DataFrame) -> Generative:
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        from threadloom.functions.parse import prediction

        generate = self.generate

        def run(batches):
            for b in batches:
                b["raw_output"] = generate(b["prompt"].tolist())
                yield b[["record_id", "raw_output"]]

        out = rows.select("record_id", self.prompt.alias("prompt")).mapInPandas(run, "record_id bigint, raw_output string")
        return out.withColumn("p", prediction(F.col("raw_output"))).select("record_id", "p.*", "raw_output")


class Retrieval(Predictor):
    """Similarity-weighted mean of the ``k`` nearest training records; 0 where nothing is near.

    ``near(train, rows, k)`` gives ``query, record_id, sim``. Ids of training and other records differ.
    """

    def __init__(self, near: Callable[[DataFrame, DataFrame, int], DataFrame], k: int):
        self.near, self.k = near, k

    def fit(self, train: DataFrame) -> Retrieval:
        self.train = train
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        from threadloom.operators.knn import aggregated

        summary = F.col("reply_summary") if "reply_summary" in self.train.columns else F.lit(None).cast("string").alias("reply_summary")
        truth = self.train.select("record_id", "score", "width", "contr", summary)
        got = aggregated(self.near(self.train, rows, self.k), truth, "record_id").withColumnRenamed("query", "record_id")
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("score", "width", "controversiality")]
        return rows.select("record_id").join(got, "record_id", "left").select("record_id", *zero, "reply_summary")


@register("retrieval_tfidf")
def retrieval_tfidf(k: int = 5, text: str = "text") -> Predictor:
    """Neighbours by TF-IDF of ``text``, weighed over training and asked records together."""
    from threadloom.operators.knn import sparse_neighbours, tfidf

    def near(train: DataFrame, rows: DataFrame, n: int) -> DataFrame:
        vectors = tfidf(train.select("record_id", text).unionByName(rows.select("record_id", text)), "record_id", text)
        return sparse_neighbours(vectors, rows, n, "record_id", among=train)

    return Retrieval(near, k)


@register("retrieval_sbert")
def retrieval_sbert(k: int = 5, vec: str = "embedding") -> Predictor:
    """Neighbours by sentence vectors that the records bring along in ``vec``."""
    from threadloom.operators.knn import dense_neighbours

    return Retrieval(lambda train, rows, n: dense_neighbours(train.select("record_id", vec), rows.select("record_id", vec), n, vec, "record_id"), k)


@register("llm")
def llm(generate: Callable[[list[str]], list[str]], prompt=None) -> Predictor:
    """Zero-shot answers of ``generate`` to ``prompt`` (a column, ``prompt`` of the records by default)."""
    return Generative(generate, F.col("prompt") if prompt is None else prompt)


@register("llm_cot")
def llm_cot(generate: Callable[[list[str]], list[str]], prompt=None) -> Predictor:
    """As ``llm``, asked to reason before the answer."""
    from threadloom.functions.prompts import COT_SUFFIX

    return Generative(generate, F.concat(F.col("prompt") if prompt is None else prompt, F.lit(COT_SUFFIX)))


@register("llm_fewshot")
def llm_fewshot(generate: Callable[[list[str]], list[str]], exemplars=None, prompt=None) -> Predictor:
    """As ``llm``, after the worked examples in ``exemplars`` (an array of ``prompt, completion``; ``exemplars`` of the records by default)."""
    from threadloom.functions.prompts import fewshot

    return Generative(generate, fewshot(F.col("exemplars") if exemplars is None else exemplars, F.col("prompt") if prompt is None else prompt))
