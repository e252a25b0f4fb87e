"""Feature blocks of the engagement predictors as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ids import hash_unit


def _node(pos: int, field: str) -> Column:
    """Field of the parent (-1) or root (1) of a record; null without context."""
    return F.try_element_at("context", F.lit(pos))[field]


def structural() -> list[Column]:
    """Position, time and ancestor engagement; depth stands twice, as the models expect."""
    depth = F.coalesce(F.size("context"), F.lit(0)).cast("double")
    ts = F.coalesce(F.col("stimulus.created_utc"), F.lit(0))
    return [
        depth.alias("depth"), T.hour_utc(ts).cast("double").alias("hour"), T.weekday_utc(ts).cast("double").alias("weekday"),
        T.log_score(_node(-1, "score")).alias("parent_score"), F.coalesce(_node(-1, "controversiality"), F.lit(0)).cast("double").alias("parent_contr"),
        T.log_score(_node(1, "score")).alias("root_score"), depth.alias("n_context"),
    ]


def lexical() -> list[Column]:
    """Shallow statistics of the text, without meaning."""
    b = F.col("stimulus.body")
    return [
        T.n_chars(b).cast("double").alias("n_chars"), T.n_words(b).cast("double").alias("n_words"), T.n_punct(b).cast("double").alias("n_punct"), T.upper_ratio(b).alias("upper_ratio"),
        T.has_url(b).cast("double").alias("has_url"), T.n_chars(_node(-1, "body")).cast("double").alias("parent_chars"), T.n_chars(_node(1, "body")).cast("double").alias("root_chars"),
    ]


TEXT = ["n_chars", "n_words", "n_punct", "upper_ratio", "has_url", "hour", "weekday", "depth", "parent_score", "parent_contr", "parent_chars", "root_score", "root_chars"]
STRUCTURAL = ["depth", "hour", "weekday", "parent_score", "parent_contr", "root_score", "n_context"]
LEXICAL = ["n_chars", "n_words", "n_punct", "upper_ratio", "has_url", "parent_chars", "root_chars"]
CASCADE = ["parent_score", "depth", "root_score", "n_chars"]


def featured(records: DataFrame) -> DataFrame:
    """``record_id``, every feature column and the targets ``score, width, contr``."""
    truth = [F.col("ground_truth.score").alias("score"), F.col("ground_truth.width").alias("width"), F.col("ground_truth.controversiality").alias("contr")]
    return records.select("record_id", "split", *structural(), *lexical(), *truth)


def nodes(records: DataFrame, most: int = 12) -> DataFrame:
    """Path-graph nodes, the last ``most`` of context and stimulus: ``record_id, pos`` and six features; the stimulus' own score is hidden."""
    ctx = F.transform(F.coalesce("context", F.array()), lambda c: F.struct(c["body"].alias("body"), c["score"].alias("score"), c["controversiality"].alias("contr"), c["created_utc"].alias("ts"), F.lit(False).alias("stim")))
    stim = F.struct(F.col("stimulus.body").alias("body"), F.lit(None).cast("bigint").alias("score"), F.lit(None).cast("bigint").alias("contr"), F.col("stimulus.created_utc").alias("ts"), F.lit(True).alias("stim"))
    path = F.concat(ctx, F.array(stim))
    rows = records.select("record_id", F.size(path).alias("n"), F.posexplode(path).alias("depth", "x")).filter(F.col("depth") >= F.col("n") - most)
    ts = F.coalesce(F.col("x.ts"), F.lit(0))
    return rows.select(
        "record_id", (F.col("depth") - F.greatest(F.col("n") - most, F.lit(0))).alias("pos"), T.log_score(F.col("x.score")).alias("log_score"), F.coalesce(F.col("x.contr"), F.lit(0)).cast("double").alias("contr"),
        F.col("depth").cast("double").alias("depth"), F.log1p(T.n_chars(F.col("x.body")).cast("double")).alias("log_chars"), (T.hour_utc(ts) / 23.0).alias("hour"), F.col("x.stim").cast("double").alias("is_stimulus"),
    )


def noise(records: DataFrame, columns: int) -> DataFrame:
    """Deterministic N(0, 1) columns per stimulus id (Box-Muller), a control for the number of columns."""
    ident = F.coalesce(F.col("stimulus.id"), F.col("record_id").cast("string"))
    u = lambda tag, j: (hash_unit(tag, ident, F.lit(j)) + F.lit(0.5)) / F.lit(2.0**32)
    return records.select("record_id", *[(F.sqrt(-2 * F.log(u("u", j))) * F.cos(2 * F.lit(3.141592653589793) * u("v", j))).alias(f"noise_{j}") for j in range(columns)])


def record_text(sep: str = " \n ", mark: str = " [SEP] ") -> Column:
    """Bodies of the context joined, then the stimulus."""
    ctx = F.array_join(F.transform(F.coalesce("context", F.array()), lambda c: F.coalesce(c["body"], F.lit(""))), sep)
    return F.concat(ctx, F.lit(mark), F.coalesce(F.col("stimulus.body"), F.lit("")))
