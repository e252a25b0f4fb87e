"""Generation over DataFrames: summaries of replies and judged predictions, with pluggable engines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import parse as P
from threadloom.functions import prompts as PR

Engine = Callable[[list[str]], list[str]]


def generated(rows: DataFrame, prompt: str, key: str, engine: Engine) -> DataFrame:
    """``key, raw_output``: the engine's answers, a batch of prompts at a time; an engine that fails on a batch gives nulls for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                try:
                    out = engine(b["p"].tolist())
                except Exception:  # noqa: BLE001 - one bad batch must not end the job
                    out = [None] * len(b)
                yield pd.DataFrame({key: b[key], "raw_output": out})

    return rows.select(key, F.col(prompt).alias("p")).mapInPandas(run, f"{key} bigint, raw_output string")


def mock_judge(prompts: list[str]) -> list[str]:
    """Stand-in judge: a rating from the length of the prompt; every seventh answer is prose."""
    rate = lambda p: len(p) % 5 + 1
    return ["Rating: %d -- in prose" % rate(p) if len(p) % 7 == 0 else '{"rating": %d, "reason": "mock"}' % rate(p) for p in prompts]


def judged(rows: DataFrame, engine: Engine, key: str = "record_id") -> DataFrame:
    """``key, vs_replies, vs_summary, n_replies`` for rows of ``body, reference, candidate, replies``; a rating that can't be read is null."""
    c = F.col
    asked = rows.withColumn("by_replies", PR.judge_prompt(c("body"), c("reference"), c("candidate"), c("replies"))).withColumn("by_summary", PR.judge_prompt(c("body"), c("reference"), c("candidate")))
    rate = lambda p, name: generated(asked, p, key, engine).select(key, P.rating(c("raw_output")).alias(name))
    return rows.select(key, F.size("replies").alias("n_replies")).join(rate("by_replies", "vs_replies"), key).join(rate("by_summary", "vs_summary"), key)


def summarized(records: DataFrame, engine: Engine, most: int = 20) -> DataFrame:
    """``record_id, reply_summary, summary_ok, summary_raw``: summaries of the live replies (all, where none lives), at most ``most`` of them.

    Without replies the summary is ``No replies.``; an answer that can't be read gives null, ``summary_ok`` false and its first 400 characters.
    """
    live = F.filter("replies", lambda r: ~F.coalesce(r["body"], F.lit("")).isin("[removed]", "[deleted]"))
    shown = F.slice(F.when(F.size(live) > 0, live).otherwise(F.col("replies")), 1, most)
    some = records.filter(F.size("replies") > 0).select("record_id", PR.summary_message(shown).alias("m"))
    read = generated(some, "m", "record_id", engine).withColumn("reply_summary", P.summary(F.col("raw_output")))
    done = read.select("record_id", "reply_summary", F.col("reply_summary").isNotNull().alias("summary_ok"), F.when(F.col("reply_summary").isNull(), F.substring("raw_output", 1, 400)).alias("summary_raw"))
    none = records.filter(F.coalesce(F.size("replies"), F.lit(0)) <= 0).select("record_id", F.lit("No replies.").alias("reply_summary"), F.lit(True).alias("summary_ok"), F.lit(None).cast("string").alias("summary_raw"))
    return done.unionByName(none)
