"""Prompt and target texts. The wording is fixed: models are trained on it byte by byte."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Wording of the record prompt (three of its lines run on without a line break).
RECORD_PROMPT_HEAD = """You are analyzing a Reddit political discussion. Given the conversation context and a stimulus comment, predict:
  1. The score (upvotes) the stimulus will receive
  2. Whether the stimulus is controversial (0 or 1)
  3. The number of direct reply comments (width) the stimulus will generate

  4. A summary of the body fields of the direct reply comments (width) the stimulus will generateReturn a JSON object with exactly these fields:
  - "score": an integer with the predicted score
  - "controversiality": 0 or 1
  - "width": an integer with the predicted number of direct reply comments  - "reply_summary": a stringDo NOT include anything outside the JSON object.

conversation context:
"""
RECORD_PROMPT_STIMULUS = "\n\nstimulus comment:\n"
RECORD_PROMPT_TAIL = "\n\nNow provide score, controversiality, width, and reply_summary as a JSON object."
# Wording of the forecast prompt.
FORECAST_HEAD = "You are forecasting how a Reddit thread will unfold.\n\n"
FORECAST_TAIL = (
    "Predict the replies this comment will receive. Describe the key points people will make and the overall sentiment toward the comment. Do not restate the comment itself.\n"
    'Return ONLY a JSON object: {"summary": "<2-4 sentences>"}'
)
# Scale of the judge prompt.
JUDGE_SCALE = (
    "Scale:\n  5 = anticipates essentially all main points and the sentiment\n  4 = anticipates most points and the sentiment\n  3 = partially right; misses some points or nuance\n"
    "  2 = largely misses the points or sentiment\n  1 = unrelated, generic, or contradictory\n\n"
    'Return ONLY a JSON object: {"rating": <1-5 integer>, "reason": "<one short sentence>"}'
)


def record_prompt(context: Column, stimulus: Column) -> Column:
    """Record prompt with indented JSON, which no built-in expression writes."""

    @F.pandas_udf(StringType())
    def build(c: pd.Series, s: pd.Series) -> pd.Series:
        pretty = lambda x, empty: json.dumps(json.loads(x) if x else empty, ensure_ascii=False, indent=2)
        return pd.Series([RECORD_PROMPT_HEAD + pretty(a, []) + RECORD_PROMPT_STIMULUS + pretty(b, {}) + RECORD_PROMPT_TAIL for a, b in zip(c, s)])

    options = {"ignoreNullFields": "false"}
    return build(F.to_json(context, options), F.to_json(stimulus, options))


def target(truth: Column) -> Column:
    """Ground truth as JSON; compared by its fields, as separators differ between writers."""
    return F.to_json(truth, {"ignoreNullFields": "false"})


def forecast_prompt() -> Column:
    """Forecast prompt of a summary record: metadata, the last four ancestors (400 characters each), the comment (1,500)."""
    last = F.slice("context", F.greatest(F.size("context") - 3, F.lit(1)), 4)
    lines = F.array_join(F.transform(last, lambda c: F.concat(F.lit("- "), F.substring(F.coalesce(c["body"], F.lit("")), 1, 400))), "\n")
    ts = F.coalesce(F.nullif(F.col("meta.created_utc"), F.lit(0)), F.col("stimulus.created_utc"), F.lit(0))
    when = F.when(ts > 0, F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm 'UTC'")).otherwise("unknown")
    parent = F.when(F.size("context") > 0, F.coalesce(F.try_element_at("context", F.lit(-1))["score"].cast("string"), F.lit("None"))).otherwise("n/a")
    shown = F.when(F.size("context") > 0, lines).otherwise("- (none; this is a top-level comment)")
    return F.concat(
        F.lit(FORECAST_HEAD), F.lit("Subreddit: r/"), F.coalesce("meta.subreddit", "stimulus.subreddit", F.lit("None")), F.lit("\nPosted: "), when,
        F.lit("\nDepth in thread: "), F.coalesce(F.col("meta.depth"), F.size("context")).cast("string"), F.lit("\nScore of the parent comment: "), parent,
        F.lit("\nScore of the top-level comment in this thread: "), F.coalesce(F.col("meta.root_score").cast("string"), F.lit("n/a")),
        F.lit("\n\nConversation so far (oldest first):\n"), shown, F.lit("\n\nThe COMMENT that was just posted:\n"), F.substring(F.coalesce(F.col("stimulus.body"), F.lit("")), 1, 1500), F.lit("\n\n"), F.lit(FORECAST_TAIL),
    )


def summary_message(replies: Column) -> Column:
    """Reply bodies as a list, parted by blank lines: what the reply summarizer reads."""
    return F.array_join(F.transform(replies, lambda r: F.concat(F.lit("- "), F.coalesce(r["body"], F.lit("")))), "\n\n")


# Wording of the judge prompt around its parts.
JUDGE_HEAD = "You are a strict evaluator of predicted social-media replies.\n\nA model was shown only the COMMENT below (never the replies) and asked to predict what replies it would receive. Rate "
JUDGE_BY_REPLIES = "how well the PREDICTED summary anticipates the actual replies above -- their key points, topics and overall sentiment toward the comment"
JUDGE_BY_SUMMARY = "how well the PREDICTED summary captures the key points, topics and overall sentiment of the REFERENCE summary"
# Field lines of the multi-task prompt and the suffix that asks for reasoning.
TASK_FIELDS = {
    "score": '  "score": <integer net upvotes>',
    "controversiality": '  "controversiality": <0 or 1>',
    "width": '  "width": <integer number of direct replies>',
    "summary": '  "reply_summary": "<2-4 sentences describing the replies>"',
}
COT_SUFFIX = (
    "\n\nFirst reason in AT MOST 3 short sentences about who reads this comment, how this subreddit usually reacts, and what the thread position implies. "
    "Then, on the last line, give the complete JSON object. Keep the reasoning brief -- the JSON must be finished, not cut off."
)


def judge_prompt(body: Column, reference: Column, candidate: Column, replies: Column | None = None) -> Column:
    """Judge prompt against the replies (the first twelve, 300 characters each) where there are any, else against the reference."""
    from threadloom.functions.text import truncated

    by_summary = F.concat(F.lit("REFERENCE summary:\n"), truncated(reference, 800), F.lit("\n\n"))
    block, what = by_summary, F.lit(JUDGE_BY_SUMMARY)
    if replies is not None:
        some = F.coalesce(F.size(replies), F.lit(0)) > 0
        shown = F.array_join(F.transform(F.slice(replies, 1, 12), lambda r: F.concat(F.lit("  - "), F.substring(F.coalesce(r["body"], F.lit("")), 1, 300))), "\n")
        aid = F.when(F.coalesce(reference, F.lit("")) != "", F.concat(F.lit("A neutral summary of those replies:\n"), truncated(reference, 600), F.lit("\n\n"))).otherwise("")
        block = F.when(some, F.concat(F.lit("ACTUAL REPLIES the comment received:\n"), shown, F.lit("\n\n"), aid)).otherwise(by_summary)
        what = F.when(some, JUDGE_BY_REPLIES).otherwise(JUDGE_BY_SUMMARY)
    return F.concat(F.lit(JUDGE_HEAD), what, F.lit(".\n\nCOMMENT:\n"), truncated(body, 600), F.lit("\n\n"), block, F.lit("PREDICTED summary:\n"), truncated(candidate, 800), F.lit("\n\n"), F.lit(JUDGE_SCALE))


def task_prompt(tasks: list[str], reason: bool = False) -> Column:
    """Prompt for several targets at once, with their field lines; unknown tasks are an error."""
    unknown = set(tasks) - set(TASK_FIELDS)
    if unknown:
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    lead = "Reason briefly, then return a JSON object with exactly these fields:\n" if reason else "Return ONLY a JSON object with exactly these fields:\n"
    head = F.split_part(forecast_prompt(), F.lit("Predict the replies this comment will receive."), F.lit(1))
    fields = "\n".join(TASK_FIELDS[t] for t in TASK_FIELDS if t in tasks)
    return F.concat(head, F.lit("Predict the engagement this comment will receive.\n" + lead + fields + (COT_SUFFIX if reason else "")))


def task_target(tasks: list[str], truth: Column, summary: Column) -> Column:
    """JSON of the enabled targets only."""
    text = F.coalesce(F.nullif(summary, F.lit("")), truth["reply_summary"], F.lit(""))
    parts = {"score": truth["score"].cast("bigint").alias("score"), "controversiality": truth["controversiality"].cast("bigint").alias("controversiality"), "width": truth["width"].cast("bigint").alias("width"), "summary": text.alias("reply_summary")}
    return F.to_json(F.struct(*[parts[t] for t in TASK_FIELDS if t in tasks]), {"ignoreNullFields": "false"})


def fewshot(exemplars: Column, prompt: Column) -> Column:
    """Worked examples before the prompt; ``exemplars`` is an array of ``prompt, completion``."""
    shown = F.array_join(F.transform(exemplars, lambda e: F.concat(e["prompt"], F.lit("\n"), e["completion"])), "\n\n")
    return F.concat_ws("\n\n", F.nullif(shown, F.lit("")), prompt)
