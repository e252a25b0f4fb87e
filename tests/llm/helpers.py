"""Small tables in the shapes of the data."""

from __future__ import annotations

NODE = "id string, parent_id string, link_id string, subreddit string, author string, body string, score bigint, controversiality bigint, created_utc bigint"
STIM = "id string, parent_id string, link_id string, subreddit string, author string, body string, created_utc bigint"
REPLY = "id string, author string, body string, score bigint, controversiality int, created_utc bigint"
RECORDS = (
    f"record_id bigint, split string, context array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, stimulus struct<{STIM.replace(' ', ':').replace(',:', ',')}>, "
    "ground_truth struct<score:bigint,controversiality:int,width:bigint,reply_summary:string>, meta struct<link_id:string,subreddit:string,depth:int,root_score:bigint,created_utc:bigint>, "
    f"replies array<struct<{REPLY.replace(' ', ':').replace(',:', ',')}>>, n_live_replies int, summarizable boolean, reply_summary string"
)
#: Columns whose names clash with what operators make.
CLASH = ", body string, comment_id string, score double, words string, cid string, kind string, n bigint, comp string, tokens bigint"
CLASH_ROW = ("x", "y", 1.0, "z", "c", "k", 3, "t:x", 5)


def record(rid, body, split="train", author="ann", link="t3_a", replies=(), cid=None):
    stim = (cid or f"s{rid}", None, link, "sub", author, body, 1700000000)
    reps = None if replies is None else [(f"r{rid}_{i}", "bob", b, 1, 0, 1700000001) for i, b in enumerate(replies)]
    return (rid, split, [], stim, (1, 0, 1, ""), (link, "sub", 0, 1, 1700000000), reps, 0, True, None)


def records(spark, rows):
    return spark.createDataFrame([r + CLASH_ROW for r in rows], RECORDS + CLASH)


def null_records(spark):
    none = (None,) * 10
    return spark.createDataFrame([none + (None,) * 9, (1,) + none[1:] + (None,) * 9, (2, "train", None, (None,) * 7, None, (None,) * 5, [(None,) * 6], None, None, None) + (None,) * 9], RECORDS + CLASH)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, link_id string, author string, created_at timestamp_ntz, tokens bigint, x string, cls string, container bigint, chars bigint"


def documents(spark, rows):
    """rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "comment", "l", "a", None, 9, "x", "c", 4, 2) for i, t, s in rows], DOCS)
