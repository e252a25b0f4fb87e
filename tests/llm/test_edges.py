"""Nulls, empty tables, empty and very long texts, repeated rows and clashing columns for every operator."""

from __future__ import annotations

import pytest

from tests.llm.helpers import documents, null_records, record, records
from threadloom.llm import abuse, groupsplit, mixing, overlap, packing, pii, quality, residue

BY_RECORD = {
    "p1": abuse.found, "p1_rates": abuse.rates, "p2": groupsplit.found, "p2_splits": groupsplit.splits, "p3": pii.found, "p3_redacted": pii.redacted,
    "p4": overlap.found, "p4_report": overlap.report, "p5": residue.found, "p5_kept": residue.kept,
}
LONG = "The council met again and the report is late. " * 3000


@pytest.mark.parametrize("name", BY_RECORD)
def test_empty_and_null(spark, name):
    assert BY_RECORD[name](records(spark, [])).count() == 0
    out = BY_RECORD[name](null_records(spark)).collect()
    if name == "p2_splits":
        assert {r["split"] for r in out} <= {"train", "validation", "test"}
    elif name in ("p1", "p2", "p3", "p4", "p4_report", "p5"):
        assert out == []


@pytest.mark.parametrize("name", ["p1", "p3", "p5"])
def test_text_cases(spark, name):
    hit = {"p1": "you are a complete m0r0n", "p3": "mail me at ann.lee@example.com", "p5": "Hi {{author.name}}, welcome."}[name]
    rows = [record(1, hit), record(1, hit), record(2, LONG + hit, replies=["", None, hit]), record(3, "", replies=None), record(4, "[removed]"), record(5, "   \n ")]
    got = BY_RECORD[name](records(spark, rows)).select("record_id", "comment_id").collect()
    assert sorted(tuple(r) for r in got) == [(1, "s1"), (2, "r2_2"), (2, "s2")]


@pytest.fixture(scope="module")
def tables(spark):
    packs = spark.createDataFrame([("small", 8), ("large", 64)], "pack_name string, capacity_tokens int")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    common = spark.createDataFrame([("en", w) for w in "the and of to is in that it was for on with as be at not".split()], "lang string, word string")
    return packs, weights, common


def test_documents_empty_and_null(spark, tables):
    packs, weights, common = tables
    empty, odd = documents(spark, []), documents(spark, [(1, None, None), (2, "", "a"), (3, "  \n\n ", "zz")])
    assert packing.assigned(empty, packs).count() == 0
    assert packing.assigned(empty, packs.limit(0)).count() == 0
    assert {r["container"] for r in packing.assigned(odd.filter("doc_id < 3"), packs).collect()} == {None}
    assert mixing.mix(empty, weights).count() == 0
    assert mixing.mix(odd, weights).count() == 0
    assert [(r["tokens"], r["share"]) for r in mixing.shares(odd, weights).collect()] == [(0, 0.0), (0, 0.0)]
    assert quality.found(empty, common).count() == 0
    assert quality.found(odd, common).count() == 0
    stats = {r["doc_id"]: r["word_count"] for r in quality.document_stats(odd, common).collect()}
    assert stats == {1: 0, 2: 0, 3: 0}
