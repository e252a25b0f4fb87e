from __future__ import annotations

import importlib
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadloom.plans import registry
from threadloom.sources import ledger, ndjson, probe
from threadloom.streaming import ingest

DATA = "/root/testdata/sf0.001"
LINES = ['{"id": "a", "score": "7", "edited": false, "stickied": true}', "{broken", "[1]", "", '{"id": "", "score": "x", "edited": 1700000000.0, "gilded": 2.9}']


def test_lenient_rows(spark):
    rows = ndjson.parsed(spark.createDataFrame([(x, "f") for x in LINES], "line string, _source_file string")).collect()
    good = [r for r in rows if not r["bad"]]
    assert len(rows) == 4 and len(good) == 2
    assert (good[0]["id"], good[0]["score"], good[0]["edited"], good[0]["stickied"]) == ("a", 7, "false", True)
    assert (good[1]["id"], good[1]["score"], good[1]["gilded"], good[1]["stickied"]) == (None, None, 2, None)


def test_stream_takes_new_files_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(LINES))
        ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
        assert spark.read.parquet(f"{tmp_path}/out").count() == 4 * (i + 1)


def test_resume_and_todo(spark, tmp_path):
    rows = spark.range(6).withColumnRenamed("id", "k")
    out = ledger.resumed(rows.filter("k < 3"), f"{tmp_path}/o", "k", lambda x: x.withColumn("r", F.lit(1)))
    out = ledger.resumed(rows, f"{tmp_path}/o", "k", lambda x: x.withColumn("r", F.lit(2)))
    assert sorted((r["k"], r["r"]) for r in out.collect()) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2)]


def test_cut_off_jsonl_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3')
    assert sorted(r["a"] for r in ndjson.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a bigint").collect()) == [1, 2]


@pytest.mark.parametrize("groups, wanted, want", [(0, 4, []), (1, 4, [0]), (10, 4, [0, 3, 6, 9]), (3, 8, [0, 1, 2])])
def test_picked_groups(groups, wanted, want):
    assert probe.picked(groups, wanted) == want


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1700000000 + i * 40000, "s") for i in range(10)], "created_utc bigint, subreddit string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = ingest.windowed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), late="30 days")
    stream.writeStream.format("memory").queryName("windowed_test").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("windowed_test")) == key(ingest.windowed(rows))


def test_entry_runs_and_names_match(spark):
    assert entry.entry(spark).columns == ["root_id", "branch", "leaf_id", "length"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


#: Long to run; their operators have tests of their own.
SLOW = {"gbdt", "structural_prior", "quantile_gbm", "glm", "glm_tweedie", "hawkes", "feature_ablation", "stream_ingest", "ingest_zst", "bootstrap_ci", "paired_delta"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")
@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - SLOW))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, DATA)
    res = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    norm = lambda v: "" if v is None else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    key = lambda rows, names: sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(res.fetchall(), cols)


def test_core_does_not_import_the_subpackage():
    root = Path(importlib.import_module("threadloom").__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "threadloom.llm" not in f.read_text(), f
