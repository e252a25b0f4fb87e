from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tests.llm.helpers import record, records
from threadloom.llm import groupsplit as G
from threadloom.llm.components import connected


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefghijklmnop"), st.sampled_from("abcdefghijklmnop")), max_size=25))
def test_connected_equals_union_find(spark, edges):
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == union_find(edges)


def test_connected_chain_and_hub(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("z", f"y{i}") for i in range(40)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == union_find(edges)


def rows():
    return [
        record(1, "x", author="Ann", link="t3_a"), record(2, "x", author="u/ann ", link="T3_B"), record(3, "x", author="bob", link="https://f.example/comments/b/"),
        record(4, "x", author="[deleted]", link="t3_c"), record(5, "x", author="[deleted]", link="t3_d"), record(6, "x", author="ann-", link="t3_e"),
        record(7, "x", author="carl", link=None), record(8, "x", author="CARL", link=None), record(8, "x", author="CARL", link=None), record(9, "x", author=None, link=None),
    ]


def test_found(spark):
    got = {r["record_id"]: r["group_link"] for r in G.found(records(spark, rows())).collect()}
    assert got == {1: "a", 2: "a", 3: "a", 7: None, 8: None}


def test_names(spark):
    df = spark.createDataFrame([("  Ann​",), ("/u/Ann",), ("ann_",), ("[removed]",), ("AutoModerator",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(G.account(F.col("a"))).collect()] == ["ann", "ann", "ann_", None, None, None, None]


def test_splits_keep_groups_and_proportions(spark):
    rng = random.Random(1)
    rs = [record(i, "x", author=f"a{rng.randrange(900)}", link=f"t3_{rng.randrange(700)}") for i in range(600)]
    df = records(spark, rs)
    split = {r["record_id"]: (r["comp"], r["split"]) for r in G.splits(df).collect()}
    assert len(split) == 600
    assert len({c for c, _ in split.values()}) == len(set(split.values()))
    share = sum(s == "train" for _, s in split.values()) / 600
    assert 0.6 <= share <= 0.9


def test_update_keeps_known_and_quarantines_ties(spark):
    first = [record(i, "x", author=f"a{i}", link=f"t3_{i}") for i in range(40)]
    state, members = G.update(None, None, records(spark, first))
    before = {r["record_id"]: r["split"] for r in members.collect()}
    tr = next(i for i, s in before.items() if s == "train")
    other = next(i for i, s in before.items() if s != "train")
    batch = [record(100, "x", author=f"a{tr}", link="t3_new"), record(101, "x", author=f"a{tr}", link=f"t3_{other}"), record(102, "x", author="fresh", link="t3_fresh"), record(0, "x", author="a0", link="t3_0")]
    state2, after = G.update(state, members, records(spark, batch))
    got = {r["record_id"]: r["split"] for r in after.collect()}
    assert {k: got[k] for k in before} == before
    assert got[100] == "train" and got[101] == "quarantine" and got[102] in ("train", "validation", "test")
    _, same = G.update(state2, after, records(spark, []))
    assert {r["record_id"]: r["split"] for r in same.collect()} == got


def test_table_survives_the_session(spark, tmp_path):
    """A second process merges its batch into what the first one kept."""
    import subprocess
    import sys
    from pathlib import Path

    path = str(tmp_path / "components")
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from threadloom.session import local_session
from tests.llm.helpers import record, records
from threadloom.llm import groupsplit as G
spark = local_session(2, partitions=2)
G.merge({path!r}, records(spark, [record(i, "x", author=f"a{{i}}", link=f"t3_l{{i // 2}}") for i in range(40)]))
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=240)
    before = {r["record_id"]: r["split"] for r in G.load(spark, path)[1].collect()}
    assert len(before) == 40
    late = [record(100, "x", author="a0", link="t3_new"), record(101, "x", author="zz", link="t3_new")]
    _, members = G.merge(path, records(spark, late))
    after = {r["record_id"]: r["split"] for r in members.collect()}
    assert {k: after[k] for k in before} == before and after[100] == after[101] == before[0]


def test_record_id_with_two_accounts_ties_them(spark):
    rows = [record(1, "x", author="ann", link="t3_a"), record(1, "x", author="bob", link="t3_b"), record(2, "x", author="bob", link="t3_c"), record(3, "x", author="eve", link="t3_a"), record(4, "x", author=None, link=None), record(4, "x", author="kim", link=None), record(5, "x", author="kim", link=None)]
    df = records(spark, rows)
    got = {(r["record_id"], r["group_link"]) for r in G.found(df).collect()}
    assert got == {(1, "a"), (2, "a"), (3, "a"), (4, None), (5, None)}
    split = {}
    for r in G.splits(df).collect():
        split.setdefault(r["record_id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in split.values()) and split[1] == split[2] == split[3] and split[4] == split[5]
