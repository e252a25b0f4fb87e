from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import chains as CH
from threadloom.operators import comments as C
from threadloom.operators import corpus as K
from threadloom.operators import forest as FO

SCHEMA = "id string, parent_id string, link_id string, subreddit string, author string, body string, score bigint, controversiality bigint, created_utc bigint, distinguished string, edited string, author_flair_text string, gilded bigint, stickied boolean, _source_file string, width string, depth string"


def dump(spark, rows):
    """rows of (id, parent, created) or with score; two columns clash with what operators add."""
    full = [(r[0], r[1], "t3_p", "s", "a", "b", r[3] if len(r) > 3 else 30, 0, r[2], None, "false", None, 0, False, r[4] if len(r) > 4 else "f1", "w", "d") for r in rows]
    return C.latest(spark.createDataFrame(full, SCHEMA))


def test_empty_dump(spark):
    c = dump(spark, [])
    f = FO.forest(c)
    assert c.count() == f.count() == C.with_width(c).count() == 0
    assert CH.chains(c, f).count() == 0
    assert K.records(c).count() == 0


def test_latest_row_wins_and_width_counts_once(spark):
    c = dump(spark, [("a", "t3_p", 1), ("b", "t1_a", 2, 5, "f1"), ("b", "t1_a", 2, 9, "f2"), ("b", "t1_a", 2, None, "f2")])
    assert {r["id"]: (r["score"], r["width"]) for r in C.with_width(c).collect()} == {"a": (30, 1), "b": (9, 0)}


def test_roots_orphans_and_prefixes(spark):
    c = dump(spark, [("a", "t3_p", 1), ("b", "t1_gone", 2), ("c_1", "t1_b", 3), ("d", "t1_c_1", 4), ("n", None, 5)])
    assert {r["id"]: (r["root_id"], r["depth"]) for r in FO.forest(c).collect()} == {"a": ("a", 0), "b": ("b", 0), "c_1": ("b", 1), "d": ("b", 2), "n": ("n", 0)}
    assert [r["id"] for r in C.orphans(c).collect()] == ["b"]


def test_cycles_vanish(spark):
    c = dump(spark, [("a", "t1_b", 1), ("b", "t1_a", 2), ("c", "t1_b", 3), ("s", "t1_s", 4), ("r", "t3_p", 5), ("q", "t1_r", 6)])
    assert {r["id"] for r in FO.forest(c).collect()} == {"r", "q"}


def test_deep_thread(spark):
    c = dump(spark, [("n000", "t3_p", 0)] + [(f"n{i:03d}", f"t1_n{i - 1:03d}", i) for i in range(1, 90)])
    f = FO.forest(c)
    assert f.agg(F.max("depth")).first()[0] == 89
    ctx = FO.context_ids(f).filter("id = 'n089'").first()["context"]
    assert ctx == [f"n{i:03d}" for i in range(24, 89)]


def greedy(children, created, root):
    """Longest paths first, ties by the greatest sibling order, edge-disjoint, at least three nodes."""
    paths = []

    def walk(node, path):
        path = path + [node]
        if not children.get(node):
            paths.append(path)
        for k in children.get(node, []):
            walk(k, path)

    walk(root, [])
    paths.sort(key=lambda p: (len(p), [(created[x], x) for x in p]), reverse=True)
    used, kept = set(), []
    for p in paths:
        edges = set(zip(p, p[1:]))
        if len(p) >= 3 and not edges & used:
            kept.append(p[-1])
        if not edges & used:
            used |= edges
    return set(kept)


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_greedy_selection(spark, seed):
    rng = random.Random(seed)
    rows, children, created = [], {}, {}
    for t in range(6):
        ids = [f"t{t}n{i}" for i in range(14)]
        for i, x in enumerate(ids):
            created[x] = rng.randrange(50)
            parent = None if i == 0 else ids[rng.randrange(i)]
            rows.append((x, f"t1_{parent}" if parent else "t3_p", created[x]))
            if parent:
                children.setdefault(parent, []).append(x)
    c = dump(spark, rows)
    got = {r["leaf_id"] for r in CH.chains(c, FO.forest(c)).collect()}
    assert got == set().union(*(greedy(children, created, f"t{t}n0") for t in range(6)))


def test_context_holds_ancestors_in_order(spark):
    c = dump(spark, [("a", "t3_p", 1), ("b", "t1_a", 2), ("c", "t1_b", 3)])
    out = {r["id"]: [n["id"] for n in r["context"]] for r in FO.with_context(c.select("id"), FO.forest(c), c).collect()}
    assert out == {"a": [], "b": ["a"], "c": ["a", "b"]}


def test_corpus_records_cap_tail_and_modes(spark):
    rows = [("a", "t3_p", 0)] + [(f"k{i:02d}", "t1_a", i) for i in range(1, 20)] + [("late", "t1_a", 10**6)]
    c = dump(spark, rows)
    r = K.records(c, per_post_cap=8).collect()
    assert len(r) == 8 and "late" not in {x["id"] for x in r}
    assert K.records(c, per_post_cap=99).filter("id = 'a'").first()["ground_truth"]["width"] == 20
    with pytest.raises(ValueError):
        K.post_sample(c, 1, "other", "1")


def test_split_refuses_overlap(spark):
    rows = spark.createDataFrame([("p1", "train"), ("p1", "test"), ("p2", "train")], "post string, split string")
    with pytest.raises(ValueError):
        K.checked_disjoint(rows, "post")
    assert K.checked_disjoint(rows.filter("post = 'p2'"), "post").count() == 1
