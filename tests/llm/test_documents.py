from __future__ import annotations

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents
from threadloom.llm import mixing, packing, quality


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 200), st.dictionaries(st.integers(1, 200), st.integers(1, 30), max_size=25))
def test_plan_places_every_item(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    plan = packing.Plan(capacity, counts)
    load = Counter()
    for s, n in counts.items():
        assert plan.used[s] == n
        runs = sorted(plan.runs[s]) + [(n, 0, 1)]
        for (a, box, per), (b, _, _) in zip(runs, runs[1:]):
            for r in range(a, b):
                load[box + (r - a) // per] += s
    assert not load or max(load.values()) <= capacity
    assert len(load) == plan.next
    assert plan.next <= 2 * -(-sum(s * n for s, n in counts.items()) // capacity) + 1


def test_packing_whole_documents(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["word"] * rng.choice([1, 3, 5, 9, 20, 40, 150])), "a") for i in range(200)]
    packs = spark.createDataFrame([("small", 16), ("large", 64)], "pack_name string, capacity_tokens int")
    rows = packing.assigned(documents(spark, docs), packs).collect()
    for name, cap in (("small", 16), ("large", 64)):
        load, pieces = defaultdict(int), defaultdict(int)
        for r in rows:
            if r["pack_name"] == name:
                load[r["container"]] += r["tokens"]
                pieces[r["doc_id"]] += r["tokens"]
        assert max(load.values()) <= cap
        assert pieces == {i: len(t.split()) for i, t, _ in docs}
        assert len(load) <= 1.2 * sum(pieces.values()) / cap + 1
        assert all(n == 1 or pieces[d] > cap for d, n in Counter(r["doc_id"] for r in rows if r["pack_name"] == name).items())
    assert len(rows) == len({(r["pack_name"], r["doc_id"], r["piece"]) for r in rows})


def test_flow_prefers_few_repeats():
    total, flow = mixing.min_cost_flow({("a",): (100, 3), ("a", "b"): (100, 1)}, {"a": 150, "b": 50})
    assert total == 200 and flow[("a", "b"), "b"] == 50 and flow[("a",), "a"] == 100 and flow[("a", "b"), "a"] == 50


def test_mix_meets_shares_and_limits(spark):
    rng = random.Random(4)
    docs = [(i, f"text number {i} " + "word " * rng.randrange(1, 30), "a" if i % 5 else " B") for i in range(400)]
    docs += [(1000 + i, docs[i][1], "b") for i in range(20)] + [(2000, docs[3][1], "unknown"), (2001, "never drawn", None)]
    weights = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], "source string, target_share double, max_repeats int")
    df = documents(spark, docs)
    got = {r["source"]: r for r in mixing.shares(df, weights).collect()}
    assert abs(got["a"]["share"] - 0.6) < 0.02 and abs(got["b"]["share"] - 0.4) < 0.02
    uses, text = Counter(), {i: t for i, t, _ in docs}
    for r in mixing.mix(df, weights).collect():
        uses[text[r["doc_id"]]] += r["uses"]
        assert r["source"] in ("a", "b")
    both = {t for t in (docs[i][1] for i in range(20) if i % 5)}
    assert all(n <= (1 if t in both else 3) for t, n in uses.items())


def test_quality_kinds(spark):
    prose = "The council met again last night, and most of them said that it was not the right time for the plan. "
    rows = [
        (1, prose * 3, "a"), (2, "- night train\n- wage floor\n- bus depot\n- postal vote\n- old reservoir", "a"), (3, "| a | b |\n|---|---|\n| x | 12 |\n| y | 31 |\n| z | 7 |", "a"),
        (4, "xkcd qwrt zpfg hjkl vbnm wrtp sdfg xcvb qwrt pklm", "a"), (5, prose * 4 + "\n\n- one\n- two\n- three", "a"), (6, prose.lower().replace(",", "").replace(".", "") * 2, "a"), (7, prose.upper() * 2, "a"),
        (8, prose + "\n\n" + "1. bus depot\n2. night train\n3. wage floor\n" * 12, "a"),
    ]
    common = spark.createDataFrame([("en", w) for w in "the be to of and a in that have it for not on with as you do at this but by from they was we say so up out if".split()], "lang string, word string")
    df = documents(spark, rows * 8)
    assert {r["doc_id"] for r in quality.found(df, common).collect()} == {2, 3, 4, 8}
