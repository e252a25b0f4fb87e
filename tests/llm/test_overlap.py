from __future__ import annotations

import random

import pytest

from tests.llm.helpers import record, records
from threadloom.llm import overlap as O

WORDS = "council river budget school train harbour report vote road bridge market garden letter winter summer engine window paper village doctor".split()


def text(rng, n=30):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def changed(rng, t, share):
    w = t.split()
    for i in rng.sample(range(len(w)), int(share * len(w))):
        w[i] = "changed" + str(rng.randrange(9))
    return " ".join(w)


def test_found_against_brute_force(spark):
    rng = random.Random(3)
    base = [text(rng) for _ in range(60)]
    rows = [record(i, t, "train") for i, t in enumerate(base)]
    rows += [record(100 + i, changed(rng, base[i], (i % 5) * 0.05), ("test", "validation")[i % 2]) for i in range(25)]
    rows += [record(200 + i, text(rng), "test") for i in range(20)]
    rows += [record(300, "As I said: **" + base[0].upper().replace(" ", "\n") + "**", "test"), record(301, "> " + base[1] + "\n\nI do not think so, as the plan was never paid for by anyone here", "test"), record(302, "too short to count here", "test"), record(303, "too short to count here", "train"), record(0, base[0], "train")]
    norm = {r[0]: O_words(spark, r[3][5]) for r in rows}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] != "train" and min(len(norm[a[0]]), len(norm[b[0]])) >= O.LEAST and O.same_comment(" ".join(norm[a[0]]), " ".join(norm[b[0]])):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = {tuple(r) for r in O.found(records(spark, rows)).collect()}
    assert got == want
    assert {(i, 100 + i) for i in range(25)} <= got and (0, 300) in got and not any(301 in p or 302 in p for p in got)


_CACHE = {}


def O_words(spark, body):
    from pyspark.sql import functions as F

    if body not in _CACHE:
        _CACHE[body] = spark.createDataFrame([(body,)], "b string").select(O.word_list(F.col("b"))).first()[0]
    return _CACHE[body]


def test_hot_copies_report_without_pairs(spark):
    t = text(random.Random(5))
    rows = [record(i, t, "train" if i % 2 else "test") for i in range(300)]
    out = O.report(records(spark, rows)).collect()
    assert {(r["split"], r["n_records"], r["n_links"]) for r in out} == {("train", 150, 150 * 150), ("test", 150, 150 * 150)}


def pairs_found(spark, base, variants):
    rows = [record(0, base, "train")] + [record(1 + i, v, "test") for i, v in enumerate(variants)]
    return {tuple(r) for r in O.found(records(spark, rows)).collect()}


def replaced(base, places, tag):
    w = base.split()
    for i in places:
        w[i] = f"{tag}x{i}"
    return " ".join(w)


def test_near_copy_groups_meet_their_original(spark):
    rng = random.Random(9)
    base = " ".join(f"word{i}" for i in range(30))
    variants = [replaced(base, rng.sample(range(2, 28), 2), f"v{k}") for k in range(50)]
    assert pairs_found(spark, base, variants) == {(0, 1 + k) for k in range(50)}


@pytest.mark.parametrize("n, places", [(8, (3,)), (8, (2, 5)), (9, (4,)), (12, (2, 5, 8)), (14, (4, 9)), (19, (2, 5, 8, 11, 14)), (20, (2, 6, 10, 14, 17))])
def test_short_texts_and_spread_changes(spark, n, places):
    base = " ".join(f"word{i}" for i in range(n))
    other = replaced(base, range(1, n, 2), "y")
    assert pairs_found(spark, base, [replaced(base, places, "x"), other]) == {(0, 1)}


@pytest.mark.parametrize("share", [0.15, 0.25])
def test_recall_by_length(spark, share):
    """Words replaced at random places, and one moved: nothing is lost at any length."""
    rng = random.Random(int(100 * share))
    rows, want = [], {}
    for n in (8, 10, 12, 16, 20, 30, 50):
        for k in range(30):
            base = " ".join(f"n{n}k{k}w{i}" for i in range(n))
            i = len(want)
            rows += [record(i, base, "train"), record(10_000 + i, replaced(base, rng.sample(range(n), int(share * n)), "x"), "test")]
            want[i, 10_000 + i] = n
    got = {tuple(r) for r in O.found(records(spark, rows)).collect()}
    for n in set(want.values()):
        pairs = {p for p, m in want.items() if m == n}
        assert len(pairs & got) >= 0.9 * len(pairs), n
    assert got <= set(want)


def test_hot_words_in_parts_lose_nothing(spark):
    rng = random.Random(4)
    base = [text(rng, 14) for _ in range(80)]
    rows = [record(i, "the same words begin " + t, "train") for i, t in enumerate(base)] + [record(100 + i, "the same words begin " + changed(rng, t, 0.2), "test") for i, t in enumerate(base)]
    _, texts = O.classes(records(spark, rows))
    whole, parts = ({tuple(r) for r in O.candidates(texts, hot).collect()} for hot in (10_000, 7))
    assert whole == parts and len(whole) >= 80


def test_class_pairs_and_membership_give_all_pairs(spark):
    t = text(random.Random(6))
    rows = [record(i, t, "train" if i % 3 else "test") for i in range(40)] + [record(100, changed(random.Random(1), t, 0.1), "test")]
    df = records(spark, rows)
    members = [tuple(r) for r in O.class_members(df).collect()]
    side = lambda c, train: [r for r, s, k in members if k == c and (s == "train") == train]
    got = {(min(x, y), max(x, y)) for e, t_ in O.class_links(df).collect() for x in side(e, False) for y in side(t_, True)}
    assert got == {tuple(r) for r in O.found(df).collect()} and len(O.class_links(df).collect()) == 2


def test_cells_give_the_pairs_with_enough_words_in_common_and_no_others(monkeypatch):
    """Texts of few templates meet in nearly every word; only pairs with enough words in common leave a cell, however deep it goes."""
    import numpy as np
    import pandas as pd

    rng = random.Random(8)
    phrases = [[f"p{i}x{j}y{k}" for k in range(3)] for i in range(12) for j in range(4)]
    sets = [sorted({w for i in range(12) for w in (phrases[4 * i + rng.randrange(4)] + [f"n{rng.randrange(60)}"])[: rng.choice((2, 3, 4))]}) for _ in range(500)]
    sets[150:300] = [sorted(w if rng.random() < 0.8 else f"z{rng.randrange(60)}" for w in sets[i]) for i in range(150)]
    sets = [sorted(set(s)) for s in sets]
    codes = {w: 5000 + i for i, w in enumerate(sorted({w for s in sets for w in s}))}
    rows = pd.DataFrame({"cid": range(500), "codes": [np.array(sorted(codes[w] for w in s), dtype=np.uint16).tobytes() for s in sets]})
    left, right = rows[:150], rows[150:]
    want = {(i, j) for i in range(150) for j in range(150, 500) if len({*sets[i]} & {*sets[j]}) >= O._needed(len(sets[i]), len(sets[j]))}
    assert want
    for leaf, small in ((10**9, 0), (10**9, 2_048), (1, 0), (50, 20)):
        monkeypatch.setattr(O, "LEAF", leaf)
        monkeypatch.setattr(O, "SMALL", small)
        got = O._met(left, right)
        assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)


def test_bands_hold_every_text_once_and_meet_what_can_match():
    import numpy as np

    sizes = np.zeros(60, dtype=np.int64)
    sizes[5:60] = 40
    e, t = O.Bands(sizes, 100), O.Bands(sizes, 30)
    meeting = e.meeting(t)
    for d in range(5, 60):
        for m in range(5, 60):
            if O._needed(d, m) <= min(d, m):
                a, b = e.cell(np.array([7]), np.array([d]))[0], t.cell(np.array([8]), np.array([m]))[0]
                assert b in meeting[a] and a in t.meeting(e)[b]


def test_layout_of_letters_and_hidden_lines_do_not_part_a_comment(spark):
    import unicodedata

    base = "l'été dernier, le café près du théâtre était déjà fermé à cause d'une grève générale"
    spoiler = "the old harbour tunnel closes early on every friday in winter"
    rows = [record(0, base), record(1, unicodedata.normalize("NFD", base), "test"), record(2, base.replace("é", "&eacute;").replace("'", "&#39;"), "test"), record(3, spoiler), record(4, f">!{spoiler}!<", "test"), record(5, f"> {spoiler}", "test")]
    df = records(spark, rows)
    assert {tuple(r) for r in O.found(df).collect()} == {(0, 1), (0, 2), (3, 4)}
    assert len(O.class_members(df).collect()) == 5
