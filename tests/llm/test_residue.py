"""Problem 5: forms, trusted messages, and what their near-duplicates add."""

from __future__ import annotations

import random

import pytest

from tests.llm.helpers import record, records
from threadloom.llm import residue

FORMS = ["Hi {{name}}, hello", "Signed, $FULL_NAME$", "Lorem ipsum dolor sit amet", '{"error": 429, "message": "x"}', "TBD TBD TBD", "Dear [INSERT NAME], hello", "placeholder " * 31, "test " * 500, "foo foo foo", "<html><head><title>500 oops</title>"]
TALK = ["You write `{{ host }}` in the config.", "I keep getting a 404 error whenever I open it.", "The portal only works with JavaScript enabled, which is silly.", "The designer left lorem ipsum in the leaflet and half of the town laughed.", "See [link](https://a.example/t/1)", "We like bread.", "No no no!", "ha ha ha", "la la la la", "My browser said access denied at the library, so I went to the desk."]
#: Messages that stand in no list, each with at most one word in ten other than a trusted one.
VARIANTS = [
    "You do not have permission to view this thread.", "The requested URL was not found on our server.", "Sorry, but this page isn't available today.", "Please turn on JavaScript in this browser, then reload the page to continue.",
    "502 Bad Gateway - the upstream machine did not answer in time, try again in a few minutes.", "Gateway timeout: the server took too long to respond, 12345 ms elapsed, request 77.", "Your session has expired, please sign in here again.",
    "Your browser has cookies switched off or does not support it.", "Die angeforderte Adresse existiert nicht mehr oder wurde gelöscht.", "Erreur 410 : la page que vous cherchez n'existe plus.", "Por favor vuelva a iniciar sesión para ver este tema.",
]
WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("s", FORMS)
def test_forms(s):
    assert residue.form(s) == 1


@pytest.mark.parametrize("s", TALK)
def test_no_forms(s):
    assert residue.form(s) == 0


def test_only_propagation_finds_variants(spark):
    rows = [record(i, f"We talked about the bus. {v}\nAnd then we left.") for i, v in enumerate(VARIANTS)] + [record(100 + i, t) for i, t in enumerate(TALK)] + [record(200, "Access denied."), record(201, FORMS[0])]
    df = records(spark, rows)
    got = {r["record_id"] for r in residue.found(df).collect()}
    assert got <= {*range(len(VARIANTS)), 200, 201} and len(got) >= 0.9 * (len(VARIANTS) + 2), got
    assert {r["record_id"] for r in residue.found(df, most_rounds=0).collect()} == {200, 201}


def test_labels_walk_through_components(spark):
    """A variant of a variant is reached over the one between."""
    chain = ["Please turn on JavaScript in this browser, then reload the page to continue.", "Please turn on scripts in this browser, then reload the page to continue.", "Please turn on scripts in this browser, then reload the thread to continue."]
    assert {r["record_id"] for r in residue.found(records(spark, [record(i, s) for i, s in enumerate(chain)])).collect()} == {0, 1, 2}
    assert {r["record_id"] for r in residue.found(records(spark, [record(2, chain[2])])).collect()} == set()


@pytest.mark.parametrize("n, changed", [(10, 1), (16, 1), (20, 2), (30, 3)])
def test_recall_of_near_duplicates(spark, n, changed):
    """Against brute force on common words: at least nine in ten of the pairs at the least similarity meet."""
    rng = random.Random(n)
    pairs = []
    for _ in range(300):
        w = rng.sample(WORDS, n)
        v = list(w)
        for j in rng.sample(range(n), changed):
            v[j] = f"other{rng.randrange(10**6)}"
        pairs.append((" ".join(w), " ".join(v)))
    to = lambda texts: residue.with_sims(spark.createDataFrame(list(enumerate(texts)), "seg bigint, words string"))
    noise = [" ".join(rng.sample(WORDS, n)) for _ in range(3000)]
    old = residue.BROADCAST
    for residue.BROADCAST in (0, 1000):
        got = residue.near(to([b for _, b in pairs] + noise), to([a for a, _ in pairs])).collect()
        seen = {r["seg"] for r in got}
        assert len([i for i in seen if i < 300]) >= 0.9 * 300 and not [i for i in seen if i >= 300]
    residue.BROADCAST = old


def test_candidates_grow_with_the_table_not_its_square(spark):
    """Lookups meet about 8 * 301 / 2**24 of unrelated segments, whatever they hold."""
    rng = random.Random(1)
    segs = [(i, " ".join(rng.sample(WORDS, 12))) for i in range(20_000)]
    sims = residue.with_sims(spark.createDataFrame(segs, "seg bigint, words string"))
    tables = sims.select(residue.F.explode(residue._keys()).alias("k"), "seg")
    some = tables.filter("seg < 50").select("k", residue.F.col("seg").alias("f"))
    met = tables.join(some, "k").filter("seg <> f").count()
    assert met <= 50 * 20_000 * 8 * 4 / 2**24 + 50


def test_labels_spread_from_forms_but_not_from_fields(spark):
    error = "Traceback (most recent call last): the worker for the thread list stopped while it was reading page 3 of the archive"
    notice = "Hello {{name}}, your post in the garden group was removed by a moderator because it had no title"
    rows = [record(0, error), record(1, error.replace("Traceback (most recent call last): the", "Trace most recent call last the")), record(2, notice), record(3, notice.replace("{{name}}", "Anna"))]
    assert {r["record_id"] for r in residue.found(records(spark, rows)).collect()} == {0, 1, 2}


def test_sharing_loses_no_pair(spark):
    """Against brute force: every segment with four in five words common to a label stays, however rare the words are counted."""
    rng = random.Random(3)
    labels, open_ = [], []
    for n in [1, 2, 3, 4, 5, 8, 9, 10, 16, 20, 45, 200]:
        for _ in range(15):
            w = rng.sample(WORDS[: 60 + 2 * n], n)
            labels.append(" ".join(w))
            spare = rng.sample([f"v{i}" for i in range(300)], n)
            gone = rng.randint(0, n // 5)
            open_ += [" ".join(w[gone:]), " ".join(w + spare[: n // 4]), " ".join((w[gone:] + spare[: n // 9])[::-1]), " ".join(rng.sample(WORDS, n))]
    is_alike = lambda a, b: len(a & b) >= residue.ALIKE * len(a | b)
    sets = [set(x.split(" ")) for x in labels]
    want = {i for i, x in enumerate(open_) if any(is_alike(set(x.split(" ")), y) for y in sets)}
    to = lambda texts, counts: residue.with_sims(spark.createDataFrame(list(enumerate(texts)), "seg bigint, words string"), counts)
    for counts in (None, residue.word_counts(spark.createDataFrame([(x,) for x in open_], "words string"))):
        got = {r["seg"] for r in residue.sharing(to(open_, counts), to(labels, counts)).collect()}
        assert len(want) > 500 and want <= got


def test_only_segments_with_rare_words_of_a_label_are_looked_up(spark, monkeypatch):
    """Common words bring no segment into the tables, which are shuffled."""
    rng = random.Random(4)
    own = ["".join(rng.sample("bcdfghklmnprst", 6)) for _ in range(400)]  # digits would count as one word
    talk = [" ".join(rng.sample("the to of page this we was is view you not have do in a".split(), 7) + rng.sample(own, 2)) for _ in range(3000)]
    seen, near = [], residue.near
    monkeypatch.setattr(residue, "near", lambda open_, frontier: (seen.append(open_.count()), near(open_, frontier))[1])
    got = residue.found(records(spark, [record(i, t) for i, t in enumerate(talk)] + [record(9000, VARIANTS[0]), record(9001, "Access denied.")]))
    assert {r["record_id"] for r in got.collect()} == {9000, 9001} and len(seen) == 2 and max(seen) <= 30, seen
