"""Problem 1: the decoder, what its character model decides, and the fitted score."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tests.llm.helpers import record, records
from threadloom.llm import abuse, abuse_rows
from threadloom.llm.abuse import Decoder, fitted, fold, word_grams

ORDINARY = """the council met again and the report is late
we took the bus to the harbour and it was cold
i think that the plan for the school is not bad
they said in the paper that the price of bread will rise
nobody from the office called us back about the water
der rat hat den haushalt noch einmal verschoben
le conseil a voté le budget hier soir
el consejo votó el presupuesto anoche
the river floods the street every spring
my neighbour sells apples and old books""".split("\n")


@pytest.fixture(scope="module")
def grams():
    """Counts over the stimuli of a small table and the labelled sentences."""
    rows = pq.read_table("/root/testdata/sf0.01/summary_records.parquet", columns=["stimulus"]).column("stimulus").to_pylist()
    words = Counter()
    for line in [*(r["body"] for r in rows if r and r["body"]), *abuse_rows.ABUSIVE, *abuse_rows.HARMLESS, *ORDINARY]:
        words.update(abuse.re.findall("[a-z]+", fold(line)))
    out = Counter()
    for w, n in words.items():
        for g in word_grams(w):
            out[g] += n
    return out


@pytest.fixture(scope="module")
def decoder(grams):
    return Decoder(grams)


@pytest.fixture(scope="module")
def scorer():
    return fitted(ORDINARY)


@pytest.mark.parametrize(
    "written, meant",
    [
        ("b1tch", "bitch"), ("d1p$h1t", "dipshit"), ("@$$h0l3", "asshole"), ("m o r o n", "moron"), ("h.a.l.f.w.i.t", "halfwit"), ("i\u200bd\u200bi\u200bo\u200bt", "idiot"),
        ("scumbaaaag", "scumbag"), ("w****r", "wanker"), ("W A S T E   O F   O X Y G E N", "waste of oxygen"), ("m\u043er\u043en", "moron"), ("i******e", "imbecile"),
        ("i d 1 0 t", "idiot"), ("i.d.1.0.t", "idiot"), ("1 d 1 0 t", "idiot"), ("id-iot", "idiot"), ("mo ron", "moron"), ("idiioot", "idiot"), ("id 1ot", "idiot"),
        ("enc*l\u00e9", "encule"), ("d\u00e9b1le", "debile"), ("cr3t\u00edn", "cretin"), ("id1" + "o" * 200 + "t", "idiot"), ("l0$er", "loser"), ("verm1n", "vermin"),
    ],
)
def test_restores_disguises(decoder, written, meant):
    assert decoder.restore(f"you are a {written}!") == f"you are a {meant}!"


@pytest.mark.parametrize("text", ["I was there on Friday at 10", "The **Numbers** don't add up", "U.S. court, page 404", "hmm ok", "", "you put a book down", "to add to it", "at 1 0 or 5 5", "the class is good"])
def test_leaves_plain_text(decoder, text):
    assert decoder.restore(text) == text.lower()


def brute(decoder, token):
    """Best reading by trying every one."""
    reads = [(0.0, "")]
    for options in decoder.lattice(token):
        reads = [(lp + cost, w + x) for lp, w in reads for letters, cost in options for x in (letters or [""])]
    return max((lp + decoder.spelled(w), w) for lp, w in reads)


@pytest.mark.parametrize("token", ["1l1", "b4st4rd", "sooooo", "a*", "1*t", "h|||o", "f**k", "i*l*1"])
def test_viterbi_is_exact(decoder, token):
    lp, word = brute(decoder, token)
    got = decoder.viterbi(token)
    assert max(lp for lp, w in [(brute(decoder, token)[0], word)]) == pytest.approx(lp) and (got == word or decoder.spelled(got) == pytest.approx(decoder.spelled(word)))


#: Words that stand in no list of insults; which letter a symbol hides only the model knows.
HIDDEN = ["be1ong in cages", "breed 1ike cockr0aches", "burn your house down whi1e you s1eep, i wi11 find you", "you wi11 b1eed", "se11 your daughter, you wi11 suffer", "h a n g   y o u r s e l f", "de1ete your account, you p@thetic fool", "s t e r i l i s e d before they outnumber us",
          "the wor1d would be better off without you", "k i l l   y o u r s e l f"]


def test_the_character_model_decides(decoder):
    """Without it fewer of the planted disguises come back, and words run together."""
    want = [fold(h.replace("1", "l").replace("0", "o").replace("@", "a")) for h in HIDDEN]
    want[5], want[7], want[9] = "hang yourself", "sterilised before they outnumber us", "kill yourself"
    right = lambda d: sum(" ".join(d.restore(h).split()) == w for h, w in zip(HIDDEN, want))
    assert right(decoder) >= 9
    assert right(Decoder({})) <= 5


@pytest.mark.parametrize("text", ["you are such a moron", "I hope someone breaks your legs", "Du bist ein Vollidiot", "Ferme ta gueule, connard", "Eres un imb\u00e9cil", "all of them are vermin and should be driven out", "send nudes", "go drink bleach"])
def test_cases(scorer, text):
    assert scorer.score(fold(text)) >= 0.5


@pytest.mark.parametrize("text", ["I was the idiot who forgot the tickets", "Damn, the soup was good.", "Fuck yeah, the trains run again.", "The play about bastard heirs was fully booked.", "The orchard suffered from parasites.", "They killed the bill in committee", ""])
def test_no_cases(scorer, text):
    assert scorer.score(fold(text)) < 0.5


def test_wordings_held_out_of_the_fit(monkeypatch):
    """Every fifth labelled sentence is left out; most of them are still told apart."""
    order = random.Random(3).sample(range(len(abuse_rows.ABUSIVE)), len(abuse_rows.ABUSIVE))
    held = [abuse_rows.ABUSIVE[i] for i in order[::5]]
    other = [h for i, h in enumerate(abuse_rows.HARMLESS) if i % 5 == 0]
    monkeypatch.setattr(abuse, "ABUSIVE", [a for a in abuse_rows.ABUSIVE if a not in held])
    monkeypatch.setattr(abuse, "HARMLESS", [h for h in abuse_rows.HARMLESS if h not in other])
    s = fitted(ORDINARY)
    assert sum(s.score(fold(t)) >= 0.5 for t in held) >= 0.6 * len(held)
    assert sum(s.score(fold(t)) >= 0.5 for t in other) <= 0.2 * len(other)


def test_the_bound_skips_no_score(scorer):
    """Sentences that the bound on their features passes over score under ``LEAST``."""
    for t in [*abuse_rows.ABUSIVE, *abuse_rows.HARMLESS, *ORDINARY]:
        for words in scorer.tokens(fold(t)):
            if words and sum(scorer.cap.get(w, 0.0) for w in words) < scorer.need:
                assert scorer.logit(words) < scorer.need + scorer.bias + 1e-9


def test_long_text_counts_to_its_end(spark):
    long = "The council met again and the report is late. " * 2000
    rows = [record(1, long + "You are a complete m0r0n."), record(2, long), record(3, None), record(4, "")]
    assert [tuple(r) for r in abuse.found(records(spark, rows)).collect()] == [(1, "s1")]
