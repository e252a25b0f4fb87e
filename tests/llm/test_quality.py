"""The mixture of problem 8: what EM adds, and that copies change nothing."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from threadloom.llm import quality
from threadloom.session import table

DATA = "/root/testdata/sf0.01"
WORDS = "apricot ladder copper meadow signal lantern walnut basin trellis anvil harbor quill saddle pewter thicket gravel mallet cinder fennel barley".split()


def planted(rng: random.Random) -> list[tuple[int, str, bool]]:
    """Documents with words that stand in no example; True for a case."""
    out = []
    pick = lambda n: [rng.choice(WORDS) for _ in range(n)]
    for i in range(12):
        out += [
            ("\n".join(f"- {' '.join(pick(2))}" for _ in range(8)), True),
            ("\n".join(f"{j + 1}. {' '.join(pick(2))}" for j in range(7)), True),
            ("\n".join("| " + " | ".join([*pick(1), str(rng.randrange(9999)), str(rng.randrange(99))]) + " |" for _ in range(7)), True),
            ("\n".join("\t".join([*pick(1), str(rng.randrange(9999)), str(rng.randrange(99))]) for _ in range(7)), True),
            (" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(4, 9))) for _ in range(16)), True),
            (" ".join([f"We took the {a} to the {b} and it was not as bad as they had said, so I would do it again." for a, b in zip(pick(3), pick(3))]), False),
            (f"i still think that the {pick(1)[0]} was better before they moved it to the {pick(1)[0]} but nobody asked us what we wanted from it", False),
            (f"They said it is about the {pick(1)[0]}.\n\n- {pick(1)[0]}\n- {pick(1)[0]}\n\nAnd then we all went home, because there was nothing left to talk about that night and the rest of it can wait.", False),
        ]
    return [(10_000_000 + i, t, c) for i, (t, c) in enumerate(out)]


def shares(table_, model) -> set[int]:
    kinds = quality.labelled(table_, model).groupBy("doc_id").agg((F.sum(F.when(F.col("kind") == "prose", F.col("chars")).otherwise(0)) / F.sum("chars")).alias("prose"))
    return {r["doc_id"] for r in kinds.filter("prose < 0.5").collect()}


def test_em_decides(spark):
    rows = planted(random.Random(5))
    docs = table(spark, DATA, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"))
    words = quality.common_set(table(spark, DATA, "common_words"))
    blocks = quality.block_table(docs, spark.sparkContext.broadcast(words)).cache()
    cases, every = {r[0] for r in rows if r[2]}, {r[0] for r in rows}
    fitted, lost = [], []
    for seed in range(3):
        fitted.append(shares(blocks, quality.fit(blocks, words, seed=seed)))
        lost.append(shares(blocks, quality.fit(blocks, words, rounds=0, seed=seed)))
        assert len(fitted[-1] & cases) >= 0.97 * len(cases) and not fitted[-1] & every - cases
    # on all documents most fits agree; the unfitted starts leave cases out or take prose for them
    known = {d for d in set.union(*fitted) if sum(d in f for f in fitted) > 1}
    wrong = lambda several: sum(len(f ^ known) for f in several)
    assert wrong(lost) > wrong(fitted), (len(known), wrong(lost), wrong(fitted))
    blocks.unpersist()


def test_copies_change_nothing(spark):
    docs, common = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"), table(spark, DATA, "common_words")
    once = {r["doc_id"] for r in quality.found(docs, common).collect()}
    many = docs.crossJoin(spark.range(60)).select((F.col("doc_id") + F.col("id") * 10_000_000).alias("doc_id"), "text")
    got = {r["doc_id"] for r in quality.found(many, common).collect()}
    assert got == {d + k * 10_000_000 for d in once for k in range(60)}
