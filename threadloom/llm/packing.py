"""Problem 6: filling fixed-capacity containers.

Large-item matching on a histogram: what a document does to a container depends on its
length alone, so lengths (at most ``capacity`` different ones) are counted in Spark, the
containers are planned from the counts on the driver, and documents take their places by
their rank among those of the same length.

The plan: of two documents above a third of the capacity, at most two fit a container, so
those are matched greedily, longest first, each with the longest partner that still fits.
The smaller ones, longest first, go to the fullest container that holds them, or a new one.
A document longer than the capacity gives full pieces, each a container of its own, and a rest.

Defined results: a document without tokens takes no container (``container`` null, piece 0);
equal documents are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from threadloom.llm.tokens import with_tokens
from threadloom.session import staged

#: Parts into which the documents of one length are split before they are ranked.
SALTS = 64


class Plan:
    """Containers for a histogram of lengths; ``runs[size]`` are ``(first rank, first container, items per container)``."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.runs, self.used = capacity, {}, {}
        self.next = 0
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        large = sorted(s for s in counts if 3 * s > capacity)
        left = dict(counts)
        self._match(large, left)
        for s in sorted((s for s in counts if 3 * s <= capacity and s > 0), reverse=True):
            self._best_fit(s, left[s])

    def _place(self, size: int, n: int, first: int, per: int = 1) -> None:
        at = self.used.get(size, 0)
        self.runs.setdefault(size, []).append((at, first, per))
        self.used[size] = at + n

    def _free(self, gap: int, first: int, n: int) -> None:
        if n <= 0 or gap <= 0:
            return
        if gap not in self.open:
            insort(self.gaps, gap)
            self.open[gap] = []
        self.open[gap].append((first, n))

    def _match(self, large: list[int], left: dict[int, int]) -> None:
        while large:
            a = large[-1]
            n, room = left[a], self.capacity - a
            i = bisect_left(large, room + 1) - 1
            if i < 0:
                large.pop()
                self._place(a, n, self.next)
                self._free(room, self.next, n)
                self.next += n
                continue
            b = large[i]
            m = n // 2 if a == b else min(n, left[b])
            if m:
                self._place(a, m, self.next)
                self._place(b, m, self.next)
                self._free(room - b, self.next, m)
                self.next += m
            left[a] -= m
            left[b] -= m
            if a == b and left[a] == 1:
                # the odd one of this length takes the next shorter partner, or none
                if i > 0:
                    b = large[i - 1]
                    self._place(a, 1, self.next)
                    self._place(b, 1, self.next)
                    self._free(room - b, self.next, 1)
                    left[b] -= 1
                    if not left[b]:
                        large.pop(i - 1)
                else:
                    self._place(a, 1, self.next)
                    self._free(room, self.next, 1)
                self.next += 1
                left[a] = 0
            for s in {a, b}:
                if not left[s]:
                    j = bisect_left(large, s)
                    if j < len(large) and large[j] == s:
                        large.pop(j)

    def _best_fit(self, size: int, n: int) -> None:
        while n:
            i = bisect_left(self.gaps, size)
            if i == len(self.gaps):
                per = self.capacity // size
                bins = -(-n // per)
                self._free(self.capacity, self.next, bins)
                self.next += bins
                continue
            gap = self.gaps[i]
            first, bins = self.open[gap].pop()
            if not self.open[gap]:
                del self.open[gap]
                self.gaps.pop(i)
            per = gap // size
            full = min(bins, n // per)
            if full:
                self._place(size, full * per, first, per)
                self._free(gap - per * size, first, full)
                n -= full * per
            rest = bins - full
            if rest and n and n < per:
                self._place(size, n, first + full, per)
                self._free(gap - n * size, first + full, 1)
                n, full, rest = 0, full + 1, rest - 1
            self._free(gap, first + full, rest)


def assigned(documents: DataFrame, packs: DataFrame, path: str | None = None) -> DataFrame:
    """``pack_name, doc_id, piece, tokens, container``: one row per document, more for one longer than the capacity."""
    spark = documents.sparkSession
    docs = staged(with_tokens(documents.select("doc_id", "text"), path).select("doc_id", "tokens"), "tokens")
    # the table of packs is fixed: one row per kind of container
    sizes = {r["pack_name"]: int(r["capacity_tokens"]) for r in packs.select("pack_name", "capacity_tokens").collect()}
    pack = F.explode(F.array(*[F.struct(F.lit(k).alias("pack_name"), F.lit(c).cast("bigint").alias("c")) for k, c in sizes.items()])) if sizes else None
    if pack is None:
        return spark.createDataFrame([], "pack_name string, doc_id bigint, piece bigint, tokens bigint, container bigint")
    items = docs.select("doc_id", "tokens", pack.alias("p")).select("doc_id", "tokens", "p.pack_name", "p.c")
    rest = F.when(F.col("tokens") > F.col("c"), F.col("tokens") % F.col("c")).otherwise(F.col("tokens"))
    items = items.withColumn("full", F.when(F.col("tokens") > F.col("c"), F.floor(F.col("tokens") / F.col("c"))).otherwise(F.lit(0))).withColumn("size", rest)
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    counts = staged(items.groupBy("pack_name", "size", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("nf")), "counts")
    # at most capacity + 1 rows per pack
    hist = counts.groupBy("pack_name", "size").agg(F.sum("n").alias("n")).collect()
    plans = {k: Plan(c, {r["size"]: r["n"] for r in hist if r["pack_name"] == k and r["size"] > 0}) for k, c in sizes.items()}
    tables = {k: {s: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(runs))) for s, runs in p.runs.items()} for k, p in plans.items()}
    shared = spark.sparkContext.broadcast(tables)
    start = spark.createDataFrame([(k, p.next) for k, p in plans.items()], "pack_name string, opened bigint")

    @F.pandas_udf(LongType())
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, size, rank in batches:
            out = np.full(len(size), -1, dtype=np.int64)
            keys = pd.DataFrame({"k": names, "s": size})
            for (k, s), at in keys.groupby(["k", "s"], sort=False).indices.items():
                if s > 0:
                    first, box, per = shared.value[k][s]
                    r = rank.to_numpy()[at]
                    j = np.searchsorted(first, r, side="right") - 1
                    out[at] = box[j] + (r - first[j]) // per[j]
            yield pd.Series(out)

    by = Window.partitionBy("pack_name", "size").orderBy("salt")
    offset = counts.select("pack_name", "size", "salt", (F.sum("n").over(by) - F.col("n")).alias("before"))
    # full pieces are numbered behind the planned containers, salt by salt and length by length
    whole = counts.groupBy("pack_name", "salt").agg(F.sum("nf").alias("nf"))
    whole = whole.select("pack_name", "salt", (F.sum("nf").over(Window.partitionBy("pack_name").orderBy("salt")) - F.col("nf")).alias("full_before"))
    ranked = items.join(offset, ["pack_name", "size", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("pack_name", "size", "salt").orderBy("doc_id")) - 1)
    part = ranked.withColumn("box", place("pack_name", "size", "rank"))
    one = part.filter("size > 0 or full = 0").select("pack_name", "doc_id", F.col("full").alias("piece"), F.col("size").alias("tokens"), F.when(F.col("box") >= 0, F.col("box")).alias("container"))
    long = items.filter("full > 0").join(F.broadcast(whole), ["pack_name", "salt"]).join(F.broadcast(start), "pack_name")
    upto = Window.partitionBy("pack_name", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("base", F.col("opened") + F.col("full_before") + F.coalesce(F.sum("full").over(upto), F.lit(0)))
    pieces = long.select("pack_name", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"), F.col("c").alias("tokens"), "base").select("pack_name", "doc_id", "piece", "tokens", (F.col("base") + F.col("piece")).alias("container"))
    return one.unionByName(pieces)


def unused(documents: DataFrame, packs: DataFrame, path: str | None = None) -> DataFrame:
    """Per pack: ``containers, used_tokens, unused_tokens, unused_share, least_containers``."""
    placed = assigned(documents, packs, path).groupBy("pack_name").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("used_tokens"))
    out = placed.join(packs.select("pack_name", F.col("capacity_tokens").cast("bigint").alias("c")), "pack_name")
    space = F.col("containers") * F.col("c") - F.col("used_tokens")
    return out.select("pack_name", "containers", "used_tokens", space.alias("unused_tokens"), F.try_divide(space, F.col("containers") * F.col("c")).alias("unused_share"), F.ceil(F.col("used_tokens") / F.col("c")).alias("least_containers"))
