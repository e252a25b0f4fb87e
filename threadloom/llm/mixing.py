"""Problem 7: mixing sources to target weights.

Equal texts are one class, whatever their document ids; a class belongs to every source that
holds a copy, so sources overlap. Classes are aggregated by membership pattern (at most two to
the number of sources), a min-cost flow on the driver routes the patterns' tokens to the source
quotas with convex costs (the k-th use of a pattern costs k - 1), and classes are then drawn in
seeded order: a pattern's classes lie on a line, layer after layer, and the flows cut it.

The total is the largest at which every source that has tokens can meet its share, but at least
``LEAST_TOTAL`` of all tokens; below that, what a source lacks is reported.

A class is used at most as often as the strictest of its sources allows. Defined results:
documents without tokens or without a listed source are not drawn; source names are compared
without case and outer blanks; an empty table gives no rows, and a report of zeros.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tokens import with_tokens
from threadloom.session import staged

LEAST_TOTAL = 0.5
#: Hash ranges over which a pattern's classes are laid on the line.
RANGES = 1024


def min_cost_flow(supply: dict[tuple, tuple[int, int]], quota: dict[str, int]) -> tuple[int, dict[tuple, int]]:
    """Flow from patterns to sources: ``supply[pattern] = (tokens of one use, most uses)``.

    Successive shortest paths with potentials; the layers of a pattern are parallel arcs of
    rising cost. Returns the total and the flow by ``(pattern, source)``.
    """
    pats, srcs = sorted(supply), sorted(quota)
    ids = {("p", p): i + 1 for i, p in enumerate(pats)} | {("s", s): i + 1 + len(pats) for i, s in enumerate(srcs)}
    sink = 1 + len(ids)
    graph: list[list[list]] = [[] for _ in range(sink + 1)]

    def arc(u: int, v: int, cap: int, cost: int) -> list:
        a, b = [v, cap, cost, None], [u, 0, -cost, None]
        a[3], b[3] = b, a
        graph[u].append(a)
        graph[v].append(b)
        return a

    flows = {}
    for p in pats:
        n, most = supply[p]
        for k in range(most):
            arc(0, ids["p", p], n, k)
        for s in p:
            if s in quota:
                flows[p, s] = arc(ids["p", p], ids["s", s], n * most, 0)
    for s in srcs:
        arc(ids["s", s], sink, quota[s], 0)
    total, high = 0, [0] * (sink + 1)
    while True:
        dist, back = {0: 0}, {}
        heap, done = [(0, 0)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for a in graph[u]:
                if a[1] > 0:
                    nd = d + a[2] + high[u] - high[a[0]]
                    if nd < dist.get(a[0], 1 << 60):
                        dist[a[0]], back[a[0]] = nd, (u, a)
                        heapq.heappush(heap, (nd, a[0]))
        if sink not in dist:
            break
        for v in range(sink + 1):
            high[v] += min(dist.get(v, dist[sink]), dist[sink])
        push, v = 1 << 60, sink
        while v:
            push, v = min(push, back[v][1][1]), back[v][0]
        v = sink
        while v:
            u, a = back[v]
            a[1] -= push
            a[3][1] += push
            v = u
        total += push
    return total, {k: a[3][1] for k, a in flows.items() if a[3][1]}


def quotas(supply: dict[tuple, tuple[int, int]], shares: dict[str, float]) -> tuple[int, dict[str, int]]:
    """Total and quota by source: the largest total that every source with tokens can meet, at least ``LEAST_TOTAL`` of one use of everything."""
    held = {s for p in supply for s in p if supply[p][0] * supply[p][1] > 0}
    once = sum(n for n, _ in supply.values())
    live = {s: w for s, w in shares.items() if s in held and w > 0}
    of = lambda t, w: {s: int(t * x / sum(w.values())) for s, x in w.items()} if w else {}
    low, high = int(once * LEAST_TOTAL), sum(n * m for n, m in supply.values())
    if live and min_cost_flow(supply, of(low, live))[0] == sum(of(low, live).values()):
        while high - low > max(1, once // 10_000):
            mid = (low + high) // 2
            if min_cost_flow(supply, of(mid, live))[0] == sum(of(mid, live).values()):
                low = mid
            else:
                high = mid
        return low, of(low, live)
    return low, of(low, {s: w for s, w in shares.items() if w > 0})


def source_name(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"[\s\p{Cf}]+", "")), "^/?r/", "")


def prepared(documents: DataFrame, weights: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, dict, dict]:
    """``docs`` (doc_id, source, tokens, cls), ``classes`` (cls, tokens, pattern), shares and most uses by source."""
    # the table of weights is fixed: one row per source
    rows = weights.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").collect()
    shares = {r["s"]: float(r["target_share"] or 0) for r in rows}
    most = {r["s"]: int(r["max_repeats"] or 0) for r in rows}
    docs = with_tokens(documents.select("doc_id", "text", source_name(F.col("source")).alias("source")), path)
    docs = docs.filter("tokens > 0").select("doc_id", "source", "tokens", F.md5("text").alias("cls"))
    docs = staged(docs.filter(F.col("source").isin(sorted(shares))), "docs")
    classes = docs.groupBy("cls").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern"))
    return docs, staged(classes, "classes"), shares, most


def drawn(documents: DataFrame, weights: DataFrame, path: str | None = None, seed: str = "0") -> tuple[DataFrame, dict[str, int], dict[str, float]]:
    """Uses of every drawn document ``doc_id, source, tokens, uses``, the quotas and the shares."""
    docs, classes, shares, most = prepared(documents, weights, path)
    spark = documents.sparkSession
    # at most 2 ** len(shares) patterns
    agg = classes.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()
    supply = {tuple(r["pattern"]): (int(r["n"]), min(most[s] for s in r["pattern"])) for r in agg}
    supply = {p: v for p, v in supply.items() if v[1] > 0}
    _, want = quotas(supply, shares)
    _, flows = min_cost_flow(supply, want)
    cuts, at = [], {}
    for (p, s), f in sorted(flows.items()):
        cuts.append((list(p), s, at.get(p, 0), at.get(p, 0) + f))
        at[p] = at.get(p, 0) + f
    layers = [(list(p), supply[p][0], -(-at[p] // supply[p][0])) for p in at]
    cut = spark.createDataFrame(cuts, "pattern array<string>, source string, low bigint, high bigint")
    layer = spark.createDataFrame(layers, "pattern array<string>, length bigint, layers bigint")
    line = classes.withColumn("h", F.xxhash64(F.lit(seed), "cls")).withColumn("range", F.pmod("h", F.lit(RANGES)).cast("int"))
    sums = line.groupBy("pattern", "range").agg(F.sum("tokens").alias("t"))
    sums = sums.select("pattern", "range", (F.sum("t").over(Window.partitionBy("pattern").orderBy("range")) - F.col("t")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "range").orderBy("h", "cls")) - F.col("tokens")
    line = line.withColumn("inside", inside).join(sums, ["pattern", "range"]).join(F.broadcast(layer), "pattern")
    line = line.select("cls", "pattern", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("layers") - 1), lambda k: k * F.col("length") + F.col("before") + F.col("inside"))).alias("x"))
    uses = line.join(F.broadcast(cut), "pattern").filter("x >= low and x < high").groupBy("cls", "source").agg(F.count("*").alias("uses"))
    copy = docs.groupBy("cls", "source").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
    return uses.join(copy, ["cls", "source"]).select("doc_id", "source", "tokens", "uses"), want, shares


def mix(documents: DataFrame, weights: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, tokens, uses`` of the drawn documents."""
    return drawn(documents, weights, path)[0]


def shares(documents: DataFrame, weights: DataFrame, path: str | None = None) -> DataFrame:
    """Per source: ``target_share, quota_tokens, tokens, share, n_docs, max_uses``."""
    rows, want, target = drawn(documents, weights, path)
    spark = documents.sparkSession
    plan = spark.createDataFrame([(s, target[s], want.get(s, 0)) for s in sorted(target)], "source string, target_share double, quota_tokens bigint")
    got = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("max_uses"))
    out = plan.join(F.broadcast(got), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return out.select("source", "target_share", "quota_tokens", "tokens", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)).alias("share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"))
