"""Problem 2: splits that keep related records together.

Records are edges between account and thread nodes; a record id that comes with several of them ties them. A persisted table ``node, comp, split``
holds the components so far (``save`` and ``load`` keep versions of it under a path); a new batch is merged into it with pointer jumping. Known
components keep their split, new ones fill the deficits of the wanted proportions, and a
record or new component that ties components of different splits together is quarantined.

Defined results: a record without account and thread is a component of its own; null,
blank and placeholder names relate nothing; repeated rows of a record count once; an empty
batch leaves the table as it is; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.components import connected
from threadloom.session import scratch, staged

# Author names that stand for nobody in particular.
NOBODY = ["", "[deleted]", "[removed]", "automoderator"]
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Components of at least this share of all records are placed one by one; there are at most 1 / BIG of them.
BIG = 0.001
STATE, MEMBERS = "node string, comp string, split string", "record_id bigint, comp string, split string"
#: Hash ranges over which the small components are laid out.
RANGES = 1024


def account(name: Column) -> Column:
    """Comparable account name, or null for nobody."""
    low = F.trim(F.regexp_replace(F.lower(name), r"[\s\p{Cf}]+", ""))
    bare = F.regexp_replace(F.regexp_replace(low, r"^.*?/?(?:u|user)/", ""), r"[^\p{L}\p{N}_\-]", "")
    return F.when(~low.isin(NOBODY) & ~bare.isin("", "automoderator"), bare)


def thread(link: Column) -> Column:
    """Bare, lower-case thread id without prefix or address, or null."""
    low = F.regexp_replace(F.lower(link), r"[\s\p{Cf}]+", "")
    last = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[?#].*$", ""), r"^.*/comments/", ""), r"/.*$", "")
    bare = F.regexp_replace(F.regexp_replace(last, r"^t3_", ""), r"[^a-z0-9_\-]", "")
    return F.when(bare != "", bare)


def keyed(records: DataFrame) -> DataFrame:
    """Distinct ``record_id, a, t``: account and thread of each record."""
    return records.select("record_id", account(F.col("stimulus.author")).alias("a"), thread(F.col("meta.link_id")).alias("t")).distinct()


def components(keys: DataFrame) -> DataFrame:
    """``keys`` plus ``comp``: ``t:`` and the smallest thread of the component, else ``a:`` and its account, else ``r:`` and the record.

    Threads are the nodes: an account becomes one edge per further thread (to its smallest),
    so accounts of one thread, the great majority, never enter the graph.
    """
    pairs = keys.filter("a is not null and t is not null").select("a", "t").distinct()
    least = pairs.groupBy("a").agg(F.min("t").alias("m"), F.count("*").alias("n"))
    least = staged(least, "least")
    many = least.filter("n > 1").select("a", "m")
    roots = connected(pairs.join(many, "a").filter("t <> m").select(F.col("t").alias("u"), F.col("m").alias("v")))
    roots = staged(roots, "roots")
    with_t = keys.filter("t is not null").join(roots.select(F.col("node").alias("t"), "root"), "t", "left").select("record_id", "a", "t", F.coalesce("root", "t").alias("root"))
    lone = keys.filter("t is null").join(least.select("a", F.col("m").alias("node")), "a", "left").join(roots, "node", "left").select("record_id", "a", F.lit(None).cast("string").alias("t"), F.coalesce("root", "node").alias("root"))
    comp = F.coalesce(F.concat(F.lit("t:"), "root"), F.concat(F.lit("a:"), "a"), F.concat(F.lit("r:"), F.col("record_id").cast("string")))
    return tied(staged(with_t.unionByName(lone).select("record_id", "a", "t", comp.alias("comp")), "comps"))


def tied(comps: DataFrame) -> DataFrame:
    """Components that one record id ties together (it came with several accounts or threads) become one."""
    first, back = F.translate(F.substring("comp", 1, 1), "tar", "012"), F.translate(F.substring("root", 1, 1), "012", "tar")
    node = comps.select("record_id", F.concat(first, F.expr("substring(comp, 2)")).alias("node")).distinct()
    least = node.groupBy("record_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    roots = connected(node.join(least, "record_id").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    name = lambda c, sign: F.concat(sign, F.expr(f"substring({c}, 2)"))
    to = roots.select(name("node", F.translate(F.substring("node", 1, 1), "012", "tar")).alias("comp"), name("root", back).alias("to"))
    return comps.join(to, "comp", "left").select("record_id", "a", "t", F.coalesce("to", "comp").alias("comp"))


def save(path: str, state: DataFrame, members: DataFrame) -> None:
    """Write the tables as a new version under ``path``, then name it in ``current`` by one atomic rename; the version before it stays whole until then."""
    spark = state.sparkSession
    version = uuid.uuid4().hex
    state.write.parquet(f"{path}/{version}/state")
    members.write.parquet(f"{path}/{version}/members")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    fresh, current = fs.Path(f"{path}/_next-{version}"), fs.Path(f"{path}/current")
    out = fresh.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fresh)
    out.write(bytearray(version.encode()))
    out.close()
    kinds = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, current, how)


def load(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """``state`` and ``members`` of the current version under ``path``, or nothing."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    current = fs.Path(f"{path}/current")
    if not current.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(current):
        return None, None
    version = spark.read.text(current.toString()).first()[0]
    return spark.read.schema(STATE).parquet(f"{path}/{version}/state"), spark.read.schema(MEMBERS).parquet(f"{path}/{version}/members")


def merge(path: str, records: DataFrame, proportions: dict[str, float] = PROPORTIONS, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """Merge a batch into the tables kept under ``path`` (nothing there yet: begin them); returns the new tables, read from there."""
    spark = records.sparkSession
    save(path, *update(*load(spark, path), records, proportions, seed))
    return load(spark, path)


def found(records: DataFrame, path: str | None = None) -> DataFrame:
    """``record_id, group_link`` of the records that belong with at least one other record, read from the component table under ``path``.

    Without a path the table is begun in the shared folder and lives as long as the driver.
    """
    state, members = merge(path or scratch(records.sparkSession, "components"), records)
    members = members.select("record_id", "comp").distinct()
    links = state.filter("node like 't:%'").groupBy("comp").agg(F.min(F.expr("substring(node, 3)")).alias("group_link"))
    # as many components as the records make: both sides are shuffled, none is broadcast
    groups = members.groupBy("comp").agg(F.count("*").alias("n")).filter("n > 1").join(links.hint("merge"), "comp", "left")
    return members.join(groups.hint("merge"), "comp").select("record_id", "group_link")


def fill(sizes: DataFrame, have: dict[str, int], proportions: dict[str, float] = PROPORTIONS, seed: str = "0") -> DataFrame:
    """``comp, split`` for new components (``comp, n``) so that totals near the proportions.

    Big components (at most 1 / BIG) go one by one, largest first, to the split with the largest
    deficit. The rest are laid on a line in seeded hash order and cut at the deficits; the line is
    summed over hash ranges first, so no task sees more than one range.
    """
    names = sorted(proportions, key=lambda s: (-proportions[s], s))
    share = {s: proportions[s] / sum(proportions.values()) for s in names}
    total = sizes.agg(F.sum("n")).first()[0] or 0
    want = {s: share[s] * (total + sum(have.values())) - have.get(s, 0) for s in names}
    big = sizes.filter(F.col("n") >= F.greatest(F.lit(2.0), F.lit(BIG * total)))
    placed: dict[str, str] = {}
    for r in sorted(big.collect(), key=lambda r: (-r["n"], r["comp"])):
        s = max(names, key=lambda s: want[s])
        placed[r["comp"]] = s
        want[s] -= r["n"]
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), "comp")), 1, 8), 16, 10).cast("bigint")
    small = sizes.filter(~(F.col("n") >= F.greatest(F.lit(2.0), F.lit(BIG * total)))).withColumn("h", h).withColumn("range", (F.col("h") % RANGES).cast("int"))
    sums = small.groupBy("range").agg(F.sum("n").alias("in_range"))
    before = sums.select("range", (F.sum("in_range").over(Window.orderBy("range")) - F.col("in_range")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("h", "comp")) - F.col("n")
    line = small.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("at", F.col("before") + F.col("inside"))
    rest = sum(max(w, 0) for w in want.values()) or 1.0
    length = total - sum(r for r in [big.agg(F.sum("n")).first()[0] or 0])
    cut, choice = 0.0, F.lit(names[0])
    for s in names:
        low, cut = cut, cut + max(want[s], 0) / rest * length
        choice = F.when((F.col("at") >= low) & (F.col("at") < cut), F.lit(s)).otherwise(choice)
    out = line.select("comp", choice.alias("split"))
    if placed:
        spark = sizes.sparkSession
        out = out.unionByName(spark.createDataFrame(list(placed.items()), "comp string, split string"))
    return out


def update(state: DataFrame | None, members: DataFrame | None, records: DataFrame, proportions: dict[str, float] = PROPORTIONS, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """Merge a batch into the persisted tables; returns the new ``state`` and ``members``.

    ``state``: ``node, comp, split``; ``members``: ``record_id, comp, split`` of every record so far,
    with split ``quarantine`` where the record would tie different splits together. A record id already
    in ``members`` keeps its row.
    """
    keys = keyed(records)
    if state is None or members is None:
        comps = components(keys)
        comps = staged(comps, "tied")
        sizes = staged(comps.groupBy("comp").agg(F.count_distinct("record_id").alias("n")), "sizes")
        chosen = staged(fill(sizes, {}, proportions, seed), "chosen")
        return _tables(comps.join(chosen, "comp"))
    keys = staged(keys.join(members.select("record_id"), "record_id", "left_anti"), "keys")
    node = state.select("node", "comp", "split")
    at = lambda k, c: node.select(F.substring("node", 3, 1_000_000).alias(c), F.col("comp").alias(f"{c}_comp"), F.col("split").alias(f"{c}_split"), F.substring("node", 1, 1).alias("k")).filter(F.col("k") == k).drop("k")
    seen = keys.join(at("a", "a"), "a", "left").join(at("t", "t"), "t", "left")
    seen = seen.select("record_id", F.when(F.col("a_comp").isNull(), F.col("a")).alias("na"), F.when(F.col("t_comp").isNull(), F.col("t")).alias("nt"), "a", "t", "a_comp", "a_split", "t_comp", "t_split")
    seen = staged(seen, "seen")
    # components among the nodes that are new, then what each of them touches of the old
    fresh = components(seen.select("record_id", F.col("na").alias("a"), F.col("nt").alias("t"))).select("record_id", F.col("comp").alias("fresh"))
    both = staged(seen.join(fresh, "record_id"), "both")
    old = both.select("fresh", F.explode(F.array(F.struct(F.col("a_comp").alias("c"), F.col("a_split").alias("s")), F.struct(F.col("t_comp").alias("c"), F.col("t_split").alias("s")))).alias("o")).filter("o.c is not null")
    touched = staged(old.groupBy("fresh").agg(F.min("o.s").alias("s1"), F.max("o.s").alias("s2"), F.min("o.c").alias("to")), "touched")
    # old components of one split that a batch ties together become one
    ties = old.select("fresh", F.col("o.c").alias("c")).distinct().join(touched.filter("s1 = s2").select("fresh", "to"), "fresh").filter("c <> to")
    merged = staged(connected(ties.select(F.col("c").alias("u"), F.col("to").alias("v"))), "merged")
    state = _renamed(state, merged)
    members = _renamed(members, merged)
    touched = touched.join(merged.select(F.col("node").alias("to"), "root"), "to", "left").select("fresh", "s1", "s2", F.coalesce("root", "to").alias("to"))
    new = both.join(touched, "fresh", "left")
    free = new.filter("s1 is null")
    sizes = staged(free.groupBy(F.col("fresh").alias("comp")).agg(F.count_distinct("record_id").alias("n")), "sizes")
    have = {r["split"]: r["n"] for r in members.filter("split <> 'quarantine'").groupBy("split").agg(F.count_distinct("record_id").alias("n")).collect()}
    chosen = staged(fill(sizes, have, proportions, seed), "chosen")
    split = F.when(F.col("s1").isNull(), F.col("split")).when(F.col("s1") == F.col("s2"), F.col("s1")).otherwise(F.lit("quarantine"))
    placed = new.join(chosen.withColumnRenamed("comp", "fresh"), "fresh", "left").select("record_id", "a", "t", "na", "nt", F.coalesce("to", "fresh").alias("comp"), split.alias("split"))
    placed = staged(placed, "placed")
    more_state, _ = _tables(placed.filter("split <> 'quarantine'").select("record_id", F.col("na").alias("a"), F.col("nt").alias("t"), "comp", "split"))
    return staged(state.unionByName(more_state), "state"), staged(members.unionByName(placed.select("record_id", "comp", "split").distinct()), "members")


def _renamed(df: DataFrame, merged: DataFrame) -> DataFrame:
    to = merged.filter("node <> root").select(F.col("node").alias("comp"), "root")
    rest = [c for c in df.columns if c != "comp"]
    return df.join(to, "comp", "left").select(*rest, F.coalesce("root", "comp").alias("comp"))


def _tables(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = F.filter(F.array(F.concat(F.lit("a:"), "a"), F.concat(F.lit("t:"), "t")), lambda x: x.isNotNull())
    state = placed.select(F.explode(nodes).alias("node"), "comp", "split").distinct()
    return staged(state, "state"), staged(placed.select("record_id", "comp", "split").distinct(), "members")


def splits(records: DataFrame, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """``record_id, comp, split`` of one batch from nothing."""
    return update(None, None, records, proportions)[1]


def incremental(records: DataFrame, batch: Column, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """Two batches, those where ``batch`` is false first; ``record_id, comp, split, late``."""
    marked = records.withColumn("late", F.coalesce(batch, F.lit(False)))
    state, members = update(None, None, marked.filter("not late"), proportions)
    _, after = update(state, members, marked.filter("late"), proportions)
    return after.join(members.select("record_id", F.lit(False).alias("late")), "record_id", "left").select("record_id", "comp", "split", F.coalesce("late", F.lit(True)).alias("late"))
