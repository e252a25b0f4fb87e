"""Queries over comments, parents, forests and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import chains as CH
from threadloom.operators import comments as C
from threadloom.operators import forest as FO
from threadloom.plans.common import SQL_C, SQL_F, SQL_W, dump, narrow, sql_hash, with_
from threadloom.session import staged

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


@query("comments_latest", with_(SQL_C) + "SELECT id, parent_key, link_key, subreddit, author, score, controversiality, created_utc, length(body) AS n_chars FROM c")
def comments_latest(spark, d):
    return dump(spark, d).select("id", "parent_key", "link_key", "subreddit", "author", "score", "controversiality", "created_utc", F.length("body").cast("bigint").alias("n_chars"))


@query("parent_lookup", with_(SQL_C) + "SELECT id, parent_key, coalesce(parent_key IN (SELECT id FROM c), false) AS has_parent FROM c")
def parent_lookup(spark, d):
    return C.with_parent(narrow(spark, d)).select("id", "parent_key", "has_parent")


@query("orphan_roots", with_(SQL_C) + "SELECT id, parent_key FROM c WHERE parent_id LIKE 't1\\_%' ESCAPE '\\' AND parent_key NOT IN (SELECT id FROM c)")
def orphan_roots(spark, d):
    return C.orphans(narrow(spark, d)).select("id", "parent_key")


@query("width_counts", with_(SQL_C, SQL_W) + "SELECT id, width FROM w")
def width_counts(spark, d):
    return C.with_width(narrow(spark, d)).select("id", "width")


@query("forest_depth", with_(SQL_C, SQL_F) + "SELECT id, root_id, CAST(depth AS INTEGER) AS depth FROM f")
def forest_depth(spark, d):
    return FO.forest(narrow(spark, d)).select("id", "root_id", "depth")


@query("tree_heights", with_(SQL_C, SQL_F) + "SELECT root_id, CAST(max(depth) AS INTEGER) AS height, count(*) AS size FROM f GROUP BY root_id")
def tree_heights(spark, d):
    return FO.heights(FO.forest(narrow(spark, d)))


_CTX = "list_transform(list_slice(path, greatest(len(path) - 65, 1), len(path) - 1), lambda p: split_part(p, ':', 2))"


@query("ancestors_context", with_(SQL_C, SQL_F) + f"SELECT id, array_to_string({_CTX}, '>') AS context FROM f WHERE depth > 0")
def ancestors_context(spark, d):
    return FO.context_ids(FO.forest(narrow(spark, d))).filter("depth > 0").select("id", F.array_join("context", ">").alias("context"))


SQL_CH = """leaf AS (SELECT f.*, split_part(path[2], ':', 2) AS branch, len(path) AS length FROM f
    WHERE depth >= 1 AND id NOT IN (SELECT parent_key FROM c WHERE parent_key IS NOT NULL) AND root_id IN (SELECT id FROM c WHERE score >= 20)),
  chain AS (SELECT * FROM leaf QUALIFY row_number() OVER (PARTITION BY root_id, branch ORDER BY length DESC, path DESC, id DESC) = 1)"""


def _chains(spark, d):
    c = staged(narrow(spark, d), "comments")
    return c, CH.chains(c, FO.forest(c))


@query("chains", with_(SQL_C, SQL_F, SQL_CH) + "SELECT root_id, branch, id AS leaf_id, CAST(length AS INTEGER) AS length FROM chain WHERE length >= 3")
def chains(spark, d):
    return _chains(spark, d)[1].select("root_id", "branch", "leaf_id", "length")


@query(
    "chain_sets",
    with_(SQL_C, SQL_W, SQL_F, SQL_CH)
    + f"""SELECT k.leaf_id, k.root_id, w.id AS stimulus_id, CAST(k.cut AS INTEGER) AS n_context, coalesce(w.score, 0) AS score, coalesce(w.controversiality, 0) AS controversiality, w.width
  FROM (SELECT id AS leaf_id, root_id, path, {sql_hash("42", "id")} % (length - 1) AS cut FROM chain WHERE length >= 3) k JOIN w ON w.id = split_part(k.path[k.cut + 1], ':', 2)""",
)
def chain_sets(spark, d):
    c, ch = _chains(spark, d)
    return CH.chain_sets(c, ch)


@query("find_node", with_(SQL_C, SQL_F) + "SELECT f.root_id, f.id, f.depth, c.author FROM f JOIN c USING (id) WHERE f.depth >= 3")
def find_node(spark, d):
    """Nodes looked up by id under their root: an equi-join instead of a search."""
    c = staged(dump(spark, d), "comments")
    return FO.forest(c).filter("depth >= 3").join(c.select("id", "author"), "id").select("root_id", "id", "depth", "author")
