"""Connected components of graphs that no task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import table

#: Keys with more than one in so many of all rows meet their facts by a broadcast, so they number fewer than this.
HUB_SHARE = 10_000


def meet(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts`` (key, k rows that hold it, ...) on ``key``. Rows of hubs stay where they are; ``total``
    is the number of rows."""
    hub = F.col("k") * HUB_SHARE > F.lit(total)
    hubs = F.broadcast(facts.where(hub))
    return rows.join(hubs, key).unionByName(rows.join(hubs.select(key), key, "left_anti").join(facts.where(~hub), key))


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root): where the parents of nodes end. Pointers jump, so a chain's length halves with each step."""
    while True:
        total = parents.count()
        facts = parents.groupBy(F.col("root").alias("at")).agg(F.count("*").alias("k"))
        nexts = parents.select(F.col("node").alias("at"), F.col("root").alias("_next")).join(facts, "at")
        # a parent without a row of its own is a root
        found = meet(parents.withColumn("at", F.col("root")), facts.join(nexts.drop("k"), "at", "left"), "at", total)
        found = table(found.select("node", F.coalesce("_next", "root").alias("root"), (F.col("_next").isNotNull() & (F.col("_next") != F.col("root"))).alias("_moved")))
        parents = found.select("node", "root")
        if not found.where("_moved").limit(1).count():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the component of each node of ``edges`` (a, b), named by one of its nodes; any orderable type of node.

    In each round every node points to the neighbour of the least hash (anew each round) if that is less than its own;
    edges are then those between the roots of such trees. About half of all nodes or more go with each round, whatever
    the graph; a hub is no more than rows that stay where they are.
    """
    edges = table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    roots = table(nodes.withColumn("root", F.col("node")))
    open_, turn = table(edges.where("u <> v")), 0
    while (total := open_.count()) > 0:
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = open_.unionByName(open_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u"))).alias("m"))
        found = _roots(table(least.select(F.col("u").alias("node"), F.col("m.x").alias("root")).where("node <> root")))
        open_ = table(_renamed(_renamed(open_, found, "u", total), found, "v", total).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        roots = table(_renamed(roots, found, "root", roots.count()))
    return roots


def _renamed(rows: DataFrame, found: DataFrame, column: str, total: int) -> DataFrame:
    """``rows`` with the roots of the nodes in ``column``; nodes that ``found`` lacks are roots."""
    counts = rows.groupBy(column).agg(F.count("*").alias("k"))
    facts = counts.join(found.select(F.col("node").alias(column), F.col("root").alias("_root")), column, "left")
    return meet(rows, facts, column, total).withColumn(column, F.coalesce("_root", column)).select(*rows.columns)
