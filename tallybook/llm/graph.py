"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.runtime import durable


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): link the neighbours of u to the least node around u."""
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).select("_u", F.least("_u", "_m").alias("m"))
    joined = pairs.join(least, pairs["u"] == least["_u"])
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): for every node of an edge (a, b) the least node it can reach."""
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.selectExpr("a as u", "b as v").union(edges.selectExpr("b as u", "a as v"))
        up = _star(both, True)
        edges = durable(_star(up.selectExpr("a as u", "b as v"), False))
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.selectExpr("a as node", "b as component").union(edges.selectExpr("b as node", "b as component")).groupBy("node").agg(F.min("component").alias("component"))
