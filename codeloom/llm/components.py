"""Connected components of an edge table by alternating large-star and small-star steps.

Every step replaces edges by edges to smaller neighbours and keeps components as they are; in the end each node points to
the smallest of its component, which is also how one sees that it is the end: edges that are such stars at once take no step.
Steps are grouped minima and equality joins; a hub's edges are pre-aggregated before the shuffle and split among tasks at run
time, since both sides of a join come from written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Workspace


def _attach(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """edges (u, v) with m, the smallest v of u."""
    least = space.write(edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")), name)
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself."""
    end = lambda node, u, v: F.struct(F.col(node).alias("node"), F.lit(u).alias("u"), F.lit(v).alias("v"))
    ends = edges.select(F.explode(F.array(end("u", 1, 0), end("v", 0, 1))).alias("e")).select("e.*")
    ends = ends.groupBy("node").agg(F.sum("u").alias("u"), F.max("v").alias("v"))
    return ends.agg(F.count_if((F.col("u") > 1) | (F.col("u") > 0) & (F.col("v") > 0))).first()[0] == 0


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """node, root (smallest node of its component) for the nodes of edges (a, b), written. Roots point to themselves."""
    now = space.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    k = 0
    while not stars(now):  # each round at least lowers one end; the number of rounds grows as the logarithm of the nodes
        k += 1
        both = space.write(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{name}-both-{k}")
        large = _attach(both, space, f"{name}-large-least-{k}").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = space.write(large.where("u <> v").distinct(), f"{name}-large-{k}")
        small = _attach(large, space, f"{name}-small-least-{k}")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = space.write(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-{k}")
        for old in (f"{name}-both-{k}", f"{name}-large-least-{k}", f"{name}-large-{k}", f"{name}-small-least-{k}", f"{name}-{k - 1}"):
            space.drop(old)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    out = space.write(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), name)
    space.drop(f"{name}-{k}")
    return out
