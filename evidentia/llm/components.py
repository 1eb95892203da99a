"""Connected components of a distributed edge table by alternating large-star and small-star steps.

Every step is a grouped minimum, which Spark pre-aggregates before its shuffle, and one equi-join. A node with very many
edges (HUB) is salted in that join: its edges are dealt by their other end, and its minimum is copied to each part, so no
task takes them all. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import shared


#: Edges of a node from which on it is salted; hubs that are broadcast at most (a node's key and a number each).
HUB, FEW_HUBS = 256, 200_000


def _minima(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of their u. least: u, m, n (its edges)."""
    hubs = least.filter(F.col("n") > HUB).select("u", F.ceil(F.col("n") / HUB).cast("int").alias("salts"))
    n = hubs.count()
    if not n:
        return edges.join(least.drop("n"), "u")
    known = F.broadcast(hubs) if n <= FEW_HUBS else hubs
    salts = F.coalesce("salts", F.lit(1))
    dealt = edges.join(known, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), salts).cast("int")).drop("salts")
    copied = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HUB, F.ceil(F.col("n") / HUB).cast("int")).otherwise(1) - 1))).drop("n")
    return dealt.join(copied, ["u", "salt"]).drop("salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller, and itself) neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    count = F.count(F.lit(1)).alias("n")
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m"), count).select("u", F.least("u", "m").alias("m"), "n")
        out = _minima(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.filter("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"), count)
        out = _minima(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("t")).first()
    return tuple(r)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest reachable node) for every node that has an edge to another node."""
    least, most = F.least(a, b), F.greatest(a, b)
    e = shared.save(edges.select(most.alias("u"), least.alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(e)
    while True:
        if not mark[0]:
            break
        between = shared.save(_star(e, True), "edges")
        new = shared.save(_star(between, False), "edges")
        shared.drop(e)
        shared.drop(between)
        e, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
