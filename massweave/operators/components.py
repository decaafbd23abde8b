"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` reaches.

    The least neighbour of a node is an aggregate, which merges before the shuffle, and comes
    back by a join that splits hubs; tables are written between steps, so neither lineage nor
    the driver grows.  Nodes without an edge do not occur in the result, those with edges to
    themselves alone do.  Nulls are not allowed.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    cur = materialise(cur, "edges")
    sign = _sign(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = cur.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u, and u, go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v")
        nxt = materialise(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        new = _sign(nxt)
        drop(cur)
        cur = nxt
        if new == sign:
            break
        sign = new
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
    alone = edges.select(F.col(a).alias("node")).where(F.col(a) == F.col(b)).distinct()
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("comp")))


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
