"""Connected components of an edge table, wholly in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_kept, keep


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the smallest node reachable from it.

    Alternates the large-star and small-star steps: each hangs a node's neighbours below the least of them, so the
    edges turn into one star per component in about log(n) rounds. Only minima are grouped (they combine before the
    shuffle), a hub's edges meet its one-row minimum in a join that adaptive execution may split, and every round is
    a written table. Self-loops and repeated edges are harmless; an empty table gives an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = keep(e, "edges")
    seen = _print(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")
        ).select("s.u", "s.v").where("u <> v").distinct()
        new = keep(small, "edges")
        now = _print(new)
        drop_kept(e)
        e = new
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
