"""Connected components of a link table by alternating stars, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for each id in `links` (a, b: long); component: the smallest id reachable.

    Rounds of large star (each node's larger neighbours move to its smallest one) and small star
    (smaller neighbours move to the smallest), until nothing changes; their number grows with the
    logarithm of the longest path. Each round is written to the shared folder, so lineage stays
    short. Hubs only meet inner joins, which adaptive execution splits. Loops, repeats and null
    ends are dropped; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo and a is not null and b is not null")
    edges = written(edges.distinct(), name)
    seen = _state(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        nearest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(nearest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = written(small.unionAll(nearest.select("hi", F.col("m").alias("lo"))).distinct(), name)
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
