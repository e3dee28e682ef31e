"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node reachable. Alternates the large-star
    and small-star steps of Kiveris et al. (2014): every step is one
    partially aggregated minimum and one join that adaptive execution can
    split, and the number of edges never grows. Edges with a null end and
    loops are ignored; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    start = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    current, path = materialize(start, "edges")
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v")))
        nxt, nxt_path = materialize(small.distinct(), "edges")
        discard(spark, path)
        current, path = nxt, nxt_path
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
