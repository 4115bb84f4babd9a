"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.llm.frames import checkpointed, tidy


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours move to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v): the smallest id
    that it reaches.  The number of rounds grows with the logarithm of the
    graph; each round's edges are written to the checkpoint folder.  A vertex
    with very many neighbours is one row of the aggregated side of each join,
    so adaptive execution can split its edges."""
    edges = checkpointed(edges.select("u", "v").where("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        edges = checkpointed(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
        tidy(edges.sparkSession)
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
