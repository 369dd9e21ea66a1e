"""Connected components of links between longs, by alternating large-star and small-star steps.

Links that fit a partition stay in one, so that a step on them is a task without a shuffle: the driver plans a step for each of many
small tables, and keeps what it knows of every task of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, parts_of

#: Links (two longs) of a partition.
LINKS_A_PART = 200_000


def _star(edges: DataFrame, larger: bool, parts: int) -> DataFrame:
    """One step, in `parts` partitions at most. edges has pairs u > v. Each node sends its larger (or smaller) neighbours to the least node it knows."""
    if larger:
        around = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select(F.col("v"), F.col("u"))).coalesce(parts)
    else:
        around = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    if parts == 1:  # a join would shuffle even what is in one partition
        moved = around.withColumn("m", F.least(F.min("other").over(Window.partitionBy("node")), "node"))
    else:
        moved = around.join(around.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m")), "node")
    if larger:
        out = moved.where("other > node").select(F.col("other").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.explode(F.array(F.struct(F.col("other").alias("u"), F.col("m").alias("v")), F.struct(F.col("node").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").coalesce(parts).distinct().coalesce(parts)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(pairs: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches) of every node of pairs (a, b)."""
    edges = checkpoint(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(edges)
    edges = edges.coalesce(parts_of(mark[0], LINKS_A_PART))
    while mark[0]:
        parts = parts_of(mark[0], LINKS_A_PART)
        edges = checkpoint(_star(_star(edges, True, parts), False, parts))
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
