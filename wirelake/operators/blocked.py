"""Windows over long series in blocks of their order, so that a series with most of all rows is many tasks' work.

What a block needs of those before it is one row for each of them, or a halo of rows near its border.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _block(df: DataFrame, at: str, width: int | None, block: Column | None = None) -> DataFrame:
    """Blocks of `width` of a whole number, or those of a column that orders rows before `at` does, such as an object's key."""
    return df.withColumn("_block", F.floor(F.col(at) / width).cast("long") if block is None else block)


def with_values(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of few, whose keys are unique; null is a key like others."""
    named = few.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in few.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(named, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def _order(at: str, ties: list[str], desc: bool) -> list[Column]:
    return [F.desc(at) if desc else F.asc(at), *map(F.col, ties)]


def running_sum(df: DataFrame, keys: list[str], at: str, value: str, width: int | None = None, ties: list[str] = (), name: str = "upto", desc: bool = False, block: Column | None = None) -> DataFrame:
    """Sum of value over a series' rows up to each one, in order of `at` (a whole number, from its end if desc), then ties.

    Blocks are `width` of `at`, or a column's; their sums are added up first.
    """
    rows = _block(df, at, width, block)
    sums = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_block") if desc else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(*_order(at, list(ties), desc)).rowsBetween(Window.unboundedPreceding, 0)
    return with_values(rows, sums, [*keys, "_block"]).withColumn(name, F.sum(value).over(within) + F.col("_before")).drop("_block", "_before")


def previous(df: DataFrame, keys: list[str], at: str, value: str, width: int | None = None, ties: list[str] = (), name: str = "before", block: Column | None = None) -> DataFrame:
    """value of the row before each one of its series, in order of `at`, then ties; a block's first row gets that of the last block before it with rows."""
    rows = _block(df, at, width, block)
    last = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(at, *ties)).alias("_last"))
    last = last.select(*keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_last"))
    within = Window.partitionBy(*keys, "_block").orderBy(*_order(at, list(ties), False))
    first = F.row_number().over(within) == 1
    return with_values(rows, last, [*keys, "_block"]).withColumn(name, F.when(first, F.col("_last.v")).otherwise(F.lag(value).over(within))).drop("_block", "_last")


def range_sum(df: DataFrame, keys: list[str], at: str, value: str, reach: int, width: int | None = None, name: str = "within") -> DataFrame:
    """Sum of value over a series' rows from `at` - reach to `at`, both ends among them. A block gets the rows of the one before that reach into it."""
    width = max(width or 0, reach, 1)
    rows = _block(df, at, width)
    reaches = F.col(at) >= (F.col("_block") + 1) * width - reach
    rows = rows.withColumn("_of", F.explode(F.when(reaches, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))))
    w = Window.partitionBy(*keys, "_of").orderBy(at).rangeBetween(-reach, 0)
    return rows.withColumn(name, F.sum(value).over(w)).where("_of = _block").drop("_of", "_block")


def runs(df: DataFrame, keys: list[str], at: str, bad: Column, width: int = 4096) -> DataFrame:
    """Longest stretches of consecutive whole numbers `at` whose rows are bad: keys, first and n. Each `at` has a row at most.

    A block gives its stretches; those that end at its border are put together with the ones that begin there.
    """
    rows = _block(df.where(bad).select(*keys, at), at, width)
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(at))
    parts = rows.withColumn("_island", island).groupBy(*keys, "_block", "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    # A block that is bad throughout goes on, so stretches are numbered by where one doesn't begin at the end of another; inner ones stand alone.
    edge = (F.col("first") == F.col("_block") * width) | (F.col("last") == (F.col("_block") + 1) * width - 1)
    w = Window.partitionBy(*keys).orderBy("first")
    edges = parts.where(edge).withColumn("_new", (F.coalesce(F.lag("last").over(w) + 1 != F.col("first"), F.lit(True))).cast("long"))
    edges = edges.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    found = edges.unionByName(parts.where(~edge).select(*keys, "first", "last"))
    return found.select(*keys, "first", (F.col("last") - F.col("first") + 1).alias("n"))
