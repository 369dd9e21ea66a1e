"""When each request is to be sent: gaps, offsets and rates, in read order within a shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import blocked

#: Read order: the first column is an object's key, the others order an object's rows. Objects are the blocks in which a shard is scheduled, so
#: that a shard, or a capture that isn't sharded, is as many tasks' work as it has objects.
ORDER = ("object_key", "line")


def gaps(df: DataFrame, keys: list[str] = ("shard",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Nanoseconds since the row before, in read order; the first row's gap is 0. Negative gaps are kept."""
    rows = df.withColumn("_ns", X.micros("timestamp") * 1000)
    rows = blocked.previous(rows, list(keys), order[1], "_ns", ties=order[2:], name="_before", block=F.col(order[0]))
    return rows.withColumn("gap_ns", F.coalesce(F.col("_ns") - F.col("_before"), F.lit(0))).drop("_ns", "_before")


def original_timing(df: DataFrame, scale: float = 1.0, keys: list[str] = ("shard",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Send offsets as recorded. Negative gaps wait for nothing; 0.5 sends twice as fast, 0 or less is 1."""
    scale = scale if scale > 0 else 1.0
    rows = gaps(df, keys, order).withColumn("_wait", F.floor(F.greatest("gap_ns", F.lit(0)) * scale).cast("long"))
    return blocked.running_sum(rows, list(keys), order[1], "_wait", ties=order[2:], name="send_offset_ns", block=F.col(order[0])).drop("_wait")


def _place(df: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """_place of each row in its shard, from 1 on."""
    return blocked.running_sum(df.withColumn("_one", F.lit(1).cast("long")), list(keys), order[1], "_one", ties=order[2:], name="_place", block=F.col(order[0])).drop("_one")


def constant_rate(df: DataFrame, per_second: float, keys: list[str] = ("shard",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """A row each tick; the first one waits for one, too."""
    return _place(df, keys, order).withColumn("send_offset_ns", F.floor(F.col("_place") * (1e9 / per_second)).cast("long")).drop("_place")


def unlimited(df: DataFrame) -> DataFrame:
    return df.withColumn("send_offset_ns", F.lit(0).cast("long"))


def source_offsets(df: DataFrame, keys: list[str] = ("shard",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Nanoseconds since the first time that was seen in the shard, in read order. That time is an aggregate, so no shard is ordered as a whole."""
    us = X.micros("timestamp")
    first = df.where(us.isNotNull()).groupBy(*keys).agg(F.min_by(us, F.struct(*order)).alias("_first"))
    return blocked.with_values(df, first, list(keys)).withColumn("source_offset_ns", (us - F.col("_first")) * 1000).drop("_first")


def batches(df: DataFrame, size: int | None = None, keys: list[str] = ("shard",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Batch numbers for a feed; a size is 100 if it is missing, 1 at least and 1000 at most."""
    n = 100 if size is None else min(max(size, 1), 1000)
    return _place(df, keys, order).withColumn("batch", F.floor((F.col("_place") - 1) / n).cast("long")).drop("_place")


def global_offsets(df: DataFrame, column: str, width: int) -> DataFrame:
    """Running number of rows by column over the whole table without one task for all: counts of
    buckets of `width` are summed up first, and rows are ordered within their bucket alone."""
    b = F.floor(F.col(column) / width)
    counts = df.groupBy(b.alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    keyed = df.withColumn("_b", b).join(before, "_b")
    return keyed.withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(column, "id"))).drop("_b", "_before")


def fidelity(sent: DataFrame, tolerance_ns: int, keys: list[str] = ("shard",), block_ns: int = 600_000_000_000) -> DataFrame:
    """Actual against planned gaps of consecutive sends: rows beyond the tolerance, the largest difference, the drift. Sends are paired in blocks of planned time."""
    rows = blocked.previous(sent.withColumn("_late", F.col("actual_ns") - F.col("planned_ns")), list(keys), "planned_ns", "_late", block_ns, ["id"], "_before")
    diffs = rows.withColumn("diff", F.abs(F.col("_late") - F.col("_before"))).withColumn("late", F.col("actual_ns") - F.col("planned_ns"))
    return diffs.groupBy(*keys).agg(F.count("diff").alias("gaps"), F.count_if(F.col("diff") > tolerance_ns).alias("beyond"), F.max("diff").alias("largest_ns"), (F.max("late") - F.min("late")).alias("drift_ns"))


def resume_after(df: DataFrame, key: str) -> DataFrame:
    """Rows of objects after the last one that was completed, whether or not that is still there."""
    return df.where(F.col("object_key") > key) if key else df


def due_time(start: Column, offset_ns: Column | str, speed: float) -> Column:
    """Microseconds at which a request is due at a speed (2 is twice as fast; the opposite of original_timing's scale)."""
    return F.unix_micros(start) + F.floor(X.col(offset_ns) / (1000 * speed)).cast("long")
