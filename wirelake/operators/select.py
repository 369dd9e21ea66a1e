"""Selecting requests: predicates, ordered limits, sampling, shards, set checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def path_prefix(prefix: str) -> Column:
    return F.col("path").startswith(prefix) if prefix else F.lit(True)


def in_time(start: dt.datetime | None, end: dt.datetime | None, column: str = "timestamp") -> Column:
    """Both ends belong to the range; a missing one is open."""
    out = F.lit(True)
    if start:
        out = out & (F.col(column) >= F.lit(start))
    if end:
        out = out & (F.col(column) <= F.lit(end))
    return out


def by_day(start: dt.datetime | None, end: dt.datetime | None, column: Column | str = "capture_date") -> Column:
    """Whole days that may hold rows of the range; rows without a day stay. Prunes partitions."""
    c, out = F.col(column) if isinstance(column, str) else column, F.lit(True)
    if start:
        out = out & (c.isNull() | (c >= F.lit(start.date())))
    if end:
        out = out & (c.isNull() | (c <= F.lit(end.date())))
    return out


def methods(names: list[str]) -> Column:
    return F.upper("method").isin([n.strip().upper() for n in names]) if names else F.lit(True)


def sampled(percent: float, key: str = "id", seed: int = 0) -> Column:
    """A share of rows chosen by a hash of their key, the same in every run; percent is held to 0..100."""
    p = min(max(percent, 0.0), 100.0)
    if p in (0.0, 100.0):
        return F.lit(p == 100.0)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long")
    return h < int(p / 100 * (1 << 32))


def capture_filter(prefix: str = "", headers: list[tuple[str, str]] = (), percent: float = 100.0) -> Column:
    """The cheap predicates first: path, headers, sample."""
    return path_prefix(prefix) & X.headers_match("headers", list(headers)) & sampled(percent)


def shard_owns(index: int, count: int) -> Column:
    """Rows of one shard by FNV-1a of the id; one shard or none owns all."""
    if count > 1 and not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    return X.fnv1a64_mod("id", count) == index if count > 1 else F.lit(True)


def with_shard(df: DataFrame, count: int) -> DataFrame:
    return df.withColumn("shard", X.fnv1a64_mod("id", count) if count > 1 else F.lit(0))


def first_in_order(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in object and line order, all if n is 0; a top-k, not a global sort."""
    return df.orderBy(*(order or ("object_key", "line"))).limit(n) if n else df


def still_active(now: Column, start: str = "started_at", duration: str = "duration") -> Column:
    """A capture without start or duration never expires; else it does when its time is over."""
    ns = X.duration_ns(duration)
    return F.coalesce((X.micros(now) * 1000 < X.micros(start) * 1000 + ns), F.lit(True))


def not_disjoint(sharded: DataFrame) -> DataFrame:
    """Ids in more than one shard; empty for a correct split."""
    return sharded.groupBy("id").agg(F.countDistinct("shard").alias("n_shards")).where("n_shards > 1")


def not_covered(captured: DataFrame, sharded: DataFrame) -> DataFrame:
    """Captured ids in no shard; empty for a correct split."""
    return captured.select("id").join(sharded.select("id"), "id", "left_anti")


def shard_counts(sharded: DataFrame, count: int) -> DataFrame:
    """Rows of every shard, zero where there are none."""
    every = sharded.sparkSession.range(count).select(F.col("id").cast("int").alias("shard"))
    return every.join(sharded.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))
