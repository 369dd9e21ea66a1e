"""Checks: manifests, shard indexes, exactly-once accounting, digests, pipelines of plugins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1


def manifest_faults(manifests: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("capture_id", "shard_index")) -> DataFrame:
    """Versions that aren't known, counts below zero or unlike the data's; digests and source captures unlike the data's where both tables have them."""
    keys = list(keys)
    both = manifests.join(counts.withColumnsRenamed({"n": "_n", "sha256": "_sha256", "source_capture_id": "_source"}), keys, "left")
    source = ~F.col("source_capture_id").eqNullSafe(F.col("_source")) if "source_capture_id" in manifests.columns and "source_capture_id" in counts.columns else F.lit(False)
    digest = F.col("sha256") != F.col("_sha256") if "sha256" in manifests.columns and "sha256" in counts.columns else F.lit(False)
    v, n = F.col("format_version"), F.col("record_count")
    faults = F.filter(
        F.array(F.when(v > VERSION, "unsupported version"), F.when(v <= 0, "bad version"), F.when(n < 0, "negative count"), F.when(n != F.coalesce("_n", F.lit(0)), "record count differs"), F.when(digest, "sha256 differs"), F.when(source, "source capture differs")),
        lambda x: x.isNotNull(),
    )
    return both.select(*keys, F.explode(faults).alias("fault"))


def dense_faults(shards: DataFrame, key: str, n: int) -> DataFrame:
    """Groups whose shard indexes aren't 0 to n - 1, each once."""
    sums = shards.groupBy(key).agg(F.countDistinct(F.when(F.col("shard_index").between(0, n - 1), F.col("shard_index"))).alias("distinct"), F.count("*").alias("rows"))
    return sums.where((F.col("distinct") != n) | (F.col("rows") != n)).select(key, F.when(F.col("distinct") < n, "missing").otherwise("duplicate").alias("fault"), F.col("rows").alias("n"))


def exactly_once(captured: DataFrame, sent: DataFrame) -> DataFrame:
    """Ids that were sent more or less than once, or that nobody captured."""
    times = sent.groupBy("id").agg(F.count("*").alias("times"))
    both = captured.select("id", F.lit(1).alias("_c")).join(times, "id", "full")
    fault = F.when(F.col("_c").isNull(), "not captured").when(F.col("times").isNull(), "not sent").when(F.col("times") > 1, "sent again")
    return both.select("id", F.coalesce("times", F.lit(0)).alias("times"), fault.alias("fault")).where("fault is not null")


def digests(df: DataFrame, keys: list[str], line: str = "line_text") -> DataFrame:
    """Order-free digest and count of each group's lines; adds up in any number of tasks."""
    return df.groupBy(*keys).agg(F.expr(f"bit_xor(xxhash64({line}))").alias("check"), F.count("*").alias("n"))


def running_digest(df: DataFrame, key: str, line: str = "line_text") -> DataFrame:
    """SHA-256 and number of the lines of each key, where a key's rows follow each other within a task; nothing is held but the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, n = None, None, 0
        found = lambda: pa.RecordBatch.from_pydict({key: pa.array([at], kind), "sha256": [h.hexdigest()], "n": pa.array([n], pa.int64())})
        for batch in batches:
            kind = batch.schema.field(key).type
            for k, x in zip(batch.column(key).to_pylist(), batch.column(line).to_pylist(), strict=True):
                if h is None or k != at:
                    if h is not None:
                        yield found()
                    at, h, n = k, hashlib.sha256(), 0
                h.update((x or "").encode() + b"\n")
                n += 1
        if h is not None:
            yield found()

    return df.select(key, line).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, sha256 string, n long")


def ordered_digest(df: DataFrame, key: str, order: list[str], line: str = "line_text") -> DataFrame:
    """SHA-256 of a slice's lines in write order, as its manifest has it. A chain of lines is one task's, but Spark sorts and spills it and the task streams it."""
    return running_digest(df.repartition(key).sortWithinPartitions(key, *order), key, line)


def pipeline_faults(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """All faults of a table of pipelines (pipeline, position, plugin and maybe config, a map) against constraints of plugins.

    unknown plugins; what config_faults finds, where steps and rules have a config; conflicts, which hold both ways and are told once; plugins that stand after one they must
    go before, or before one they must follow; resources that one plugin wants for itself.
    """
    known = steps.join(rules, "plugin", "left")
    unknown = known.where("conflicts is null").select("pipeline", F.lit("unknown").alias("kind"), F.col("plugin").alias("detail"))
    one = known.where("conflicts is not null").select("pipeline", *[F.col(c).alias(f"a_{c}") for c in ("position", "plugin", "conflicts", "before", "after", "resources")])
    two = one.select("pipeline", *[F.col(f"a_{c}").alias(f"b_{c}") for c in ("position", "plugin", "conflicts", "before", "after", "resources")])
    pairs = one.join(two, "pipeline").where("a_position < b_position")
    couple = F.concat_ws(" ", F.least("a_plugin", "b_plugin"), F.greatest("a_plugin", "b_plugin"))
    clash = F.array_contains("a_conflicts", F.col("b_plugin")) | F.array_contains("b_conflicts", F.col("a_plugin"))
    conflict = pairs.where(clash).select("pipeline", F.lit("conflict").alias("kind"), couple.alias("detail"))
    wrong = F.array_contains("b_before", F.col("a_plugin")) | F.array_contains("a_after", F.col("b_plugin"))
    order = pairs.where(wrong).select("pipeline", F.lit("order").alias("kind"), F.concat_ws(" before ", "a_plugin", "b_plugin").alias("detail"))
    shared = F.filter("a_resources", lambda r: F.exists("b_resources", lambda s: (s["name"] == r["name"]) & ((s["access"] == "exclusive") | (r["access"] == "exclusive"))))
    resource = pairs.where(F.col("a_plugin") != F.col("b_plugin")).select("pipeline", couple.alias("c"), F.explode(shared).alias("r")).select("pipeline", F.lit("resource").alias("kind"), F.concat_ws(" ", "c", "r.name").alias("detail"))
    found = unknown.unionByName(conflict).unionByName(order).unionByName(resource)
    if "config" in steps.columns and "settings" in rules.columns:
        found = found.unionByName(config_faults(steps, rules))
    return found.distinct()


def config_faults(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """Faults of the steps' config by the settings that their plugins know (name, kind, required, allowed, least, most).

    A setting that is missing, that no rule knows, that isn't of its kind (text, number, whole number, flag or duration), that isn't among the
    allowed texts, or that is out of bounds. A plugin without rules of settings takes any.
    """
    from ..functions.exprs import duration_ns

    known = steps.join(rules.where("settings is not null").select("plugin", "settings"), "plugin").withColumn("config", F.coalesce("config", F.create_map().cast("map<string,string>")))
    each = known.select("pipeline", "plugin", "config", F.explode("settings").alias("s")).withColumn("value", F.try_element_at("config", F.col("s.name")))
    value, kind = F.col("value"), F.col("s.kind")
    number = F.when(kind == "duration", duration_ns("value") / 1e9).otherwise(value.try_cast("double"))
    whole = value.rlike(r"^\s*[-+]?\d+\s*$")
    bad_kind = F.when(kind == "number", number.isNull()).when(kind == "whole number", ~whole).when(kind == "flag", ~F.lower(value).isin("true", "false")).when(kind == "duration", number.isNull()).otherwise(F.lit(False))
    fault = F.when(value.isNull(), F.when(F.col("s.required"), "is missing")).when(bad_kind, F.concat(F.lit("is no "), kind)).when(~F.array_contains("s.allowed", value), "is not allowed").when((number < F.col("s.least")) | (number > F.col("s.most")), "is out of bounds")
    wrong = each.select("pipeline", "plugin", F.col("s.name").alias("name"), fault.alias("fault")).where("fault is not null")
    names = F.transform("settings", lambda x: x["name"])
    extra = known.select("pipeline", "plugin", F.explode(F.array_except(F.map_keys("config"), names)).alias("name"), F.lit("is not known").alias("fault"))
    return wrong.unionByName(extra).select("pipeline", F.lit("config").alias("kind"), F.concat_ws(" ", "plugin", "name", "fault").alias("detail"))
