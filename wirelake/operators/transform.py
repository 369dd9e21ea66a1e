"""Row transforms: bodies, headers, outbound requests, and chains of user transforms."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def truncate_body(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Bodies longer than `most` bytes are cut; contentLength follows and metadata.bodyTruncated says so."""
    cut = F.octet_length("body") > most
    meta = F.map_concat(F.map_filter("metadata", lambda k, _: k != "bodyTruncated"), F.create_map(F.lit("bodyTruncated"), F.lit("true")))
    return df.select(
        *[c for c in df.columns if c not in ("body", "contentLength", "metadata")],
        F.when(cut, F.substring("body", 1, most)).otherwise(F.col("body")).alias("body"),
        F.when(cut, F.lit(most).cast("long")).otherwise(F.octet_length("body").cast("long")).alias("contentLength"),
        F.when(cut, meta).otherwise(F.col("metadata")).alias("metadata"),
    )


def redact_headers(df: DataFrame, setting: str = "") -> DataFrame:
    return df.withColumn("headers", X.redact("headers", X.redaction_list(setting)))


def from_http(raw: DataFrame) -> DataFrame:
    """Mirrored HTTP requests (url, host, remote_addr, ...) as captured ones: the path alone, the rest as metadata."""
    meta = F.create_map(F.lit("host"), "host", F.lit("remoteAddr"), "remote_addr", F.lit("query"), F.coalesce(F.expr("try_parse_url(url, 'QUERY')"), F.lit("")))
    return raw.select("id", "method", F.expr("coalesce(try_parse_url(url, 'PATH'), '')").alias("path"), F.lit("HTTP").alias("protocol"), meta.alias("metadata"))


def from_grpc(raw: DataFrame) -> DataFrame:
    return raw.select("id", F.lit("POST").alias("method"), F.col("full_method").alias("path"), F.lit("gRPC").alias("protocol"), F.create_map(F.lit("grpcMethod"), "full_method").alias("metadata"))


def stamped(df: DataFrame, deterministic: bool = False) -> DataFrame:
    """Ids and times for rows that have none; a hash of the row instead of a random id if it must be the same again."""
    new = F.sha2(F.to_json(F.struct(*df.columns)), 256) if deterministic else F.uuid()
    return df.withColumn("id", new).withColumn("timestamp", F.timestamp_micros(F.lit(0).cast("long")) if deterministic else F.current_timestamp())


def outbound(df: DataFrame, base: str, override: dict[str, str] | None = None) -> DataFrame:
    """The table of requests as they are to be sent."""
    return df.select("id", "method", X.join_url(F.lit(base), "path").alias("url"), X.outbound_headers("headers", "id", override).alias("headers"), F.when(F.octet_length("body") > 0, F.col("body")).alias("body"))


def script_outbound(df: DataFrame, base: str) -> DataFrame:
    """As load scripts send them: first value of each header, no body with GET or HEAD, GET by default."""
    method = F.upper(F.coalesce(F.nullif("method", F.lit("")), F.lit("GET")))
    kept = F.map_filter("headers", lambda k, _: ~F.lower(k).isin("host", "transfer-encoding", "connection"))
    body = F.when(method.isin("GET", "HEAD"), F.lit(None)).otherwise(F.col("body"))
    return df.select("id", method.alias("method"), X.join_url(F.lit(base), "path").alias("url"), F.transform_values(kept, lambda _, v: F.try_element_at(v, F.lit(1))).alias("headers"), body.alias("body"))


def joined_outbound(df: DataFrame, base: str) -> DataFrame:
    """As the script adapter sends them: all values of a header in one, joined by a comma, but for Host; GET and the root where nothing is said."""
    kept = F.map_filter("headers", lambda k, _: F.lower(k) != "host")
    marks = F.create_map(F.lit("X-Replay"), F.lit("true"), F.lit("X-Request-Id"), F.coalesce("id", F.lit("")))
    headers = F.map_concat(F.map_filter(F.transform_values(kept, lambda _, v: F.array_join(v, ", ")), lambda k, _: ~k.isin("X-Replay", "X-Request-Id")), marks)
    path = F.coalesce(F.nullif("path", F.lit("")), F.lit("/"))
    return df.select("id", F.coalesce(F.nullif("method", F.lit("")), F.lit("GET")).alias("method"), F.concat(F.lit(base), path).alias("url"), headers.alias("headers"), F.when(F.octet_length("body") > 0, F.col("body")).alias("body"))


#: Transforms by name, for jobs that are put together from configuration.
REGISTRY: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {}


def register(name: str):
    def put(factory):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        REGISTRY[name] = factory
        return factory

    return put


def build(name: str, **config) -> Callable[[DataFrame], DataFrame]:
    if name not in REGISTRY:
        raise KeyError(f"no transform {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**config)


@register("truncate")
def _truncate(most: int = 1 << 20):
    return lambda df: truncate_body(df, most)


@register("redact")
def _redact(names: str = ""):
    return lambda df: redact_headers(df, names)


@register("rewrite-headers")
def _rewrite(put: dict | None = None, add: dict | None = None, remove: list | None = None):
    return lambda df: df.withColumn("headers", X.rewrite_headers("headers", put or {}, add or {}, remove or []))


def chain(df: DataFrame, specs: list[tuple[str, dict]]) -> DataFrame:
    """Column transforms in order; Spark sees one projection."""
    for name, config in specs:
        df = build(name, **config)(df)
    return df


def row_chain(df: DataFrame, steps: list[Callable[[dict], dict | None]], on_error: str = "drop") -> DataFrame:
    """Arbitrary Python row transforms, batch by batch. A step gives a row or None (filtered).

    An error drops the row, or with 'skip' passes the step's input on, or with 'abort' fails the job. The
    column `filtered` says which rows were dropped; callers keep those where it is false.
    """
    if on_error not in ("drop", "skip", "abort"):
        raise ValueError(on_error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, schema = [], batch.schema.append(pa.field("filtered", pa.bool_()))
            maps = [f.name for f in batch.schema if pa.types.is_map(f.type)]
            for row in batch.to_pylist(maps_as_pydicts="strict"):
                now = row
                for step in steps:
                    try:
                        now = step(copy.deepcopy(now))  # a step that fails halfway leaves no trace
                    except Exception:
                        if on_error == "abort":
                            raise
                        now = now if on_error == "skip" else None
                    if now is None:
                        break
                out.append({**(row if now is None else now), "filtered": now is None})
            for row in out if maps else ():
                row.update({m: list(row[m].items()) for m in maps if row.get(m) is not None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", filtered boolean")
