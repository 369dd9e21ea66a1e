"""A table of one row a key that streams keep up: only the buckets of changed keys are written anew.

A bucket is a folder of Parquet, and a small pointer file says which folder is each bucket's newest. A new pointer is put
beside the older ones last, by a move, so that a reader has the state of one batch or of the next, an older state can
be read as long as it is kept, and a batch that comes again finds its number there and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import fleet as L
from ..sources.objects import Store

POINTERS = "_pointers"
#: Names of the table's own columns.
BUCKET = "_bucket"


class KeyedTable:
    """Rows by key below a folder of the shared file system. merged(old and new rows) gives the rows that stay; without one the newest by `order` does."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, keys: list[str], order: list[str] = (), buckets: int = 64, merged: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.keys, self.order, self.buckets, self.merged = spark, root.rstrip("/"), keys, list(order), buckets, merged
        self.schema = spark.createDataFrame([], schema).schema
        self.store = Store(self.root)

    def pointer(self, version: int | None = None) -> dict:
        """The newest state, or that of a version (from 1 on): its last batch and the folder of each bucket."""
        known = self.store.files(POINTERS)
        name = f"{version:08d}.json" if version else max(known, default="")
        found = self.store.read(f"{POINTERS}/{name}") if name in known else None
        return json.loads(found) if found else {"batch": -1, "version": 0, "buckets": {}}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest state, or of a version that is kept."""
        return self._rows(list(self.pointer(version)["buckets"].values()))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{x}" for x in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def merge(self, new: DataFrame, batch: int) -> int:
        """Puts a batch's rows in; returns how many buckets were written, none if the batch was there already. A batch has a row or more for each changed key."""
        at = self.pointer()
        if batch <= at["batch"]:
            return 0
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)
        # The batch is kept while it is merged: it may not be computed twice, and its folders tell which buckets it touches.
        kept = f"_incoming-{uuid.uuid4().hex}"
        new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).select("*", bucket).write.partitionBy(BUCKET).parquet(f"{self.root}/{kept}")
        touched = sorted(x.split("=")[1] for x in self.store.folders(kept) if x.startswith(BUCKET))
        if touched:
            new = self._rows([f"{kept}/{BUCKET}={b}" for b in touched])
            old = self._rows([at["buckets"][b] for b in touched if b in at["buckets"]])
            rows = self.merged(old, new) if self.merged else L.latest(old.unionByName(new), self.keys, *self.order)
            version = f"v{at['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"  # a batch that failed may have left one behind
            rows.select(*self.schema.names, bucket).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{version}")
            at["buckets"] |= {b: f"{version}/{BUCKET}={b}" for b in touched}
        self._swap({"batch": batch, "version": at["version"] + 1, "buckets": at["buckets"]})
        self.store.remove(kept)
        return len(touched)

    def _swap(self, pointer: dict) -> None:
        name = f"_next-{uuid.uuid4().hex}"
        self.store.write(name, json.dumps(pointer).encode())
        self.store.move(name, f"{POINTERS}/{pointer['version']:08d}.json")

    def clean(self, keep: int = 1) -> None:
        """Removes states but the newest `keep`, and folders that none of them needs; no reader of an older state may be left."""
        known = sorted(self.store.files(POINTERS))
        for name in known[:-keep]:
            self.store.forget(f"{POINTERS}/{name}")
        held = {x.split("/")[0] for name in known[-keep:] for x in json.loads(self.store.read(f"{POINTERS}/{name}"))["buckets"].values()}
        for version in self.store.folders(""):
            if version.startswith("v") and version not in held:
                self.store.remove(version)


def kept_up(changes: DataFrame, table: KeyedTable, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """Starts a stream whose changed rows (in update mode) are merged into a table; then(table's rows, batch) follows each merge."""

    def put(df: DataFrame, batch: int) -> None:
        table.merge(df, batch)
        if then:
            then(table.read(), batch)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
