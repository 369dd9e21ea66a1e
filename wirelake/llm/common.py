"""Helpers shared by the corpus operators: word arrays, slices of batches, the shared folder.

Conventions of every operator here: a null text is an empty text; each row is a document of its
own, so repeated rows are treated alike and all of them are returned; extra columns of the input
are ignored, whatever their names; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: glibc's malloc_trim, where there is one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4 << 20
#: Rows of numbers that are sent to all executors.
SENT_ROWS = 500_000
#: Rows of numbers (ids, hashes, links) of a partition, and the most partitions of such a table.
ROWS_A_PART, MOST_PARTS = 50_000, 20_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Within it, jobs hand at most that many rows at a time to Python workers; for wide rows, of which the usual number needs much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts_of(rows: int, each: int = ROWS_A_PART) -> int:
    """To how many partitions a table of so many rows is coalesced, so that small tables make no files by the hundred in each shuffle."""
    return max(1, min(MOST_PARTS, -(-rows // each)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is named and Spark runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = kept or tempfile.mkdtemp(prefix="wirelake-")
        if not kept:
            spark.sparkContext.setCheckpointDir(at)
            at = spark.sparkContext.getCheckpointDir()
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sent(df: DataFrame) -> DataFrame:
    """A kept table for a join: sent to all executors if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def fresh_name(taken: list[str], name: str) -> str:
    """A column name that isn't taken, whatever its case."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def crc_mod(column: Column | str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column) % n


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, about `budget` bytes of text at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(size):
        return
    part = (np.cumsum(size, dtype=np.int64) - size) // budget
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()
        if TRIM:
            TRIM(0)  # what the slice needed goes back to the machine, which other workers share


def texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def word_runs(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all rows in one array, and how many each row has."""
    trimmed = pc.ascii_trim_whitespace(text)
    lists = pc.ascii_split_whitespace(trimmed)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat, empty = lists.flatten(), pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        counts[empty] = 0
        flat = flat.filter(pc.not_equal(flat, ""))
    return flat, counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts, dtype=np.int64) - counts


def plain(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array, from 0 on."""
    flat = pa.concat_arrays([flat]) if flat.offset else flat
    _, off, data = flat.buffers()
    offsets = np.frombuffer(off, dtype=np.int32, count=len(flat) + 1 + flat.offset)[flat.offset :] if off else np.zeros(1, np.int32)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)


def joined(flat: pa.Array, counts: np.ndarray, by: str = " ") -> pa.Array:
    """The words of each row joined again."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, flat), by)


def n_words(text: Column | str) -> Column:
    """Number of words of a text, on the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")
