"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark.

Documents are dealt into chunks by ranges of doc_id. In a chunk each distinct window hash is kept
once and sent, packed, to the bucket that owns it; a bucket finds the lowest chunk of each hash and
answers with one bit for each hash it was sent. A window is repeated if its hash occurs in a lower
chunk, or in its own chunk in a document with a smaller doc_id. Since a chunk sends a hash once, a
passage that a third of all documents share costs one hash a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, starts_of, texts, word_runs

WINDOW = 13
#: Text of a chunk and window hashes of a bucket, by what a small Python worker can hold. Rows that
#: are exchanged number chunks x buckets, so larger executors should get larger values.
CHUNK_BYTES, BUCKET_HASHES = 8 << 20, 1_500_000
#: Base of the polynomial, modulo 2**64; odd, so that no power of it vanishes.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def window_hashes(flat: pa.Array, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words and the index of each one's first word."""
    coded = flat.dictionary_encode()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = of_word[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    starts = np.arange(len(h))
    starts = starts[starts + width <= np.repeat(starts_of(counts) + counts, counts)]
    # H(i, 2k) = H(i, k) * BASE**k + H(i + k, k); width is put together from powers of two.
    total, done, part, k = None, 0, h, 1
    with np.errstate(over="ignore"):
        while k <= width:
            if width & k:
                here = part[starts + done]
                total = here if total is None else total * np.power(BASE, np.uint64(k)) + here
                done += k
            part = part[:-k] * np.power(BASE, np.uint64(k)) + part[k:] if len(part) > k else part[:0]
            k *= 2
            if k <= width and not len(part):
                break
        total = np.zeros(0, np.uint64) if total is None or not len(starts) else total
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    return total, starts


class Chunk:
    """The words, distinct window hashes and local repeats of one chunk."""

    def __init__(self, rows: pa.Table, width: int, named: bool):
        ids = rows.column("doc_id").combine_chunks()
        self.ids = ids
        self.flat, self.counts = word_runs(texts(pa.concat_arrays(rows.column("text").chunks) if rows.num_rows else pa.array([], pa.string())))
        h, self.starts = window_hashes(self.flat, self.counts, width)
        row = np.repeat(np.arange(len(self.counts)), self.counts)[self.starts]
        self.order = np.argsort(h)
        h = h[self.order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        self.hashes, self.group = h[first], np.cumsum(new) - 1
        doc = (pc.fill_null(ids, 0).to_numpy() if named else np.zeros(len(ids), np.int64))[row][self.order]
        self.again = doc > np.minimum.reduceat(doc, first)[self.group] if len(h) else new

    def buckets(self, bits: int) -> np.ndarray:
        """Ends of the buckets, the hashes' leading bits, in the sorted hashes."""
        return np.searchsorted(self.hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)


def pack(h: np.ndarray) -> tuple[int, bytes]:
    """Sorted hashes as the first one and six bytes for each step, or whole if a step is longer."""
    step = np.diff(h)
    if len(step) and int(step.max()) >> 48 == 0:
        return len(h), h[:1].tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return -len(h), h.tobytes()


def unpack(n: int, raw: bytes) -> np.ndarray:
    if n < 0:
        return np.frombuffer(raw, np.uint64)
    step = np.zeros((n, 8), np.uint8)
    step[0] = np.frombuffer(raw, np.uint8, 8)
    step[1:, :6] = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, 6)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def repeated_windows(docs: DataFrame, width: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (maximal intervals [start, stop) of words) of every row.

    A word goes if a window of `width` words covers it that also starts in a document with a
    smaller doc_id. A text of fewer words has no window. Rows that share a doc_id are one document
    to each other: neither makes the other's windows repeats. A row without a doc_id comes after
    all others, and rows without one aren't compared with each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, least, nulls, rows = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    n = int((size or 0) // chunk_bytes) + 1
    bits = int(np.ceil(np.log2(max(1, (size or 0) / 6 / bucket_hashes))))
    bounds = np.array(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 and least is not None else [], np.float64)
    bounds, spare = np.unique(bounds.astype(np.int64)), n * (nulls or 0) // max(1, rows or 0) + 1
    last = len(bounds) + 1

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), last + salt, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="left"))).astype("int32")

    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(spare)).cast("int")).otherwise(0)
    parts = max(n, 1)
    chunked = docs.withColumn("chunk", chunk_of("doc_id", salt)).repartition(parts, "chunk")

    def send(rows: pa.Table) -> pa.Table:
        at = rows.column("chunk")[0].as_py()
        c = Chunk(rows.select(["doc_id", "text"]), width, at < last)
        out = [(b, at, *pack(h)) for b, h in enumerate(np.split(c.hashes, c.buckets(bits))) if len(h)]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "n": pa.array(cols[2], pa.int32()), "hashes": pa.array(cols[3], pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        got = [unpack(n, raw) for n, raw in zip(rows.column("n").to_pylist(), rows.column("hashes").to_pylist(), strict=True)]
        lens = np.array([len(x) for x in got])
        h = np.concatenate(got)
        at = np.repeat(np.minimum(rows.column("chunk").to_numpy(), last), lens)
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        lower = np.empty(len(h), bool)
        lower[order] = at[order] > np.minimum.reduceat(at[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        bits_ = [np.packbits(x).tobytes() for x in np.split(lower, np.cumsum(lens)[:-1])]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "seen": pa.array(bits_, pa.binary())})

    def cut(rows: pa.Table, seen: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({k: pa.array([], t) for k, t in types.items()})
        c = Chunk(rows.select(["doc_id", "text"]), width, rows.column("chunk")[0].as_py() < last)
        lower = np.zeros(len(c.hashes), bool)
        ends = [0, *c.buckets(bits).tolist(), len(c.hashes)]
        for b, raw in zip(seen.column("bucket").to_pylist(), seen.column("seen").to_pylist(), strict=True):
            lower[ends[b] : ends[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=ends[b + 1] - ends[b])
        hit = c.starts[c.order[c.again | lower[c.group]]] if len(c.hashes) else c.starts
        edge = np.zeros(len(c.flat) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        gone = np.cumsum(edge)[:-1] > 0
        row = np.repeat(np.arange(len(c.counts)), c.counts)
        removed = np.bincount(row[gone], minlength=len(c.counts))
        kept = joined(c.flat.filter(pa.array(~gone)), c.counts - removed)
        digests = [hashlib.sha256(x).hexdigest() for x in kept.cast(pa.binary()).to_pylist()]
        # An interval starts where a word is gone and the word before it isn't, or is another row's.
        begin = starts_of(c.counts)[c.counts > 0]
        left, right = gone.copy(), gone.copy()
        left[1:] &= ~gone[:-1]
        left[begin] = gone[begin]
        stop = (begin + c.counts[c.counts > 0]) - 1
        right[:-1] &= ~gone[1:]
        right[stop] = gone[stop]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        first = starts_of(c.counts)[row[a]]
        spans = pa.StructArray.from_arrays([pa.array(a - first), pa.array(b + 1 - first)], ["start", "stop"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[a], minlength=len(c.counts)))]).astype(np.int32)
        return pa.table({"doc_id": c.ids, "n_words": pa.array(c.counts), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string()), "removed": pa.ListArray.from_arrays(pa.array(offsets), spans)})

    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "removed": pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))}
    sent = chunked.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, n int, hashes binary")
    seen = sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, seen binary").repartition(parts, "chunk")
    return chunked.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,stop:long>>")


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; nulls, ties, repeated rows and empty tables as in repeated_windows."""
    return repeated_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The query's result for DuckDB; doc_ids are taken to be distinct.
OP6_SQL = rf"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') words from documents),
win as (select doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') s from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) i from w)),
least_ as (select s, min(doc_id) d from win group by s),
gone as (select distinct doc_id, i + k pos from win join least_ using (s), range({WINDOW}) r(k) where doc_id > d),
p as (select doc_id, unnest(words) word, unnest(range(1, len(words) + 1)) pos from w),
kept as (select doc_id, string_agg(word, ' ' order by pos) t, count(*) n from p anti join gone using (doc_id, pos) group by 1)
select doc_id, len(words)::bigint n_words, len(words)::bigint - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id)
"""
