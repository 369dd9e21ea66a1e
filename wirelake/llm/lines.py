"""Line dedup with two Bloom filters: one of lines seen once, one of lines seen twice.

Both are cut into segments by the lines' hashes, as many as the lines need, each kept by one task. Lines that the
twice-seen filter doesn't have are unique. Only the others, the suspected repeats, are counted exactly in a
shuffle, which also finds a line's first occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, joined, sent, slices, texts

MOST = 10
#: Bits of a filter for each line (rounded up to a power of two in all), bits set for each line, lines of a segment, whose
#: filters and hashes one task holds, text whose distinct lines are sent together.
PER_LINE, HASHES, SEGMENT_LINES, SENT_TEXT = 8, 2, 1 << 21, 8 << 20
#: Bytes of repeated lines that are sent to all executors; beyond, their places are joined to the documents.
SENT_BYTES = 16 << 20


def keys_of(text: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Lines and their keys, of all rows in a row, and each row's number of lines."""
    lists = pc.split_pattern(text, "\n")
    lines = lists.flatten()
    return lines, pc.ascii_lower(pc.ascii_trim_whitespace(lines)), np.diff(lists.offsets.to_numpy()).astype(np.int64)


def counted(keys: pa.Array, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct keys, without the empty one, and the number of rows that have each."""
    coded = keys.dictionary_encode()
    row = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(coded.indices.to_numpy().astype(np.int64) * (len(counts) + 1) + row)
    n = np.bincount(pairs // (len(counts) + 1), minlength=len(coded.dictionary))
    names = coded.dictionary.to_pylist()
    if "" in names:
        n[names.index("")] = 0
    keep = np.flatnonzero(n)
    return [names[i] for i in keep.tolist()], n[keep]


def hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES places of each hash in a filter of 2**bits bits."""
    with np.errstate(over="ignore"):
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(HASHES)], axis=1).astype(np.int64)


def suspected(docs: DataFrame, segments: int, bits: int) -> DataFrame:
    """Hashes of lines that the twice-seen filter of their segment has: all that repeat, and a few that don't.

    Tasks send each distinct hash once a slice, eight bytes, twice where the slice repeats it; a hash's leading part names
    its segment, whose two filters one task keeps. Nothing passes through the driver.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=SENT_TEXT):
                _, keys, counts = keys_of(texts(part.column("text")))
                names, n = counted(keys, counts)
                h = hashes(names)
                h = np.concatenate([h, h[n > 1]])
                to = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                each, first = np.unique(to[order], return_index=True)
                packed = [x.tobytes() for x in np.split(h[order], first[1:])] if len(h) else []
                yield pa.RecordBatch.from_pydict({"segment": pa.array(each, pa.int32()), "hashes": pa.array(packed, pa.binary())})

    def merge(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        all_: list[np.ndarray] = []
        for batch in rows:
            for raw in batch.column("hashes").to_pylist():
                h = np.frombuffer(raw, np.uint64)
                new, times = np.unique(h, return_counts=True)
                at = places(new, bits)
                again = once[at].all(axis=1) | (times > 1)
                twice[at[again]] = True
                once[at] = True
                all_.append(new)
        h = np.unique(np.concatenate(all_))
        found = h[twice[places(h, bits)].all(axis=1)]
        yield pa.RecordBatch.from_pydict({"hash": found.view(np.int64)})

    return docs.select("text").mapInArrow(collect, "segment int, hashes binary").groupBy("segment").applyInArrow(merge, "hash long")


def repeated_lines(docs: DataFrame, most: int = MOST, segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """key, n (rows that have it) and first (the smallest doc_id with it, no doc_id counting last) of lines in `most` rows or more."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, keys, counts = keys_of(texts(part.column("text")))
                names, n = counted(keys, counts)
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                least = pa.table({"key": keys, "doc_id": part.column("doc_id").take(row)}).group_by("key").aggregate([("doc_id", "min")])
                first = least.column("doc_id_min").take(pc.index_in(pa.array(names, pa.string()), least.column("key").combine_chunks())).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hashes(names).view(np.int64)), pa.array(n.astype(np.int64)), first.cast(pa.int64())], ["key", "hash", "n", "first"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lines, "key string, hash long, n long, first long")
    if most > 1:
        n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
        segments = n // segment_lines + 1
        bits = max(10, math.ceil(math.log2(min(n, segment_lines) * PER_LINE)))
        found = found.join(sent(checkpoint(suspected(docs, segments, bits))), "hash", "left_semi")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= most)


def drop_lines(docs: DataFrame, most: int = MOST, keep_first: bool = False, segment_lines: int = SEGMENT_LINES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (what is left, joined by line feeds) of every row.

    A line whose key (stripped of ASCII white space, A-Z lowered, not empty) is in `most` rows or more goes
    everywhere or, with keep_first, everywhere but in the rows with its smallest doc_id, once in each. A null text is
    one empty line. Each row is a document of its own.
    """
    repeated = checkpoint(repeated_lines(docs, most, segment_lines))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = repeated.agg(F.sum(F.octet_length("key") + 80)).first()[0] or 0
    schema = "doc_id long, n_lines long, n_dropped long, text string"
    if size <= sent_bytes:
        known = docs.sparkSession.sparkContext.broadcast({r["key"]: r["first"] for r in repeated.collect()})
        return rows.mapInArrow(lambda batches: _dropping(batches, known.value, keep_first), schema)

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, keys, counts = keys_of(texts(part.column("text")))
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                pairs = pa.table({"key": keys, "row": part.column("row").take(row)}).group_by(["key", "row"]).aggregate([]).filter(pc.field("key") != "")
                yield from pairs.combine_chunks().to_batches()

    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    found = rows.select("text", "row").mapInArrow(places_of, "key string, row long").distinct().join(repeated, "key")
    lists = found.groupBy("row").agg(F.collect_list(F.struct("key", "first")).alias("known"))
    return rows.join(lists, "row", "left").mapInArrow(lambda batches: _dropping(batches, None, keep_first), schema)


def _dropping(batches: Iterator[pa.RecordBatch], known: dict | None, keep_first: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            lines, keys, counts = keys_of(texts(part.column("text")))
            names, row = keys.to_pylist(), np.repeat(np.arange(len(counts)), counts).tolist()
            if known is None:
                of_row = [{x["key"]: x["first"] for x in r or []} for r in part.column("known").to_pylist()]
                gone = np.array([k in of_row[r] for k, r in zip(names, row, strict=True)], bool)
                first = [of_row[r].get(k) for k, r in zip(names, row, strict=True)] if keep_first else []
            else:
                gone = np.array([k in known for k in names], bool)
                first = [known.get(k) for k in names] if keep_first else []
            if keep_first:
                ids, kept = part.column("doc_id").to_pylist(), set()
                for i in np.flatnonzero(gone).tolist():
                    if ids[row[i]] == first[i] and (names[i], row[i]) not in kept:
                        kept.add((names[i], row[i]))
                        gone[i] = False
            dropped = np.bincount(np.array(row, np.int64)[gone], minlength=len(counts)).astype(np.int64)
            text = joined(lines.filter(pa.array(~gone)), counts - dropped, "\n")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(dropped), text], ["doc_id", "n_lines", "n_dropped", "text"])


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row; nulls, empty texts, ties and repeated rows as in drop_lines."""
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The query's result for DuckDB; doc_ids are taken to be distinct.
OP9_SQL = rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
often as (select key from k where key <> '' group by key having count(distinct doc_id) >= {MOST})
select doc_id, count(*) n_lines, count(often.key) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where often.key is null), '')) kept_sha256
from k left join often on k.key = often.key group by doc_id
"""
