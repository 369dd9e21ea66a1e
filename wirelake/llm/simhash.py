"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint is split into three segments. Two fingerprints that differ in at most two bits agree
in at least one segment; in the segment after it they differ in two bits at most, so that both lie
within four bits of a common codeword of the perfect (23, 12) Golay code. Each fingerprint therefore
gets, for each segment, the keys (segment's bits, index of a codeword near the next segment), one
or six of them. Equal keys are joined and the distance is verified. The work is done on distinct
fingerprints, so that a group of exact copies of any size is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import checkpoint, joined, plain, sent, shared_dir, slices, starts_of, texts, word_runs
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: First bit and width of each segment of the 64 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def shingle_hashes(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with words, their numbers of shingles, and the shingles' XXH64 one row after the other."""
    import pyarrow.compute as pc

    flat, counts = word_runs(pc.ascii_lower(text))
    rows = np.flatnonzero(counts)
    if not len(rows):
        return rows, counts[rows], np.zeros(0, np.uint64)
    lines = joined(flat, counts)
    offsets, data = plain(flat)
    at, _ = plain(lines)
    first = starts_of(counts)
    row_of_word = np.repeat(np.arange(len(counts)), counts)
    start = at[row_of_word].astype(np.int64) + offsets[:-1] - offsets[first[row_of_word]] + np.arange(len(flat)) - first[row_of_word]
    end = start + np.diff(offsets)
    n = np.where(counts[rows] < shingle, 1, counts[rows] - shingle + 1)
    block = starts_of(n)
    within = np.arange(n.sum()) - np.repeat(block, n)
    word = np.repeat(first[rows], n) + within
    last = np.minimum(word + shingle - 1, np.repeat(first[rows] + counts[rows] - 1, n))
    raw, digest = plain(lines)[1].tobytes(), xxhash.xxh64_intdigest
    return rows, n, np.fromiter((digest(raw[s:e], SEED) for s, e in zip(start[word].tolist(), end[last].tolist(), strict=True)), np.uint64, len(word))


def fingerprints(text: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is set in over half of the shingles' XXH64."""
    return fingerprints_of(len(text), *shingle_hashes(text, shingle))


def fingerprints_of(size: int, rows: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """fingerprints of `size` texts by their shingle_hashes."""
    out = np.zeros(size, np.uint64)
    if not len(rows):
        return out
    within = np.arange(len(h)) - np.repeat(starts_of(n), n)
    # Bits are counted eight at a time in the bytes of a word, at most 255 hashes to a block.
    cuts = np.flatnonzero(within % 255 == 0)
    per_row = np.flatnonzero(within[cuts] == 0)
    ones = np.zeros((len(rows), 64), np.int64)
    lane = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & lane, cuts).view(np.uint8).reshape(-1, 8)
        ones[:, k::8] = np.add.reduceat(sums.astype(np.int64), per_row, axis=0)
    bits = (2 * ones > n[:, None]).astype(np.uint8)
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codewords by index, the nearest index of each syndrome's coset leader, weight-7 codewords."""
    generator, words = 0b101011100011, np.zeros(4096, np.int64)
    info = np.arange(4096, dtype=np.int64)
    for bit in range(12):
        words ^= np.where(info >> bit & 1, generator << bit, 0)
    leaders = np.zeros(2048, np.int64)
    patterns = [0, *(1 << a for a in range(23)), *(1 << a | 1 << b for a in range(23) for b in range(a)), *(1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b))]
    patterns = np.array(patterns, np.int64)
    leaders[syndrome(patterns)] = patterns
    return words, leaders, words[np.bitwise_count(words) == 7]


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of the 23-bit polynomials by the Golay generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, 0b101011100011 << (bit - 11), 0)
    return v


def near_codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codewords within four bits of each 23-bit vector: the nearest one and, if that is three bits away, the five at four bits."""
    _, leaders, sevens = golay()
    error = leaders[syndrome(v)]
    nearest = v ^ error
    rows, words = [np.arange(len(v))], [nearest]
    for i in range(0, len(v), 65536):
        part = error[i : i + 65536]
        r, c = np.nonzero(((sevens[None, :] & part[:, None]) == part[:, None]) & (np.bitwise_count(part) == 3)[:, None])
        rows.append(r + i)
        words.append(nearest[r + i] ^ sevens[c])
    return np.concatenate(rows), np.concatenate(words)


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            part = [(fp >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
            for i in range(3):
                rows, words = near_codewords(part[(i + 1) % 3])
                key = (np.int64(i) << 60) | (part[i][rows] << 23) | words
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)[rows])], ["key", "fp"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, at (xxhash64 of the text) and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fp = fingerprints(texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("at"), pa.array(fp.view(np.int64))], ["doc_id", "at", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("at")).mapInArrow(run, "doc_id long, at long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in RADIUS bits or fewer, each once or more."""
    keyed = distinct.select("fp").mapInArrow(keys_of, "key long, fp long")
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, at (xxhash64 of the text), fp and component_id of every row.

    component_id is the smallest doc_id that links reach, null only where all of these are null.
    Texts without words have fingerprint zero; repeated rows share a fingerprint.
    """
    shared_dir(docs.sparkSession)
    fps = checkpoint(fingerprint_table(docs))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "at", "fp", "component_id")


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row; nulls, empty texts and repeated rows as in near_duplicates."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.

    Components are those of groups (doc_id, at, component_id), or of near_duplicates; at is xxhash64 of the text. Rows without a
    doc_id stay unless a row with one is in their component; of rows that share a doc_id one stays. Extra columns, of any names, stay.
    """
    groups = checkpoint((near_duplicates(docs) if groups is None else groups).select("doc_id", "at", "component_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = checkpoint(groups.where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("at").alias("gone_at")).distinct())
    ties = checkpoint(groups.where(stays & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("tie_id")).count().where("count > 1").select("tie_id"))
    out = docs.join(sent(gone), docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("gone_at")), "left_anti")
    if ties.isEmpty():
        return out
    tied = lambda how: out.join(sent(ties), out["doc_id"].cast("long") == F.col("tie_id"), how)
    plain_columns = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType)]
    first = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text", F.xxhash64(*plain_columns))).alias("row")
    one = tied("left_semi").groupBy("doc_id").agg(first).select("row.*")
    return tied("left_anti").unionByName(one)
