"""Benchmark decontamination with an FM-index of each training shard.

The benchmark's windows of ten words are the test phrases, its words the alphabet. A shard is a
slice of a task's rows; its index holds the runs of alphabet words that are as long as the shortest
phrase, each closed by a separator. Phrases are searched backwards by ranks in a wavelet matrix
of the Burrows-Wheeler transform, all at once; occurrences are located by walking to a sampled suffix
position. Shards need nothing from each other, so the documents aren't shuffled. A benchmark beyond BLOCK_BYTES is
searched in blocks, one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh_name, plain, sent, slices, starts_of, texts, word_runs

WINDOW = 10
#: Text of the benchmark, about, that the driver and an executor have at a time; a larger benchmark is searched block by block.
BLOCK_BYTES = 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = np.array([c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)], np.uint8)


def lowered_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of `WORD` in the texts with A-Z lowered, and each row's number of them."""
    offsets, data = plain(text)
    clean = SPACED[data[: offsets[-1]]]
    return word_runs(pa.StringArray.from_buffers(len(text), pa.py_buffer(offsets.tobytes()), pa.py_buffer(clean.tobytes())))


class Phrases:
    """The distinct windows of a benchmark's items as rows of word ids from 1 on, padded with 0 on the left; ids are places in the vocabulary.

    All of it is in arrays: some 50 bytes a word of the items' texts.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        flat, counts = lowered_words(pa.array([t or "" for _, t in items], pa.string()))
        self.vocabulary = pc.unique(flat)
        ids = np.concatenate([np.zeros(window, np.int32), pc.index_in(flat, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int32) + 1])
        n = np.where(counts, np.maximum(1, counts - window + 1), 0)  # windows of each item
        of = np.repeat(np.arange(len(items)), n)
        # The last word of each window, and how many words it has.
        last = np.repeat(starts_of(counts) + np.minimum(counts, window) - 1 - starts_of(n), n) + np.arange(n.sum())
        length = np.minimum(counts, window)[of]
        rows = ids[last[:, None] + np.arange(1, window + 1)]
        rows[np.arange(window) < window - length[:, None]] = 0
        self.words, place = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.length = (self.words > 0).sum(axis=1).astype(np.int64)
        names = [None if x is None else str(x) for x, _ in items]
        self.names = sorted({x for x in names if x is not None})
        code = {x: i for i, x in enumerate(self.names)}
        codes = np.array([code.get(x, -1) for x in names], np.int64)[of] if len(of) else np.zeros(0, np.int64)
        pairs = np.unique(place.ravel()[codes >= 0] * max(1, len(self.names)) + codes[codes >= 0])
        self.codes = (pairs % max(1, len(self.names))).astype(np.int32)
        self.first = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(self.words) + 1))

    def items(self, phrase: int) -> list[str]:
        """Ids of the items that have a phrase, without those that are null."""
        return [self.names[c] for c in self.codes[self.first[phrase] : self.first[phrase + 1]]]


class FMIndex:
    """FM-index of runs of symbols from 1 on, each run closed by a 0."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 16):
        n = len(text)
        self.n, self.levels = n, max(1, int(sigma).bit_length())
        closing = text == 0
        # Separators are told apart by their places, so that no suffix is a prefix of another one.
        rank = np.where(closing, np.cumsum(closing) - 1, text + closing.sum())
        k = 1
        while True:
            follows = np.zeros(n, np.int64)
            follows[:-k] = rank[k:] + 1
            key = rank * np.int64(max(n, int(rank.max(initial=0)) + 1) + 2) + follows
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if n < 2 or rank[order[-1]] == n - 1:
                break
            k *= 2
        self.first = np.searchsorted(text[order], np.arange(sigma + 2))
        # Sampled positions; a run's start is one, so that no walk crosses a separator.
        sampled = np.arange(n) % every == 0
        sampled[0] = True
        sampled[1:] |= closing[:-1]
        self.marked = sampled[order]
        self.mark_rank = np.cumsum(self.marked) - 1
        self.sample = order[self.marked]
        last = text[order - 1]
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels):
            bit = (last >> (self.levels - 1 - level) & 1).astype(bool)
            packed = np.zeros(n // 64 + 1, np.uint64)
            packed.view(np.uint8)[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        self.base = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits before place i of a level."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, i)
            i = np.where(c >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c in the first i places of the transform."""
        return self._down(c, i) - self.base[c]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with the first and last+1 of their rows."""
        at = np.arange(len(phrases))
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        width = phrases.shape[1]
        over: list[tuple] = []
        for step in range(width):
            ended = length[at] == step
            over.append((at[ended], lo[ended], hi[ended]))
            at, lo, hi = at[~ended], lo[~ended], hi[~ended]
            c = phrases[at, width - 1 - step]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
        over.append((at, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*over, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(at):
            there = self.marked[rows]
            out[at[there]] = self.sample[self.mark_rank[rows[there]]] + steps
            at, rows, steps = at[~there], rows[~there], steps + 1
            c, i = np.zeros(len(rows), np.int64), rows
            for level in range(self.levels):
                bit = (self.bits[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
                ones = self._ones(level, i)
                i = np.where(bit, self.zeros[level] + ones, i - ones)
                c = c << 1 | bit
            rows = self.first[c] + i - self.base[c]
        return out


def occurrences(text: pa.Array, phrases: Phrases) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a shard: each row's number of words; the phrase, first word and row of each occurrence."""
    vocabulary = phrases.vocabulary
    flat, counts = lowered_words(text)
    none = np.zeros(0, np.int64)
    shortest = int(phrases.length.min()) if len(phrases.length) else 0
    if not len(flat) or not shortest:
        return counts, (none, none, none)
    ids = pc.fill_null(pc.index_in(flat, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    row = np.repeat(np.arange(len(counts)), counts)
    known = ids > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1] | (row[1:] != row[:-1])
    run = np.cumsum(opens) - 1
    sizes = np.bincount(run[known]) if known.any() else none
    long_enough = sizes >= shortest
    take = np.flatnonzero(known)
    take = take[long_enough[run[take]]]
    if not len(take):
        return counts, (none, none, none)
    size = sizes[long_enough]
    # Each run's words, then a separator.
    place = np.arange(len(take)) + np.repeat(np.arange(len(size)), size)
    symbols = np.zeros(len(take) + len(size), np.int64)
    symbols[place] = ids[take]
    word_at = np.full(len(symbols), -1, np.int64)
    word_at[place] = take
    index = FMIndex(symbols, len(vocabulary))
    which, lo, hi = index.search(phrases.words, phrases.length)
    n = hi - lo
    first = word_at[index.locate(np.repeat(lo - starts_of(n), n) + np.arange(n.sum()))]
    return counts, (np.repeat(which, n), first, row[first])


def digest(items: set[str] | list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's items, each once, about block_bytes of text at a time; the driver has one block."""
    items = benchmark.select("item_id", "text").distinct()
    n = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    if n > 1:
        items = checkpoint(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))))
    for b in range(n):
        yield [tuple(r) for r in (items.where(F.col("block") == b).select("item_id", "text") if n > 1 else items).collect()]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """Hits of every row of docs.

    Gives doc_id, n_words, removed (merged intervals [start, stop) of words) and items (ids of items with
    occurring windows, sorted as strings). With `clean` it gives the input's columns, of any names, with the
    intervals of all blocks cut out of the untouched text, n_chars following, and without rows left wordless by it.
    An item without words has no window; hits of an item without an id count, but it is not listed. Null and empty texts
    have no words, repeated rows are alike, an empty table gives none.

    A benchmark of one block is sent to all tasks, and the documents stay where they are. A larger one is searched block by block, so that
    no machine has more than one: what is found, by the texts' digests, is kept and joined to the documents in the end.
    """
    sc, kept = docs.sparkSession.sparkContext, []
    blocks = iter(blocks_of(benchmark, block_bytes))
    first = Phrases(next(blocks, []), window)
    second = next(blocks, None)
    if second is None:
        shared = sc.broadcast(first)
        hits = lambda part: _hits(part, shared.value)
        if clean:
            return docs.mapInArrow(_cutting(hits), docs.schema)
        return docs.select("doc_id", "text").mapInArrow(_finding(hits), FOUND)
    for phrases in chain([first], (Phrases(x, window) for x in chain([second], blocks))):
        shared = sc.broadcast(phrases)
        kept.append(checkpoint(docs.select("text").mapInArrow(_matched(shared), f"digest binary, {SPANS}, items array<string>")))
        shared.destroy()
    digest, spans, items = (fresh_name(docs.columns, x) for x in ("text_digest", "text_spans", "text_items"))
    # Equal texts have equal hits in each block.
    alike = reduce(DataFrame.union, (k.dropDuplicates(["digest"]) for k in kept)).groupBy(F.col("digest").alias(digest))
    found = checkpoint(alike.agg(F.flatten(F.collect_list("removed")).alias(spans), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items)))
    rows = docs if clean else docs.select("doc_id", "text")
    joined = rows.withColumn(digest, F.unhex(F.sha2("text", 256))).join(sent(found), digest, "left").drop(digest)

    def known(part: pa.RecordBatch) -> tuple:
        at, names = part.column(spans).to_pylist(), part.column(items).to_pylist()
        _, counts = lowered_words(texts(part.column("text")))
        return counts, [merged([(x["start"], x["stop"]) for x in s or []]) for s in at], [set(x or []) for x in names]

    return joined.mapInArrow(_cutting(known, rows.columns), docs.schema) if clean else joined.mapInArrow(_finding(known), FOUND)


SPANS = "removed array<struct<start:long,stop:long>>"
FOUND = f"doc_id long, n_words long, {SPANS}, items array<string>"
SPAN_LISTS = pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))


def _spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], SPAN_LISTS)


def _hits(part: pa.RecordBatch, phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    counts, (which, first, row) = occurrences(texts(part.column("text")), phrases)
    starts, order = starts_of(counts), np.argsort(first, kind="stable")
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    items: list[set[str]] = [set() for _ in counts]
    for p, a, r in zip(which[order].tolist(), first[order].tolist(), row[order].tolist(), strict=True):
        a -= int(starts[r])
        spans[r].append((a, a + int(phrases.length[p])))
        items[r].update(phrases.items(p))
    return counts, [merged(x) for x in spans], items


def _matched(shared):
    """Digest, intervals and items of the texts that have any."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                _, spans, items = _hits(part, shared.value)
                hit = [i for i, s in enumerate(spans) if s]
                digests = [hashlib.sha256(part.column("text")[i].as_py().encode()).digest() for i in hit]
                yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "removed": _spans([spans[i] for i in hit]), "items": pa.array([sorted(items[i]) for i in hit], pa.list_(pa.string()))})

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _finding(hits: Callable):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                counts, spans, items = hits(part)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "n_words": pa.array(counts), "removed": _spans(spans), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))})

    return run


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of each interval."""
    words = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def _cutting(hits: Callable, names: list[str] | None = None):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                counts, spans, _ = hits(part)
                part = part.select(names) if names else part
                if not any(spans):
                    yield part
                    continue
                old = part.column("text").to_pylist()
                new = [cut(t, s) if s else t for t, s in zip(old, spans, strict=True)]
                left = pa.array([not s or sum(b - a for a, b in s) < n for s, n in zip(spans, counts.tolist(), strict=True)])
                columns = []
                for field, column in zip(part.schema, part.columns, strict=True):
                    if field.name == "text":
                        column = pa.array(new, field.type)
                    elif field.name == "n_chars":
                        column = pa.array([len(t) if s else c for t, s, c in zip(new, spans, column.to_pylist(), strict=True)], field.type)
                    columns.append(column)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(left)

    return run


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts, items_sha256 and contaminated of every row; nulls, empty texts, ties and empty tables as in find."""
    n_hit = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return find(docs, benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("removed") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: The query's result for DuckDB; doc_ids are taken to be distinct.
OP10_SQL = f"""
with b as (select item_id, {_WORDS} words from benchmark), d as (select doc_id, {_WORDS} words from documents),
phrases as (select distinct item_id, least(len(words), {WINDOW}) n, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') s from (select item_id, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 2))) i from b where len(words) > 0)),
sizes as (select distinct n from phrases),
win as (select doc_id, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') s from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) i from d, sizes where len(words) >= n)),
hits as (select doc_id, item_id, i, n from win join phrases using (n, s)),
words as (select doc_id, count(distinct i + k) n from (select distinct doc_id, i, n from hits) h, range({WINDOW}) r(k) where k < h.n group by 1),
items as (select doc_id, count(*) n, string_agg(item, ',' order by item) t from (select distinct doc_id, item_id::varchar item from hits where item_id is not null) group by 1)
select doc_id, len(words)::bigint n_words, coalesce(words_.n, 0) n_hit, coalesce(items.n, 0) n_items, sha256(coalesce(t, '')) items_sha256, coalesce(words_.n, 0) > 0 contaminated
from d left join words words_ using (doc_id) left join items using (doc_id)
"""
