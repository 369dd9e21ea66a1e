"""Token-ID output: Parquet list columns, dictionary encoded, with small row groups and page indexes.

Documents are dealt by ranges of doc_id, sorted and encoded, and each range is one file: doc_id,
shard, start_in_shard, n_tokens, tokens. Token pages carry dictionary codes, the sorted columns
delta or dictionary codes; column and offset indexes let a reader that wants some doc_ids, or only
the metadata, skip all other pages.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh_path, joined, plain, slices, small_batches, starts_of, texts

END_ID = 0
#: Options of the Parquet writer. Small row groups and pages are what makes selective reads cheap.
LAYOUT = {"parquet.block.size": 32 << 20, "parquet.page.size": 256 << 10, "parquet.page.row.count.limit": 2000, "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "compression": "zstd"}
#: Text of a file, whose rows one task sorts and encodes.
SHARD_BYTES = 24 << 20
#: Distinct pieces whose ids a Python worker keeps.
KEPT_PIECES = 300_000
#: New words that are encoded as one text (each one's first token begins with the space), and texts at a time.
TOGETHER, BATCH = 200, 25


def pieces_of(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Starts of pieces in the bytes of texts, only where the byte-level pre-tokenizer always cuts.

    That is: before a space that no white space follows; around a line feed between characters that are no white
    space; between a letter or digit and punctuation other than an apostrophe. Where the bytes do not tell (other
    scripts' white space), there is no cut.
    """
    visible = (data > 32) & (data < 127)
    lead = visible | ((data >= 0xC3) & (data != 0xE1) & (data != 0xE2) & (data != 0xE3))  # begins a character that is no white space
    alnum = LATIN[data]
    alnum[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # accented Latin letters
    cut = np.zeros(len(data) + 1, bool)
    cut[:-2] |= (data[:-1] == 32) & lead[1:]
    feed = np.flatnonzero(data[1:-1] == 10) + 1
    feed = feed[(visible[feed - 1]) & lead[feed + 1]]
    cut[feed] = cut[feed + 1] = True
    cut[1:-1] |= alnum[:-1] & MARKS[data[1:]]
    cut[offsets[:-1]] = True
    cut[-1] = False
    return np.flatnonzero(cut)


#: The byte-level alphabet: printing characters of Latin-1 are themselves, the other bytes the characters from 256 on.
PRINTING = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
ALPHABET = {c: chr(c) for c in PRINTING} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in PRINTING)}
#: A piece that the pre-tokenizer leaves whole, and the break before a word of such ones.
WHOLE, SPLIT = "^ [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$", "\n" + ALPHABET[32]
LATIN = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
MARKS = np.array([32 < c < 127 and not chr(c).isalnum() and c != 39 for c in range(256)])


class Encoder:
    """Token ids of texts, by a public tokenizer file of the `tokenizers` library.

    For a byte-level BPE, texts are cut where its pre-tokenizer always cuts, so that the ids of a text are those of its
    pieces in a row, and each distinct piece is encoded once. With any other tokenizer a piece is a whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        before = parts.get("pre_tokenizer") or {}
        self.byte_level = parts["model"].get("type") == "BPE" and not parts.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The same model for words that are told apart by white space and written in the byte-level alphabet already.
        self.by_word = Tokenizer(self.tokenizer.model)
        self.by_word.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == ALPHABET[32]]] = True
        self.forget()

    def _whole_added_tokens(self, cuts: np.ndarray, raw: bytes) -> np.ndarray:
        """Cuts without those inside of an added token, which goes before all else."""
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                cuts = cuts[(cuts <= at) | (cuts >= at + len(token))]
                at = raw.find(token, at + len(token))
        return cuts

    def forget(self, least: int = 0) -> None:
        """Keeps the pieces met at least that often (none: least is 0). Code 0 is the end of a text, code i + 1 the i-th known piece."""
        if not least:
            self.known = pa.array([], pa.string())
            self.ids, self.used = np.full(1 << 16, END_ID, np.int32), 1
            self.start, self.length, self.met = np.zeros(1, np.int32), np.ones(1, np.int32), np.zeros(1, np.int32)
            return
        kept = self.met >= least
        self.known = self.known.filter(pa.array(kept[1:]))
        kept[0] = True
        self.length = self.length[kept]
        start = starts_of(self.length)
        self.ids = self.ids[np.repeat(self.start[kept] - start, self.length) + np.arange(self.length.sum())]
        self.used = len(self.ids)
        self.start, self.met = start.astype(np.int32), np.zeros(len(self.length), np.int32)

    def learn(self, pieces: pa.Array) -> None:
        """Encodes new pieces. Words of Latin letters, which the pre-tokenizer leaves whole, go many to a text and are told apart by the spaces before them."""
        simple = pc.match_substring_regex(pieces, WHOLE) if self.byte_level else pa.array(np.zeros(len(pieces), bool))
        words, other = pieces.filter(simple), pieces.filter(pc.invert(simple))
        for part in (words.slice(i, TOGETHER * BATCH) for i in range(0, len(words), TOGETHER * BATCH)):
            n = np.full(-(-len(part) // TOGETHER), TOGETHER)
            n[-1] = len(part) - TOGETHER * (len(n) - 1)
            texts_ = [t if t.isascii() else t.encode().decode("latin-1").translate(ALPHABET) for t in joined(part, n, "").to_pylist()]
            ids, _ = self._encoded(self.by_word, [t.replace(" ", SPLIT) for t in texts_])
            self._add(part, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids))), ids)
        for part in (other.slice(i, TOGETHER * BATCH) for i in range(0, len(other), TOGETHER * BATCH)):
            ids, n = self._encoded(self.tokenizer, part.to_pylist())
            self._add(part, n, ids)

    def _encoded(self, tokenizer, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), n

    def _add(self, pieces: pa.Array, n: np.ndarray, ids: np.ndarray) -> None:
        if len(n) != len(pieces):
            raise ValueError("the tokenizer doesn't keep words apart")
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used // 2 + 2 * len(ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, (self.used + starts_of(n)).astype(np.int32)])
        self.length = np.concatenate([self.length, n.astype(np.int32)])
        self.met = np.concatenate([self.met, np.zeros(len(n), np.int32)])
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, pieces])

    def codes(self, pieces: pa.Array) -> np.ndarray:
        """Codes of distinct pieces, new ones included."""
        least = 2
        while len(self.known) > KEPT_PIECES:
            self.forget(least)
            least *= 2
        code = pc.index_in(pieces, self.known)
        if code.null_count:
            before, new = len(self.known), pieces.filter(pc.is_null(code))
            self.learn(new)
            place = np.empty(len(new), np.int32)
            place[pc.index_in(self.known.slice(before), new).to_numpy()] = np.arange(before, len(self.known))
            code = code.to_numpy(zero_copy_only=False)
            code[np.isnan(code)] = place
        return np.asarray(code, np.int32) + 1

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, END_ID after each, and how many each text has."""
        offsets, data = plain(text)
        offsets, data = offsets.astype(np.int64), data[: offsets[-1]]
        counts, full, cuts = np.zeros(len(text), np.int64), np.flatnonzero(np.diff(offsets)), np.zeros(0, np.int64)
        if len(data):
            cuts = self._whole_added_tokens(pieces_of(np.append(offsets[:-1][full], len(data)), data), data.tobytes()) if self.byte_level else offsets[:-1][full]
            counts[full] = np.diff(np.append(np.searchsorted(cuts, offsets[:-1][full]), len(cuts)))
        bounds = np.append(cuts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        code, at = self.codes(coded.dictionary), coded.indices.to_numpy()
        self.met[code] += np.bincount(at, minlength=len(code)).astype(np.int32)
        # Each text's pieces, then its end.
        whole = np.zeros(len(at) + len(text), np.int32)
        whole[np.arange(len(at)) + np.repeat(np.arange(len(text)), counts)] = code[at]
        length = self.length[whole]
        ends = np.cumsum(length, dtype=np.int64)
        where = np.repeat((self.start[whole] - (ends - length)).astype(np.int32), length) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        stops = ends[np.cumsum(counts + 1) - 1] if len(text) else ends
        return self.ids[where], np.diff(stops, prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, shards: int | None = None) -> None:
    """Writes the ids of every whole text in ascending doc_id order (rows without one first).

    A null text is empty and has END_ID alone. Rows of one doc_id follow each other by n_chars (by the text's length
    where there is no such column), then text. Without a number of shards there is one for each SHARD_BYTES of text.
    """
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))
    if shards is None:
        shards = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES + 1
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("n_chars")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, before, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, budget=2 << 20):
                ids, n = encode(texts(part.column("text")))
                offsets = np.concatenate([[0], np.cumsum(n)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(offsets[:-1] + before), pa.array(n), tokens], ["doc_id", "shard", "start_in_shard", "n_tokens", "tokens"])
                before += int(offsets[-1])

    rows.drop("n_chars").mapInArrow(run, "doc_id long, shard int, start_in_shard long, n_tokens long, tokens array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The written rows, or those of a range of doc_ids; `start` counts the ids of all rows before."""
    files = spark.read.schema("doc_id long, shard int, start_in_shard long, n_tokens long, tokens array<int>").parquet(path)
    totals = sorted(files.groupBy("shard").agg(F.sum("n_tokens")).collect())  # one row for each file
    base, before = [], 0
    for shard, n in totals:
        base.append((shard, before))
        before += n
    for bound, keep in ((first, F.col("doc_id") >= first), (last, F.col("doc_id") <= last)):
        files = files.where(keep) if bound is not None else files
    return files.join(F.broadcast(spark.createDataFrame(base, "shard int, base long")), "shard").withColumn("start", F.col("base") + F.col("start_in_shard"))


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the last two from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("tokens")
            offsets = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from written files; nulls, ties and empty tables as in write_tokens."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = fresh_path(docs.sparkSession, "tokens")
    with small_batches(docs.sparkSession):
        write_tokens(docs, path, tokenizer)
        return checkpoint(checksums(read_tokens(docs.sparkSession, path)))
