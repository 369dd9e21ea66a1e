"""Language identification by known words, backing off to shorter and shorter character n-grams.

A model holds, for each language, the log frequency of its common words and of the 1- to 4-grams of
their letters. A known word counts by its frequencies; an unseen one is read from left to right,
each time by the longest n-gram that is known.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TRIM, crc_mod, plain, slices, texts, word_runs

UNKNOWN = "und"
#: Bounds of what is learned of every language there is: about so many documents of each; of their words the most frequent
#: ones, an equal part for each language but LEAST_WORDS in any case; the most frequent n-grams of each length.
DOCUMENTS, WORDS, LEAST_WORDS, GRAMS = 8_000, 160_000, 1_000, 20_000
LONGEST, SMOOTH, KEPT = 4, 0.5, 250_000
#: Least score of a document that the filter keeps.
LEAST_SCORE = 0.5
LETTERS = re.compile(r"[^\W\d_]+")
#: ASCII apart from letters is space.
SPACED = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def raw_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words between ASCII characters that are no letters."""
    offsets, data = plain(pc.utf8_lower(text))
    clean = SPACED[data[: offsets[-1]]]
    return word_runs(pa.StringArray.from_buffers(len(text), pa.py_buffer(offsets.tobytes()), pa.py_buffer(clean.tobytes())))


def letter_runs(word: str) -> list[str]:
    return [word] if word.isalpha() else [w for w in LETTERS.findall(word) if any(map(str.isalpha, w))]


class Model:
    """Log frequencies of words and n-grams, one column for each language."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.languages = sorted({lang for lang, _, _ in counts})
        column = {lang: i for i, lang in enumerate(self.languages)}
        columns, times = np.array([column[lang] for lang, _, _ in counts], np.int64), np.array([n for _, _, n in counts], np.float64)
        self.words, logs = self._table(((w,) for _, w, _ in counts), columns, times)
        self.grams: dict[str, int] = {}
        # One length of n-grams after the other, so that the driver has the counts of one alone.
        for k in range(1, LONGEST + 1):
            padded = (f"<{w}>" for _, w, _ in counts)
            found, more = self._table(([p[i : i + k] for i in range(len(p) - k + 1)] for p in padded), columns, times, GRAMS)
            self.grams |= {g: len(logs) + i for g, i in found.items()}
            logs = np.concatenate([logs, more])
        # All log frequencies are rows of one matrix; a word and an n-gram of the same letters are told apart.
        self.logs = logs
        self.forget()

    def forget(self) -> None:
        self.kept: pa.Array = pa.array([], pa.string())
        self.rows = np.zeros((1024, len(self.languages) + 1), np.float32)

    def _table(self, names: Iterable[Iterable[str]], columns: np.ndarray, times: np.ndarray, most: int | None = None) -> tuple[dict[str, int], np.ndarray]:
        """Of the names that each row has, which are added up by the rows' languages: places of all, or of the commonest, and their log frequencies."""
        index: dict[str, int] = {}
        at, each = array("i"), array("i")
        for row in names:
            before = len(at)
            for x in row:
                at.append(index.setdefault(x, len(index)))
            each.append(len(at) - before)
        m, n = np.zeros((len(index), len(self.languages))), np.asarray(each)
        np.add.at(m, (np.asarray(at), np.repeat(columns, n)), np.repeat(times, n))
        if most is None:
            return index, self._logs(m)
        total, known = m.sum(axis=1), list(index)
        top = sorted(range(len(known)), key=lambda i: (-total[i], known[i]))[:most]
        return {known[i]: r for r, i in enumerate(top)}, self._logs(m[top])

    def _logs(self, m: np.ndarray) -> np.ndarray:
        return np.log((m + SMOOTH) / (m.sum(axis=0) + SMOOTH * len(m))).astype(np.float32) if len(m) else m.astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        """The word's log frequency in each language, or that of the n-grams that it is read by."""
        if (known := self.words.get(word)) is not None:
            return self.logs[known]
        padded, i, found = f"<{word}>", 0, []
        while i < len(padded):
            for k in range(min(LONGEST, len(padded) - i), 0, -1):
                if (g := self.grams.get(padded[i : i + k])) is not None:
                    found.append(g)
                    break
            i += k
        return self.logs[found].sum(axis=0) if found else np.zeros(len(self.languages))

    def learned(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words: log frequencies and the number of letter runs, kept for the next time."""
        if len(self.kept) > KEPT:
            self.forget()
        at = pc.index_in(words, self.kept)
        if at.null_count:
            new, first = words.filter(pc.is_null(at)), len(self.kept)
            if first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((first // 2 + len(new), self.rows.shape[1]), np.float32)])
            for i, w in enumerate(new.to_pylist(), first):
                runs = letter_runs(w)
                self.rows[i] = 0
                for x in runs:
                    self.rows[i, :-1] += self.word(x)
                self.rows[i, -1] = len(runs)
            self.kept = pa.concat_arrays([self.kept, new])
            at = pc.index_in(words, self.kept)
        return self.rows[at.to_numpy()]

    def scores(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each text's language, its share of the evidence, and if the text has letters."""
        flat, counts = raw_words(text)
        rows = np.flatnonzero(counts)
        total, n = np.zeros((len(counts), len(self.languages))), np.zeros(len(counts))
        if len(rows):
            coded = flat.dictionary_encode()
            table = self.learned(coded.dictionary)
            first = (np.cumsum(counts) - counts)[rows]
            sums = np.add.reduceat(table[coded.indices.to_numpy()], first, axis=0, dtype=np.float64)
            total[rows], n[rows] = sums[:, :-1], sums[:, -1]
        if not self.languages:
            return np.zeros(len(counts), int), np.zeros(len(counts)), n > 0
        z = total / np.sqrt(np.maximum(n, 1))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        best = z.argmax(axis=1)
        return best, (z / z.sum(axis=1, keepdims=True))[np.arange(len(z)), best], n > 0


def learn(rows: DataFrame) -> Model:
    """A model of rows (doc_id, text, lang), from a bounded sample of about DOCUMENTS rows of each language."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy("lang").count().collect()  # a row for each language
    if not found:
        return Model([])
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, DOCUMENTS / r["count"]))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seen: dict[tuple[str, str], int] = Counter()
                langs = part.column("lang").dictionary_encode()
                names = langs.dictionary.to_pylist()
                flat, counts = raw_words(texts(part.column("text")))
                coded = flat.dictionary_encode()
                pairs, n = np.unique(coded.indices.to_numpy().astype(np.int64) * len(names) + np.repeat(langs.indices.to_numpy(), counts), return_counts=True)
                words = coded.dictionary.to_pylist()
                for p, k in zip(pairs.tolist(), n.tolist(), strict=True):
                    for x in letter_runs(words[p // len(names)]):
                        seen[names[p % len(names)], x] += k
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()), "word": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    words = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = words.withColumn("r", F.row_number().over(top)).where(F.col("r") <= max(WORDS // len(found), LEAST_WORDS))
    rows = kept.select("lang", "word", "n").toArrow()  # bounded by WORDS, or LEAST_WORDS a language
    model = Model(sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True)))
    del rows
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)
    return model


def trained(docs: DataFrame) -> Model:
    """Learned from documents whose crc32(doc_id as text) mod 4 is not 2."""
    return learn(docs.select("doc_id", "text", "lang").where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row; a text that is null or without letters is UNKNOWN, with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                best, score, letters = model.scores(texts(part.column("text")))
                names = [model.languages[b] if x and model.languages else UNKNOWN for b, x in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. A row without a doc_id is not learned from and counts as not held out.

    Null or empty texts and those without letters are UNKNOWN; repeated rows are judged alike; an empty table gives none.
    """
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return predict(docs, trained(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows with all columns of any names, without those that have no letter (null and empty texts too) or no language of at least that score.

    Where no language can be learned, all rows with letters stay. Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs))

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                _, score, letters = model.scores(texts(part.column("text")))
                yield part.filter(pa.array(letters & ((score >= least) | (not model.languages))))

    return docs.mapInArrow(run, docs.schema)
