"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence are shape features of the line and of its two neighbours; the chain
adds how likely lines of a kind follow each other. Forward-backward gives each line's probability
of being good; their mean, weighted by length, is mapped to a score by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, plain, slices, starts_of, texts

#: Bound of the labelled rows that are learned from (about; whole texts of each).
ROWS = 6_000
STEPS, RATE, RIDGE = 150, 0.1, 2e-3
#: Byte classes that are counted in a line.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "stop": b".,;:?", "shout": b"!", "symbol": b"#*$%&<>@^_~=+", "bar": b"|", "quote": b"\"'()[]{}/\\-"}
N_FEATURES = 13


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all rows, each row's number of lines, and the lines' weights (bytes and one)."""
    lists = pc.split_pattern(text, "\n")
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    offsets, data = plain(lists.flatten())
    size = np.diff(offsets).astype(np.float64)
    n = {}
    for name, members in CLASSES.items():
        total = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(members, np.uint8)), dtype=np.int64)])
        n[name] = np.diff(total[offsets])
    visible = np.maximum(size - n["space"], 1)
    words = np.maximum(n["space"] + 1, 1)
    last = data[np.maximum(offsets[1:] - 1, 0)] if len(data) else np.zeros(len(size), np.uint8)
    coded = lists.flatten().dictionary_encode().indices.to_numpy()
    row = np.repeat(np.arange(len(counts)), counts)
    _, place, times = np.unique(coded * np.int64(len(counts) + 1) + row, return_inverse=True, return_counts=True)
    f = np.stack(
        [
            np.log1p(words), np.log1p(visible / words), n["upper"] / visible, n["digit"] / visible, n["stop"] / words, n["shout"] / words, np.minimum(n["symbol"] / words, 3), n["bar"] / words, n["quote"] / words,
            (size > 0) & np.isin(last, np.frombuffer(b".!?:;\"'", np.uint8)), size == 0, np.log(times[place]), np.log1p(counts[row]),
        ],
        axis=1,
    )
    return f.astype(np.float64), counts, size + 1


def with_neighbours(f: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after (zero at a text's ends), and a one."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[starts_of(counts)] = 0
    after[np.cumsum(counts) - 1] = 0
    return np.concatenate([f, before, after, np.ones((len(f), 1))], axis=1)


def marginals(unary: np.ndarray, step: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of both states of each line, and the expected number of each step between states.

    All texts go forward and backward together, one line of each at a time.
    """
    order = np.argsort(-counts, kind="stable")
    first, length = starts_of(counts)[order], counts[order]
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length.max(initial=0)))]  # texts longer than t lines
    e = np.exp(unary - unary.max(axis=1, keepdims=True))
    t = np.exp(step - step.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    a = e[first]
    a /= a.sum(axis=1, keepdims=True)
    forward[first] = a
    for i, k in enumerate(active[1:], 1):
        a = (forward[first[:k] + i - 1] @ t) * e[first[:k] + i]
        forward[first[:k] + i] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for i in range(len(active) - 1, 0, -1):
        at = first[: active[i]] + i
        b = (e[at] * backward[at]) @ t.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = forward[at - 1][:, :, None] * t[None] * (e[at] * backward[at])[:, None, :]
        expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = forward * backward
    return p / p.sum(axis=1, keepdims=True), expected


class Model:
    """Weights of the features and of the steps between states, and the curve from good share to score."""

    def __init__(self, f: np.ndarray, counts: np.ndarray, weight: np.ndarray, label: np.ndarray):
        self.mean = self.scale = None
        self.w, self.step, self.curve = np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), (0.0, 0.0)
        if not len(label):
            return
        self.mean, self.scale = f.mean(axis=0), f.std(axis=0) + 1e-6
        x = with_neighbours((f - self.mean) / self.scale, counts)
        y = np.repeat(label, counts)
        # A text's lines share its label; each text counts alike, however many lines it has.
        of_line = np.repeat(1 / counts, counts)
        same = np.zeros((2, 2))
        same[0, 0], same[1, 1] = (counts - 1)[label == 0].sum(), (counts - 1)[label == 1].sum()
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros((2, 2)), np.zeros((2, 2))]
        for i in range(1, STEPS + 1):
            p, expected = marginals(np.stack([np.zeros(len(x)), x @ self.w], axis=1), self.step, counts)
            g = ((y - p[:, 1]) * of_line) @ x / len(label) - RIDGE * self.w
            h = (same - expected) / max(1, same.sum()) - 0.1 * self.step
            for j, (grad, of) in enumerate(((g, "w"), (h, "step"))):
                moments[2 * j] = 0.9 * moments[2 * j] + 0.1 * grad
                moments[2 * j + 1] = 0.99 * moments[2 * j + 1] + 0.01 * grad**2
                setattr(self, of, getattr(self, of) + RATE * (moments[2 * j] / (1 - 0.9**i)) / (np.sqrt(moments[2 * j + 1] / (1 - 0.99**i)) + 1e-8))
        z = self._share(f, counts, weight)
        a, b = 1.0, 0.0
        for _ in range(200):  # Newton steps of a logistic regression of one variable, lightly held to a = 1, b = 0
            p = 1 / (1 + np.exp(-(a * z + b)))
            v = p * (1 - p)
            g = np.array([((label - p) * z).sum() - (a - 1), (label - p).sum() - b])
            hess = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1]])
            d = np.linalg.solve(hess, g)
            a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
            if np.abs(d).max() < 1e-9:
                break
        self.curve = (a, b)

    def lines(self, f: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        x = with_neighbours((f - self.mean) / self.scale, counts)
        return marginals(np.stack([np.zeros(len(x)), x @ self.w], axis=1), self.step, counts)[0][:, 1]

    def _share(self, f: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        p, first = self.lines(f, counts), starts_of(counts)
        good = np.clip(np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first), 1e-4, 1 - 1e-4)
        return np.log(good / (1 - good))

    def scores(self, text: pa.Array) -> np.ndarray:
        f, counts, weight = line_features(text)
        if self.mean is None or not len(counts):
            return np.full(len(counts), 0.5)
        return 1 / (1 + np.exp(-(self.curve[0] * self._share(f, counts, weight) + self.curve[1])))


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """A model of labelled rows whose crc32(doc_id as text) mod 3 is not 1, about `rows` of them chosen by a hash.

    Labels other than 0 and 1 and labels of documents that aren't there are left out; of several labels of a document
    the smallest counts. Without labels every score is one half.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where((crc_mod("doc_id", 3) != 1) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n = labels.count()
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / max(n, 1))))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, counts, weight = line_features(texts(batch.column("text")))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            lists = [pa.ListArray.from_arrays(pa.array((offsets * k).astype(np.int32)), pa.array(x.ravel())) for k, x in ((f.shape[1], f), (1, weight))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *lists], ["doc_id", "quality", "f", "weight"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, quality int, f array<double>, weight array<double>").toPandas()
    got = got.assign(sum=got["weight"].map(np.sum), first=got["f"].map(lambda x: float(x[0]))).sort_values(["doc_id", "sum", "first"]) if len(got) else got
    flat = lambda c: np.concatenate(got[c].to_list()) if len(got) else np.zeros(0)
    return Model(flat("f").reshape(-1, N_FEATURES), got["weight"].map(len).to_numpy(np.int64), flat("weight"), got["quality"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row. A null text is an empty one, which is one line without characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(texts(part.column("text"))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row without a doc_id counts as not held out."""
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return score(docs, learn(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
