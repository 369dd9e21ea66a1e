"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are first-order chains over the characters of tokens. A token that is long enough and likelier by far as
a random string (by more, if it has no digit or no letter) is a span of its own.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: The kinds as listed, their patterns, the group that must be of a least length.
KINDS = ("assign", "access", "hex", "markov")
PATTERNS = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]+"), 0, 24),
)
#: What a text must have for a pattern to be tried on it; read by a linear-time engine.
NEEDS = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{16}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORDS = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Documents that the models are learned from (about), and made-up random strings beside those found in them.
SAMPLE, MADE_UP = 20_000, 3_000
#: Least log-likelihood ratio of a token in all and for each character.
LEAST_TOTAL, LEAST_EACH, LEAST_LENGTH, UNMIXED = 8.0, 0.35, 16, 2


def base_spans(text: str, kinds: tuple[bool, ...] = (True, True, True)) -> list[tuple[int, int, int]]:
    """start, kind and end of the patterns' matches, leftmost and non-overlapping for each kind."""
    out = []
    for kind, (pattern, group, least) in enumerate(PATTERNS):
        if kinds[kind]:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def counts_of(tokens: list[str]) -> np.ndarray:
    """Pairs of neighbouring characters; the last row counts first characters."""
    n = len(ALPHABET)
    out = np.zeros((n + 1) * (n + 1), np.int64)
    codes = CODE[np.frombuffer("\x7f".join(["", *tokens, ""]).encode("ascii"), np.uint8)]
    np.add.at(out, codes[:-1] * (n + 1) + codes[1:], 1)
    out = out.reshape(n + 1, n + 1)
    out[:, n] = 0
    return out


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Hexadecimal, base-32, base-62 and base-64 strings of usual key lengths."""
    r = random.Random(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64])
    return ["".join(r.choices(kinds[i % 4], k=r.randint(16, 64))) for i in range(n)]


class Models:
    """Log-likelihood ratio of a token as a random string against an ordinary identifier."""

    def __init__(self, found: np.ndarray, ordinary: np.ndarray):
        def logs(m: np.ndarray) -> np.ndarray:
            m = m[:, :-1] + 0.5
            return np.log(m / m.sum(axis=1, keepdims=True))

        self.ratio = logs(found + counts_of(random_strings(MADE_UP))) - logs(ordinary)
        self.known = bool(ordinary.sum())

    def __call__(self, token: str) -> float:
        codes = CODE[np.frombuffer(("\x7f" + token).encode("ascii"), np.uint8)]
        return float(self.ratio[codes[:-1], codes[1:]].sum())

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Tokens that look random, without what the patterns' spans (in order) have of them. One pass over both."""
        out, edges = [], []
        for a, _, b in taken:  # merged
            if edges and a <= edges[-1][1]:
                edges[-1] = (edges[-1][0], max(b, edges[-1][1]))
            else:
                edges.append((a, b))
        i = 0
        for m in TOKEN.finditer(text):
            while i < len(edges) and edges[i][1] <= m.start():
                i += 1
            at, k = m.start(), i
            while at < m.end():
                meets = k < len(edges) and edges[k][0] < m.end()
                stop = max(at, edges[k][0]) if meets else m.end()
                if stop - at >= LEAST_LENGTH and self.random(text[at:stop]):
                    out.append((at, 3, stop))
                at, k = (max(stop, edges[k][1]), k + 1) if meets else (stop, k)
        return out

    def random(self, token: str) -> bool:
        """If the log-likelihood ratio is high enough in all and for each character, higher where digits or letters are missing."""
        mixed = any(map(str.isdigit, token)) and any(map(str.isalpha, token))
        ratio = self(token)
        return ratio >= LEAST_TOTAL * (1 if mixed else UNMIXED) and ratio >= LEAST_EACH * (1 if mixed else UNMIXED) * len(token)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Models:
    """Models of about `sample` rows chosen by a hash: values of their base spans are labelled random, other tokens ordinary."""
    n = docs.count()
    chosen = docs.select("text").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET) + 1), np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in texts(part.column("text")).to_pylist():
                    spans = base_spans(text)
                    values = [WORDS.findall(text[a:b])[-1:] if kind == 0 else [text[a:b]] for a, kind, b in spans]
                    total[0] += counts_of([v for x in values for v in x if v.isascii()]) if values else 0
                    rest, at = [], 0
                    for a, _, b in spans:
                        rest.append(text[at : max(a, at)])
                        at = max(at, b)
                    total[1] += counts_of(WORDS.findall("\n".join([*rest, text[at:]])))
        k, a, b = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"k": k, "a": a, "b": b, "n": total[k, a, b]})

    total = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET) + 1), np.int64)
    for r in chosen.mapInArrow(count, "k long, a long, b long, n long").groupBy("k", "a", "b").agg(F.sum("n").alias("n")).collect():
        total[r["k"], r["a"], r["b"]] = r["n"]
    return Models(*total)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, counts of the kinds, base (the patterns' spans) and spans (with the models') of every row.

    Spans are kind:start:end in code points, by start, then kind. A null text is empty. Where nothing ordinary has been
    learned, the models add nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for part in slices(batch):
                text = texts(part.column("text"))
                may = np.stack([pc.match_substring_regex(text, x).to_numpy(zero_copy_only=False) for x in NEEDS], axis=1)
                base: list[list] = [[] for _ in range(len(text))]
                every: list[list] = [[] for _ in range(len(text))]
                for i in np.flatnonzero(may.any(axis=1)).tolist():
                    t = text[i].as_py()
                    base[i] = base_spans(t, tuple(may[i, :3]))
                    every[i] = sorted(base[i] + models.spans(t, base[i])) if may[i, 3] and models.known else base[i]
                n = [pa.array([sum(k == kind for _, k, _ in x) for x in every], pa.int64()) for kind in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *n, pa.array(map(named, base), pa.string()), pa.array(map(named, every), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base string, spans string")


def op7(docs: DataFrame) -> DataFrame:
    """Counts of kinds, base_sha256 and spans of every row; null and empty texts have none, repeated rows are alike, an empty table gives none."""
    return scan(docs, learn(docs)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_markov")
