"""SentencePiece BPE encoding and decoding by backtracking.

A sequence of pieces is the merge result of a text exactly if each piece is the merge result of its own characters and
each two neighbours stay apart when they are merged again. So a text is encoded from the left: the longest piece that
starts at a place (one Aho-Corasick pass over the text from its end finds it for all places) is tried first, then
shorter ones, until one is compatible with the piece before; where none is, the place is marked as failed in a
bitfield and the piece before is shortened. Each place fails once at most, so the work is linear in the text.

Texts are cut where no piece of the vocabulary has the two characters next to each other, and each distinct part is
encoded once. The library's own file gives the vocabulary; the library isn't used to encode or decode.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import plain, slices, starts_of, texts

#: The library's sign for a space; bytes of characters that the vocabulary lacks are pieces of their own.
SPACE = "▁"
#: Distinct parts whose ids a Python worker keeps; characters that are looked at together; bytes of text at a time.
KEPT_PARTS, BLOCK, TEXT_BYTES = 250_000, 1 << 20, 2 << 20
#: Shows whether a model changes characters or white space before it encodes.
PROBE, PROBED = "ﬁ  ①　 a\t ", "▁ﬁ▁▁①　▁a\t▁"


class Pieces:
    """Ids of texts and texts of ids, as the sentencepiece library has them for a BPE model with byte pieces, no normalisation, and a space before the text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != PROBED:
            raise ValueError(f"{path} normalises texts in a way that isn't supported")
        every = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError(f"{path} has no piece for each byte")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in every if model.is_control(i)}
        self.unknown = model.unk_id()
        self.text = [model.id_to_piece(i) for i in every]
        self.id = {self.text[i]: i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        if any(c not in self.id for c in set("".join(self.id))):
            raise ValueError(f"{path} has pieces of characters that are no pieces")
        self.length = [len(t) for t in self.text]
        #: When a piece is merged: the higher its score the sooner, equal scores from the left. Characters are there from the start.
        self.order = {i: -model.get_score(i) if len(t) > 1 else float("-inf") for t, i in self.id.items()}
        self.rising: list[list[tuple[float, int]] | None] = [None] * len(self.text)  # merges at the piece's right end, the last one last
        self.falling: list[list[tuple[float, int]] | None] = [None] * len(self.text)  # and at its left end
        for t, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            self._split(t, i)
        reached = {t: i for t, i in self.id.items() if self.rising[i]}  # others never come out
        self.shorter = [-1] * len(self.text)
        self.longest = ahocorasick.Automaton()
        for t, i in reached.items():
            self.longest.add_word(t[::-1], i)
            self.shorter[i] = next((reached[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in reached), -1)
        self.longest.make_automaton()
        self.reached = reached
        self._neighbours()
        self._surfaces()
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, text: str) -> list[tuple[float, int]]:
        """Plain merging: the pieces of a short text with the order of the last merge that made each; nothing if merges don't come in order."""
        parts, last = [(self.order[self.id[c]], self.id[c]) for c in text], float("-inf")
        while True:
            pairs = [(self.order[m], k, m) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (m := self.id.get(self.text[a[1]] + self.text[b[1]])) is not None]
            if not pairs:
                return parts
            order, k, m = min(pairs)
            if order < last:
                raise ValueError("the model's merges don't come in the order of their scores")
            last = order
            parts[k : k + 2] = [(order, m)]

    def _split(self, text: str, i: int) -> None:
        """Which pieces stand at the right and left end of a piece while its characters are merged; none if they are not merged to it."""
        right, left = [], []
        parts, last = [self.id[c] for c in text], float("-inf")
        right.append((float("-inf"), parts[-1]))
        left.append((float("-inf"), parts[0]))
        while len(parts) > 1:
            pairs = [(self.order[m], k, m) for k in range(len(parts) - 1) if (m := self.id.get(self.text[parts[k]] + self.text[parts[k + 1]])) is not None]
            if not pairs:
                return
            order, k, m = min(pairs)
            if order < last:
                raise ValueError("the model's merges don't come in the order of their scores")
            last = order
            if k == len(parts) - 2:
                right.append((order, m))
            if k == 0:
                left.append((order, m))
            parts[k : k + 2] = [m]
        if parts == [i]:
            self.rising[i], self.falling[i] = right, left

    def compatible(self, a: int, b: int) -> bool:
        """Whether two pieces stay apart if their characters are merged again: no merge over the border comes before the next one on either side."""
        right, left, i, j, never = self.rising[a], self.falling[b], 0, 0, float("inf")
        stays = True
        while stays:
            over = self.id.get(self.text[right[i][1]] + self.text[left[j][1]])
            next_a = right[i + 1][0] if i + 1 < len(right) else never
            next_b = left[j + 1][0] if j + 1 < len(left) else never
            if over is not None and self.order[over] < next_a and self.order[over] <= next_b:  # of equal ones the left one is first
                stays = False
            elif next_a == next_b == never:
                break
            elif next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self.apart) > 2 * KEPT_PARTS:
            self.apart.clear()
        self.apart[a << 32 | b] = stays
        return stays

    def part(self, text: str) -> list[int]:
        """Ids of a text without cuts: a character that the vocabulary lacks, or characters that it has."""
        if text in self.reached:
            return [self.reached[text]]
        if len(text) == 1:
            return [self.bytes[b] for b in text.encode()]
        n, longest = len(text), [-1] * len(text)
        length, shorter, apart, compatible = self.length, self.shorter, self.apart, self.compatible
        for end, i in self.longest.iter(text[::-1]):
            if longest[~end] < 0 or length[i] > length[longest[~end]]:
                longest[~end] = i
        failed, found, at, i, last = bytearray(n // 8 + 1), [], 0, longest[0], -1
        while at < n:
            while i >= 0:
                end = at + length[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    stays = apart.get(last << 32 | i)
                    if compatible(last, i) if stays is None else stays:
                        break
                i = shorter[i]
            if i >= 0:
                found.append(i)
                at, last = end, i
                i = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= length[found.pop()]
                i, last = shorter[last], found[-1] if found else -1
        return found

    def _neighbours(self) -> None:
        """Numbers of the vocabulary's characters, and which ones a piece has next to each other."""
        alphabet = sorted({c for t in self.reached for c in t})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        self.beside = np.zeros(self.width * self.width, bool)
        pairs = {(a, b) for t in self.reached for a, b in zip(t, t[1:], strict=False)}
        number = self.number.astype(np.int64)
        self.beside[[number[ord(a)] * self.width + number[ord(b)] for a, b in pairs]] = True

    def cuts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Places in the bytes of texts where a part begins."""
        begins, last, at = np.zeros(len(data) + 1, bool), 0, 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            block = data[at:end]
            points = self.number[np.frombuffer(block.tobytes().decode().encode("utf-32-le"), np.uint32)]
            pairs = points.astype(np.int32)
            pairs[1:] += self.width * points[:-1].astype(np.int32)
            pairs[0] += self.width * last
            begins[at:end][block & 0xC0 != 0x80] = ~self.beside[pairs]
            last, at = int(points[-1]), end
        begins[offsets[:-1]] = True
        return np.flatnonzero(begins[:-1])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        text = pc.replace_substring(text, " ", SPACE)
        text = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(SPACE, text, ""))
        offsets, data = plain(text)
        offsets, data = offsets.astype(np.int64), data[: offsets[-1]]
        cuts = self.cuts(offsets, data)
        parts = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        if len(self.known) > KEPT_PARTS:  # those met since the last time stay
            self.before, self.known = self.known, {}
        known, before, ids = self.known, self.before, []
        for p in parts.dictionary.to_pylist():
            of = known.get(p)
            if of is None:
                of = known[p] = before.get(p) or array("i", self.part(p)).tobytes()
            ids.append(of)
        # Arrow puts the ids of all parts in a row.
        laid = pa.array(ids, pa.binary()).take(parts.indices)
        ends = np.append(0, np.cumsum(pc.binary_length(laid).to_numpy(zero_copy_only=False) // 4, dtype=np.int64))
        flat = plain(laid)[1].view(np.int32) if len(laid) else np.zeros(0, np.int32)
        return flat[: ends[-1]], np.diff(ends[np.searchsorted(np.append(cuts, len(data)), offsets)])

    def _surfaces(self) -> None:
        """The bytes that an id stands for, and its decimal digits."""
        byte = self.byte_of
        self.surface = pa.array([bytes([byte[i]]) if i in byte else b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)], pa.binary())
        self.digits = pa.array(map(str, range(len(self.text))), pa.string())

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 texts of ids. One space at a text's start is the one that encoding put there; bytes that are no character become U+FFFD, each."""
        laid = self.surface.take(pa.array(ids))
        ends = np.append(0, np.cumsum(pc.binary_length(laid).to_numpy(zero_copy_only=False), dtype=np.int64))
        data = plain(laid)[1][: ends[-1]].tobytes()
        place, out = np.append(0, np.cumsum(counts, dtype=np.int64)), []
        for a, b in zip(place.tolist(), place[1:].tolist(), strict=False):
            while a < b and int(ids[a]) in self.control:
                a += 1
            text = data[ends[a] : ends[b]]
            if a < b and self.text[ids[a]].startswith(SPACE):
                text = text[1:]
            out.append(text if _valid(text) else self._repaired(ids[a:b]))
        return out

    def _repaired(self, ids: np.ndarray) -> bytes:
        """A text in which bytes make no characters: each run of byte pieces by itself."""
        out, run, surface = [], bytearray(), self.surface
        for k, i in enumerate([*ids.tolist(), None]):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                width = next((w for w in range(1, min(4, len(run)) + 1) if _valid(bytes(run[:w]))), 0)
                out.append(bytes(run[:width]) if width else "�".encode())
                del run[: max(width, 1)]
            if i is not None:
                t = surface[i].as_py()
                out.append(t[1:] if not k and self.text[i].startswith(SPACE) else t)
        return b"".join(out)


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's model, kept from task to task."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _ids_array(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null text is empty and has none. No shuffle; a row stays where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _ids_array(*pieces(model).encode(texts(part.column("text"))))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; no ids (or null) give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            text = pieces(model).decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in text], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op13(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: texts are encoded, and what is decoded again from the ids is hashed.

    A null or empty text has no ids. Every row is a document of its own, rows without a doc_id and repeated ones too; extra columns don't
    matter; an empty table gives none. A text of any length is encoded whole.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = pieces(model)
        for batch in batches:
            for part in slices(batch, budget=TEXT_BYTES):
                ids, n = by.encode(texts(part.column("text")))
                listed = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts_of(n), n.sum()).astype(np.int32)), by.digits.take(pa.array(ids))), ",")
                digests = [[hashlib.sha256(t).hexdigest() for t in column] for column in (map(bytes, _buffers(listed)), by.decode(ids, n))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(x, pa.string()) for x in digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _buffers(text: pa.Array) -> Iterator[memoryview]:
    offsets, data = plain(text)
    raw = memoryview(data)
    return (raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
