"""SentencePiece ids and texts against the library."""

import random
from itertools import product

import brute
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    from wirelake.llm.pieces import Pieces

    return Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(model, library, texts):
    ids, counts = model.encode(pa.array(texts, pa.string()))
    at, found = 0, []
    for n in counts.tolist():
        found.append(ids[at : at + n].tolist())
        at += n
    assert found == library.encode(texts)
    assert [t.decode() for t in model.decode(ids, counts)] == [library.decode(x) for x in found]


def test_texts_of_pieces_and_odd_characters(model, library):
    r = random.Random(3)
    pieces, odd = list(model.id), ["a", "e", " ", "  ", "\n", "▁", "é", "ﷺ", "\U0001f600", "　", "=", "==", "\0", "ing", "中", "\r", "​"]
    check(model, library, ["".join(r.choice(pieces) for _ in range(r.randrange(9))) for _ in range(5000)])
    check(model, library, ["".join(r.choice(odd) for _ in range(r.randrange(60))) for _ in range(5000)])
    check(model, library, ["", " ", "x" * 30_000, " " * 3_000, "=-" * 5_000, "</s><s><unk> <0x41>", "naïve  \t café", *(b for _, t, *_ in brute.odd_documents() if (b := t))])
    check(model, library, ["".join(x) for n in range(1, 6) for x in product("a e", repeat=n)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(texts):
    import sentencepiece

    from wirelake.llm.pieces import pieces

    check(pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), texts)


def test_pieces_stay_apart_as_plain_merging_says(model):
    r, ids = random.Random(4), list(model.id.values())
    for _ in range(20_000):
        a, b = r.choice(ids), r.choice(ids)
        assert model.compatible(a, b) == ([i for _, i in model.merged(model.text[a] + model.text[b])] == [a, b])


def test_texts_are_cut_in_blocks(model, library, monkeypatch):
    from wirelake.llm import pieces

    monkeypatch.setattr(pieces, "BLOCK", 7)
    check(model, library, ["a café of naïve 中文 people  here", "", "éééé  \U0001f600\U0001f600 a", " b"])


def test_parts_are_forgotten(library, monkeypatch):
    from wirelake.llm import pieces

    monkeypatch.setattr(pieces, "KEPT_PARTS", 3)
    model = pieces.Pieces(PATH)
    for t in ("one two three four five", "six seven eight one two", "one nine ten"):
        check(model, library, [t, t + t])
    assert len(model.known) + len(model.before) < 20


def test_any_ids_are_decoded(model, library):
    import numpy as np

    r = random.Random(5)
    ids = [[r.randrange(32_000) if r.random() < 0.5 else r.randrange(3, 260) for _ in range(r.randrange(12))] for _ in range(5000)] + [[1, 2, 28705, 5], [1, 28705], [0, 0]]
    found = model.decode(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids]))
    assert [t.decode() for t in found] == [library.decode(x) for x in ids]


@pytest.mark.parametrize("rows", [brute.odd_documents(), []])
def test_query_and_frames(spark, library, rows):
    from pyspark.sql import functions as F

    from wirelake.llm import pieces

    docs = spark.createDataFrame(rows, brute.DOCUMENTS).withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(1)).repartition(3)
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, pieces.op13(docs).collect()), key=key) == sorted(want, key=key)
    back = pieces.decoded(pieces.encoded(docs, PATH), PATH).collect()
    texts = lambda x: sorted((-1 if d is None else d, t) for d, t in x)
    assert texts((r.doc_id, r.text) for r in back) == texts((d, library.decode(library.encode(t or ""))) for d, t, *_ in rows)


def test_models_that_normalise_are_refused(monkeypatch):
    from wirelake.llm import pieces

    monkeypatch.setattr(pieces, "PROBE", "another text")  # as if the model had changed it
    with pytest.raises(ValueError, match="normalises"):
        pieces.Pieces(PATH)
