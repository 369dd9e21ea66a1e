"""The pipeline's near duplicates: Jaccard similarity of five-word shingles, against all pairs in plain Python."""

import random
from collections import defaultdict

import brute
import pytest

DATA = "/root/testdata/sf0.001"


def similar(rows, k=5):
    sets = []
    for _, t in rows:
        words = brute.WORD.findall(brute.lower(t or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [] if d is None else [d]
    return [(d, min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def edited():
    """A text of 200 words, copies with one to twelve changed words, and copies of these."""
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(base))]
    for i in range(2, 120):
        words = list(r.choice([base, rows[-1][1].split()]))
        for at in r.sample(range(200), 1 + i % 12):
            words[at] = f"new{i}-{at}"
        rows.append((i, " ".join(words)))
    return rows + [(500, "a b c"), (501, "A  b c"), (502, "a b"), (503, None), (504, " ")]


@pytest.mark.parametrize("source", ["sf0.001", "odd", "edited", "empty"])
@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_similar(spark, monkeypatch, source, sent):
    from wirelake.llm import common, shingles

    monkeypatch.setattr(common, "SENT_ROWS", sent)
    if source == "sf0.001":
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
    else:
        rows = {"odd": [r[:2] for r in brute.odd_documents()], "edited": edited(), "empty": []}[source]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = similar([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, shingles.similar(docs).select("doc_id", "component_id").collect()), key=key) == sorted(want, key=key)


def test_fingerprints_propose_pairs_and_sets_decide(spark, monkeypatch):
    """Without any MinHash pair, copies whose five-word fingerprints are linked are still found; linked texts that are not similar stay apart."""
    from wirelake.llm import shingles

    base = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "changed"])), (3, " ".join(base[::-1])), (4, None), (5, "")]
    monkeypatch.setattr(shingles, "ROUNDS", 0)
    monkeypatch.setattr(shingles, "_met", lambda open_, *_: open_.select("node", "root").toDF("a", "b").limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in shingles.similar(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)]


def test_common_passages_in_unlike_texts_make_no_pairs(spark, monkeypatch):
    """Texts of one long passage and 24 own words (similarity 0.72 or so) meet in their prefixes, but no place where they meet first leaves enough to share."""
    from wirelake.llm import shingles

    passage, made, met = [f"p{i}" for i in range(150)], [], shingles._met
    rows = [(i, " ".join([*passage, *(f"own{i}-{j}" for j in range(24))])) for i in range(60)]

    def counted(open_, members, shingle):
        out = met(open_, members, shingle)
        made.append((open_.count(), out.count()))
        return out

    monkeypatch.setattr(shingles, "_met", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert all(r.doc_id == r.component_id for r in shingles.similar(docs).collect())
    assert made[0][1] == 0


def test_stage_drops_a_copy_with_one_changed_word(spark):
    import corpus_pipeline

    words = [f"w{i * i % 977}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:90], "changed", *words[91:]])), (3, " ".join(words[::-1]))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_keep_one_keeps_columns_of_any_names(spark):
    """Columns that clash with names used inside, rows that share a doc_id, rows without one."""
    from wirelake.llm import common, simhash

    rows = [(1, "a b c d", 9, {"k": 1}), (2, "a b c d", 8, None), (3, "x y z", 7, {}), (3, "p q r", 6, None), (3, "p q r", 5, None), (None, "a b c d", 4, None), (None, "own words here", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n int, at map<string,int>").withColumnRenamed("at", "component_id")
    for bound in (0, common.SENT_ROWS):
        common.SENT_ROWS, was = bound, common.SENT_ROWS
        got = simhash.keep_one(docs)
        common.SENT_ROWS = was
        assert got.columns == docs.columns
        found = [(r.doc_id, r.text) for r in got.collect()]
        assert sorted(d for d, _ in found if d) == [1, 3] and [t for d, t in found if d is None] == ["own words here"]


def test_components_of_few_links_need_no_shuffle(spark):
    """Steps on links that fit a partition are one task each; roots of roots and new links are those of all links."""
    from wirelake.llm import components, shingles

    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    edges = spark.createDataFrame([(max(p), min(p)) for p in pairs if p[0] != p[1]], "u long, v long").coalesce(1).checkpoint()
    for larger in (True, False):
        assert "Exchange" not in components._star(edges, larger, 1)._jdf.queryExecution().executedPlan().toString()
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    whole = {tuple(x) for x in components.components(frame(pairs)).collect()}
    assert {tuple(x) for x in shingles._joined(components.components(frame(pairs[:90])), frame(pairs[90:])).collect()} == whole
    root = list(range(300))
    for _ in pairs:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert whole == {(i, x) for i, x in enumerate(root) if i != x}
