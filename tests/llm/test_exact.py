"""Operators whose results follow from their contract, against plain Python."""

import brute
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["odd", "sf0.001", "empty"])
def case(request, spark):
    """documents and benchmark, the former with extra columns of clashing names."""
    if request.param == "sf0.001":
        docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    else:
        rows = brute.odd_documents() if request.param == "odd" else []
        docs = spark.createDataFrame(rows, brute.DOCUMENTS)
        bench = spark.createDataFrame(brute.odd_benchmark() if rows else [], "item_id long, text string")
    for name in ("n_words", "key", "chunk", "fp", "size", "kept", "items", "removed", "component_id", "node", "h"):
        docs = docs.withColumn(name, F.lit("x"))
    docs = docs.repartition(5).cache()
    return docs, [(r.doc_id, r.text) for r in docs.collect()], bench, [tuple(r) for r in bench.select("item_id", "text").collect()]


def same(df, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_substring_dedup(case):
    from wirelake.llm import substring

    same(substring.op6(case[0]), brute.op6(case[1]))
    small = substring.repeated_windows(case[0], chunk_bytes=20_000, bucket_hashes=500)
    same(small.select("doc_id", "n_words", "n_removed", "kept_sha256"), brute.op6(case[1]))
    for width in (1, 2, 5):
        same(substring.repeated_windows(case[0], width, 50_000).select("doc_id", "n_words", "n_removed", "kept_sha256"), brute.op6(case[1], width))
    for r in small.collect():
        assert sum(x.stop - x.start for x in r.removed) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_near_duplicates(case):
    from wirelake.llm import simhash

    same(simhash.op8(case[0]), brute.op8(case[1]))


def test_decontamination(case):
    from wirelake.llm import decontaminate

    same(decontaminate.op10(case[0], case[2]), brute.op10(case[1], case[3]))
    blocks = decontaminate.find(case[0], case[2], block_bytes=200).select("doc_id", "n_words", F.size("items").alias("n"))
    same(blocks, [(d, n, k) for d, n, _, k, _, _ in brute.op10(case[1], case[3])])


def test_decontaminated_text_has_no_window(case):
    from wirelake.llm import decontaminate

    kept = decontaminate.find(case[0], case[2], clean=True)
    assert kept.columns == case[0].columns
    hits = {r[0] for r in brute.op10(case[1], case[3]) if r[5]}
    clean = lambda rows: sorted((d or 0, t or "") for d, t in rows if d not in hits)
    assert clean((r.doc_id, r.text) for r in kept.collect()) == clean(case[1])
    for r in kept.where(F.col("doc_id").isin([x for x in hits if x is not None])).collect():
        assert brute.BWORD.findall(brute.lower(r.text)) and len(r.text) < max(len(t) for d, t in case[1] if d == r.doc_id) and r.n_chars == len(r.text)


def test_decontaminated_text_is_the_same_in_blocks(case):
    from wirelake.llm import decontaminate

    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    rows = lambda size: sorted(map(tuple, decontaminate.find(case[0], case[2], block_bytes=size, clean=True).collect()), key=key)
    assert rows(200) == rows(1 << 20)


def test_windows_that_overlap_across_blocks_are_cut_out(spark):
    from wirelake.llm import decontaminate

    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(words[i : i + 12])) for i in range(5, 40, 3)], "item_id long, text string")
    joins = " ".join([*words[50:54], *words[5:17], *words[54:60]])  # no window of words 50 to 59 is here until words are cut out
    bench = bench.unionByName(spark.createDataFrame([(99, " ".join(words[50:60]))], bench.schema))
    docs = spark.createDataFrame([(1, " ".join(words)), (2, joins)], "doc_id long, text string")
    for size in (20, 200, 1 << 20):
        got = {r.doc_id: r.text.split() for r in decontaminate.find(docs, bench, block_bytes=size, clean=True).collect()}
        assert got == {1: words[:5], 2: words[50:60]}, size


def test_tokens(case):
    import public_tokenizers
    import tokenizers
    from wirelake.llm import tokens

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(case[0].select("doc_id", "n_chars", F.xxhash64("text"), "text").collect(), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
    same(tokens.op3(case[0]), brute.op3([(r.doc_id, r.text) for r in rows], lambda x: t.encode(x, add_special_tokens=False).ids))


def test_token_pages_are_read_selectively(spark, tmp_path):
    import pyarrow.parquet as pq
    import public_tokenizers
    from wirelake.llm import tokens

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shards=2)
    for f in (tmp_path / "tokens").glob("part-*"):
        columns = [pq.ParquetFile(f).metadata.row_group(0).column(i) for i in range(5)]
        assert all(c.has_column_index and c.has_offset_index for c in columns if c.path_in_schema == "doc_id")
        assert "RLE_DICTIONARY" in columns[4].encodings
    some = tokens.read_tokens(spark, path, 20, 29)
    assert sorted(r.doc_id for r in some.select("doc_id").collect()) == list(range(20, 30))
    everything = {r.doc_id: (r.start, r.tokens) for r in tokens.read_tokens(spark, path).collect()}
    assert all(everything[r.doc_id] == (r.start, r.tokens) for r in some.collect())


def test_line_dedup(case):
    from wirelake.llm import lines

    same(lines.op9(case[0]), brute.op9(case[1]))
    for most, segment, sent in ((2, 50, 16 << 20), (3, 1 << 21, 0), (10, 3, 0), (1, 1 << 21, 0)):
        got = lines.drop_lines(case[0], most, segment_lines=segment, sent_bytes=sent)
        same(got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)), brute.op9(case[1], most))


@pytest.mark.parametrize("sent", [0, 16 << 20])
def test_first_line_stays(spark, sent):
    from wirelake.llm import lines

    docs = spark.createDataFrame([(3, "a\nB \nc"), (1, " b\nx"), (2, "a\nb\na"), (None, "A")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in lines.drop_lines(docs, 2, keep_first=True, sent_bytes=sent).collect()}
    assert got == {1: " b\nx", 2: "a", 3: "c", None: ""}


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Targets by source: shares stop at cap times the size, the excess is dealt again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, excess, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while excess > 1e-9 and free:
        w, more = sum(weight[s] for s in free), 0.0
        for s in free:
            target[s] += excess * weight[s] / w
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                more += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
        excess = more
    return target


def test_mix(case):
    from wirelake.llm import mixing

    rows = mixing.op1(case[0]).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.op1(case[0].repartition(7)).collect()), key=repr)
    docs = [(r.doc_id, r.source, len(brute.WORD.findall(r.text or ""))) for r in case[0].select("doc_id", "source", "text").collect()]
    assert sorted(((r.doc_id, r["size"]) for r in rows), key=repr) == sorted(((d, n) for d, _, n in docs), key=repr)
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    want, source = shares(sizes), {(d, n): s for d, s, n in docs}
    taken = dict.fromkeys(want, 0)
    for r in rows:
        s = source[r.doc_id, r["size"]]
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        if len(rows) == 200 or (r.doc_id is not None and r.doc_id != 40):  # others share doc_id and size
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            taken[s] += r.taken
    if len(rows) == 200:  # ten documents to a source
        assert all(abs(want[s] - taken[s]) <= 0.02 * want[s] for s in want), {s: (want[s], taken[s]) for s in want}
    mixed = mixing.mixed(case[0])
    assert mixed.columns == case[0].columns
    assert mixed.count() == mixing.mix(case[0]).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]


def test_budget_fitting():
    import numpy as np
    from itertools import product
    from wirelake.llm import mixing

    r = np.random.default_rng(1)
    for _ in range(60):
        lengths, counts = np.unique(r.integers(1, 30, 4)), r.integers(0, 4, 4)
        counts = counts[: len(lengths)]
        for budget in r.integers(0, 120, 5).tolist():
            best = min((int(np.dot(k, lengths)) for k in product(*(range(c + 1) for c in counts))), key=lambda s: (abs(s - budget), s))
            take = mixing.knapsack(budget, lengths, counts)
            assert (take <= counts).all() and int(take @ lengths) == best
            take = mixing.fit(budget, lengths, counts, 20)
            assert (take <= counts).all() and 0 <= int(take @ lengths) <= max(budget, 0) + 30
    lengths = np.arange(1, 3000)
    take = mixing.fit(1_234_567, lengths, np.full(2999, 7))
    assert int(take @ lengths) == 1_234_567


def test_budget_of_long_documents():
    import numpy as np
    from wirelake.llm import mixing

    lengths, counts = 150_000 + 37 * np.arange(10), np.full(10, 3)
    take = mixing.fit(900_000, lengths, counts)
    assert (take <= counts).all() and abs(int(take @ lengths) - 900_000) <= 9_000
    assert int(mixing.fit(200_000, np.array([300_000]), np.array([3])) @ [300_000]) == 300_000


def test_lost_parts_are_spread_over_lengths():
    import numpy as np
    from wirelake.llm import mixing

    lengths, counts = np.arange(1000, 4000), np.full(3000, 3)
    take = mixing.fit(int(lengths.sum() * 3 // 5), lengths, counts)
    assert int(take @ lengths) == int(lengths.sum() * 3 // 5)
    for part in np.split(take, 6):
        assert 0.5 <= (part > 0).mean() <= 0.7
    assert (take > 1).mean() < 0.02


def test_mix_of_one_length_in_buckets(spark, monkeypatch):
    from wirelake.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET", 10)
    docs = spark.createDataFrame([(i, "two words", "ab"[i % 2 * (i < 300)]) for i in range(1000)], "doc_id long, text string, source string")
    rows = mixing.op1(docs).collect()
    assert sum(r.taken for r in rows) == pytest.approx(2000, abs=4)


def test_pieces_are_cut_as_the_tokenizer_cuts():
    import random

    import public_tokenizers
    import pyarrow as pa
    from wirelake.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = tokens.Encoder(path)
    r = random.Random(3)
    bits = [" ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "a", "don't", "we'll", "É", "é,", "×", "÷.", "²", "word", "Word,", "12", "3.5", "...", "(", ")", "'", "_", "#", "日本", "、", "́", "ß;", "<|endoftext|>", "\U0001f600", "İ", "\r\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(3000)]
    for part in (texts[:10], texts, texts[::-1]):
        ids, n = encode(pa.array(part, pa.string()))
        at = 0
        for t, k in zip(part, n.tolist(), strict=True):
            assert ids[at : at + k].tolist() == [*encode.tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)
            at += k
    tokens.KEPT_PIECES, kept = 50, tokens.KEPT_PIECES
    again, _ = encode(pa.array(texts[::-1], pa.string()))
    tokens.KEPT_PIECES = kept
    assert (again == ids).all()


def test_quality_rules(case):
    from wirelake.llm import quality_rules

    rows = quality_rules.rate(case[0]).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(((d, *brute.op2_base(t)) for d, t in case[1]), key=key)
    for r in rows:
        assert not (r.kept and r.base_failed) and r.n_good_lines <= r.n_lines and (r.n_good_lines > 0 or not r.kept)
    plan = quality_rules.op2(case[0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("line, good", [("A plain sentence of words.", True), ("Home | About | Contact", False), ("no end to this line", False), ("All rights reserved.", False), ("WORD!! WORD!! WORD!! AB!!", False), ("One sentence. " + "word " * 60, True)])
def test_line_rules(spark, line, good):
    from wirelake.llm import quality_rules

    r = quality_rules.rate(spark.createDataFrame([(1, f"{line}\n \n{line}")], "doc_id long, text string")).first()
    assert (r.n_lines, r.n_good_lines, r.clean_text) == (2, 2 * good, f"{line}\n{line}" * good)


def test_mixed_keeps_columns_of_any_names_and_splits_repeated_rows(spark):
    from wirelake.llm import mixing

    rows = [(1, "a b c", "x", 1, i % 2) for i in range(50)] + [(i, " ".join(["w"] * (i % 5 + 1)), "y", 2, 0) for i in range(60)] + [(None, None, None, None, 0), (1, "a b c", "y", 3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __at int, __copy int").withColumn("group_key", F.lit(1)).withColumn("copies", F.lit("c"))
    plan = mixing.mix(docs)
    assert plan.count() == len(rows)
    by = lambda df, n: {tuple(r)[:2]: r[2] for r in df.collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    taken = {k: n for k, n in by(plan.groupBy("doc_id", "size").agg(F.sum("copies")), 2).items() if n}
    assert {k: n for k, n in by(mixed.groupBy("doc_id", F.size(F.split("text", " ")).alias("size")).count(), 2).items() if k[0] is not None} == {k: n for k, n in taken.items() if k[0] is not None}
    assert max(r["count"] for r in mixed.groupBy(*docs.columns).count().collect() if r.doc_id != 1) <= 3
    sums = {r.source_size: (r.t, r.target) for r in plan.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(t - target) <= 2 for t, target in sums.values())


@pytest.mark.parametrize("short,long,budget", [(10, 1_000_000, 2_400_000), (10, 10_000_000, 24_000_000), (10, 30_000_000, 72_000_000), (7, 1_000_003, 1_234_567), (300, 2_000_000, 5_000_001), (1, 30_000_000, 29_999_999), (12, 5_000_000, 30_000_000)])
def test_few_long_documents_leave_room_for_short_ones(short, long, budget):
    """Two lengths against the best sum there is, for every number of long documents."""
    import numpy as np
    from wirelake.llm import mixing

    places = 900_000 if short < 100 else 30_000
    places *= max(1, budget // (short * places * 2))
    lengths, counts = np.array([short, long]), np.array([places, 3])
    take = mixing.fit(budget, lengths, counts)
    assert (take >= 0).all() and (take <= counts).all()
    best = min(abs(budget - j * long - min(places, max(0, round((budget - j * long) / short))) * short) for j in range(4))
    assert abs(int(take @ lengths) - budget) <= best + short


def test_knapsack_at_a_million_words_against_all_sums():
    import numpy as np
    from wirelake.llm import mixing

    r = np.random.default_rng(8)
    for _ in range(5):
        lengths = np.unique(np.concatenate([r.integers(1, 3000, 40), r.integers(50_000, 400_000, 6)]))
        counts = r.integers(1, 5, len(lengths)) * 3
        total = int(lengths @ counts)
        reached = 1
        for n, k in zip(lengths.tolist(), counts.tolist()):
            for _ in range(k):
                reached |= reached << n
        for budget in (1_000_000, total // 3, total - 777):
            best = next(d for d in range(total) if reached >> (budget - d) & 1 or reached >> (budget + d) & 1)
            take = mixing.fit(budget, lengths, counts)
            assert (take >= 0).all() and (take <= counts).all() and abs(int(take @ lengths) - budget) <= best + 20


def test_mixed_never_swaps_loses_or_multiplies_rows(spark):
    """Rows of one document that differ in a map, an array or a struct, and nulls beside one another."""
    from wirelake.llm import mixing

    rows = [(1, "same text here", "a", {"k": str(i)}, [i, None], (i, None)) for i in range(40)] + [(2, None, None, None, None, None), (2, None, "abc", {}, [], (1, "x")), (2, "abc", None, {}, [], (1, "x")), (2, "", "abc", {}, [], (1, "x")), (None, None, None, None, None, None)]
    rows += [(3, "twice the same", "b", {"x": "y"}, [1], (1, "y"))] * 2 + [(10 + i, "word " * (i + 1), "c", {}, [], None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,string>, l array<int>, s struct<a:int,b:string>").repartition(3)
    taken, plan, mixed = {}, mixing.mix(docs).collect(), [tuple(map(repr, r)) for r in mixing.mixed(docs).collect()]
    for r in plan:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    known = [tuple(map(repr, r)) for r in docs.collect()]
    assert set(mixed) <= set(known) and len(mixed) == sum(taken.values())
    for d, n in taken.items():
        assert sum(r[0] == repr(d) for r in mixed) == n
    same = [mixed.count(r) for r in set(known) if r[0] == "1"]
    assert max(same) - min(same) <= 1 and sum(same) == taken[1]
