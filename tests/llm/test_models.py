"""Operators that learn: held-out accuracy, edge cases, agreement of reruns."""

import brute
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(brute.odd_documents(), brute.DOCUMENTS)
    for name in ("n_words", "score", "kept", "held_out", "lang_pred", "predicted", "spans"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3).cache()


def test_language(spark, docs, odd):
    from wirelake.llm import language

    rows = language.op4(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (brute.zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    out = language.op4(odd).collect()
    assert len(out) == odd.count() and {r.lang_pred for r in out} <= {"en", "de", "fr", "und"}
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {r[0] for r in brute.odd_documents() if not any(map(str.isalpha, r[1] or ""))}
    empty = language.op4(odd.limit(0))
    assert empty.collect() == []
    alone = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.op4(alone).collect()} == {"und"}
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()


def test_unseen_words_are_read_by_ngrams():
    from wirelake.llm.language import Model

    m = Model([("aa", "banana", 5), ("bb", "wollen", 5)])
    assert m.word("bananas")[0] > m.word("bananas")[1] and m.word("wolle")[1] > m.word("wolle")[0]
    assert not m.word("ζζ")[:].any() or m.word("ζζ")[0] == m.word("ζζ")[1]


def test_quality(spark, docs, odd):
    from wirelake.llm import quality_crf

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality_crf.op5(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) > 0.95 * len(good) * len(bad)
    assert sum(r.predicted == r.quality for r in held) > 0.93 * len(held)
    again = {r.doc_id: r.score for r in quality_crf.op5(docs.repartition(9), labels.repartition(3)).collect()}
    assert all(r.score == pytest.approx(again[r.doc_id], abs=1e-9) for r in rows)
    few = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 1), (43, 0, 0), (44, 0, 0), (None, 1, 1), (9, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (few, few.limit(0)):
        out = quality_crf.op5(odd, some).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_crf.op5(odd.limit(0), few).collect() == []


def test_forward_backward():
    from itertools import product

    import numpy as np
    from wirelake.llm.quality_crf import marginals

    r = np.random.default_rng(0)
    counts = np.array([1, 4, 2, 0, 3])
    unary, step = r.normal(size=(10, 2)), r.normal(size=(2, 2))
    p, expected = marginals(unary, step, counts[counts > 0])
    at, want, steps = 0, np.zeros((10, 2)), np.zeros((2, 2))
    for n in counts[counts > 0]:
        weights = {y: np.exp(sum(unary[at + i, s] for i, s in enumerate(y)) + sum(step[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        for y, w in weights.items():
            for i, s in enumerate(y):
                want[at + i, s] += w / z
            for a, b in zip(y, y[1:]):
                steps[a, b] += w / z
        at += n
    assert np.allclose(p, want) and np.allclose(expected, steps)


def test_secrets(spark, docs, odd):
    from wirelake.llm import secrets

    for df in (docs, odd, odd.limit(0)):
        rows = secrets.op7(df).collect()
        text = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
        want = sorted((repr(d), *brute.op7_base(t)[0], brute.sha(brute.op7_base(t)[1])) for d, t in text)
        assert sorted({(repr(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows}) == sorted(set(want))
        assert len(rows) == df.count()
        by = {d: t for d, t in text}
        for r in rows:
            spans = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
            assert spans == sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[1]))) and all(0 <= a < b <= len(by[r.doc_id] or "") for a, _, b in spans)
            base = ",".join(f"{k}:{a}:{b}" for a, k, b in spans if k != "markov")
            assert brute.sha(base) == r.base_sha256
    found = sum(r.n_markov > 0 for r in secrets.op7(docs).collect())
    assert found < 0.02 * docs.count()


def test_random_strings_are_told_from_words(spark):
    from wirelake.llm import secrets

    import random

    r = random.Random(1)
    words = ["configuration_value", "internationalization2", "read_the_first_line_4", "https-gateway-server-01", "transformation/of/data1"]
    docs = spark.createDataFrame([(i, " ".join(r.choices("the quick value of configuration first server data line gateway and transformation read international".split(), k=60))) for i in range(300)], "doc_id long, text string")
    models = secrets.learn(docs)
    keys = secrets.random_strings(200, seed=99)
    assert sum(bool(models.spans(f"x {k} y", [])) for k in keys) > 180
    assert not any(models.spans(w, []) for w in words)


def plain_language_scores(rows, texts, each, n_grams, longest=4, smooth=0.5):
    """Language and share of evidence of texts by the model of rows (text, lang), in plain Python."""
    import math
    import re
    from collections import Counter

    def words_of(text):
        runs = re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
        return [x for w in runs for x in ([w] if w.isalpha() else re.findall(r"[^\W\d_]+", w)) if any(map(str.isalpha, x))]

    langs = sorted({lang for _, lang in rows})
    counts = {lang: Counter(w for t, x in rows if x == lang for w in words_of(t)) for lang in langs}
    counts = {lang: dict(sorted(c.items(), key=lambda i: (-i[1], i[0]))[:each]) for lang, c in counts.items()}
    tables = [counts]
    for k in range(1, longest + 1):
        grams = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, n in counts[lang].items():
                for i in range(len(w) + 3 - k):
                    grams[lang][f"<{w}>"[i : i + k]] += n
        total = sum(grams.values(), Counter())
        top = set(sorted(total, key=lambda g: (-total[g], g))[:n_grams])
        tables.append({lang: {g: n for g, n in grams[lang].items() if g in top} for lang in langs})
    keys = [set().union(*t.values()) for t in tables]
    log = lambda t, lang, x: math.log((tables[t][lang].get(x, 0) + smooth) / (sum(tables[t][lang].values()) + smooth * len(keys[t])))
    out = []
    for text in texts:
        words, sums = words_of(text), dict.fromkeys(langs, 0.0)
        for w in words:
            if w in keys[0]:
                for lang in langs:
                    sums[lang] += log(0, lang, w)
                continue
            padded, i = f"<{w}>", 0
            while i < len(padded):
                k = next((k for k in range(min(longest, len(padded) - i), 0, -1) if padded[i : i + k] in keys[k]), 0)
                for lang in langs if k else ():
                    sums[lang] += log(k, lang, padded[i : i + k])
                i += max(k, 1)
        z = {lang: x / math.sqrt(max(len(words), 1)) for lang, x in sums.items()}
        e = {lang: math.exp(x - max(z.values())) for lang, x in z.items()}
        best = max(langs, key=lambda x: e[x])
        out.append((best, e[best] / sum(e.values())) if words else ("und", 0.0))
    return out


def test_language_by_plain_python(spark, monkeypatch):
    """Scores of seen and unseen words, against a plain version; 260 languages are all learned."""
    import zlib

    from wirelake.llm import language

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    learned = [(r.text, r.lang) for r in rows if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    monkeypatch.setattr(language, "GRAMS", 300)
    monkeypatch.setattr(language, "WORDS", 100)
    monkeypatch.setattr(language, "LEAST_WORDS", 40)
    got = {r.doc_id: r for r in language.op4(docs).collect()}
    want = plain_language_scores(learned, [r.text for r in rows], 40, 300)
    for r, (lang, score) in zip(rows, want, strict=True):
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-3)
        assert got[r.doc_id].lang_pred == lang or score < 0.6
    many = spark.createDataFrame([(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x letters", f"l{i % 260}") for i in range(1040)], "doc_id long, text string, lang string")
    assert len(language.trained(many).languages) == 260
    none = many.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert language.keep_known(none).count() == 1040 and {r.lang_pred for r in language.op4(none).collect()} == {"und"}


def test_secrets_of_another_generator_are_found_in_documents(spark, docs):
    """Digests and random bytes in usual codes, planted in documents; documents without any secret get no added span."""
    import base64
    import hashlib

    from wirelake.llm import secrets

    models = secrets.learn(docs)
    rows = [r for r in docs.select("doc_id", "text").where("text is not null").orderBy("doc_id").limit(600).collect() if len(r.text) > 40]
    planted = []
    for i, r in enumerate(rows):
        raw = hashlib.sha512(f"seed {i}".encode()).digest()
        n = 12 + i % 28
        token = [raw[:n].hex().upper(), base64.b64encode(raw[:n]).decode().rstrip("="), base64.urlsafe_b64encode(raw[:n]).decode().rstrip("="), base64.b32encode(raw[:20]).decode(), "gh_" + base64.b64encode(raw).decode().replace("+", "").replace("/", "")[:36]][i % 5]
        at = r.text.find(" ", len(r.text) // 2) + 1 or len(r.text)
        head = r.text[:at] if r.text[:at].endswith(" ") else r.text[:at] + " "
        planted.append((r.doc_id, f"{head}{token} {r.text[at:]}", len(head), len(head) + len(token)))
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(planted, "doc_id long, text string, a int, b int"), models).collect()}

    def covered(spans, a, b):
        return sum(max(0, min(int(y), b) - max(int(x), a)) for _, x, y in (s.split(":") for s in spans.split(",") if s)) >= 0.9 * (b - a)

    assert sum(covered(got[d], a, b) for d, _, a, b in planted) >= 0.95 * len(planted)
    clean = secrets.scan(docs.select("doc_id", "text"), models)
    assert clean.where("n_assign + n_access + n_hex = 0 and n_markov > 0").count() <= 0.002 * clean.count()


def test_markov_spans_are_linear_and_leave_base_spans_alone(spark, docs):
    from wirelake.llm import secrets

    models = secrets.learn(docs)
    text = "Zq8vT3xLw9Rk2mYp7NcB" + "deadbeef" * 4 + "Hs5Jd1fGa0Ue6WtKx4Vb" + " token: abcdef " * 20_000
    base = secrets.base_spans(text)
    found = models.spans(text, base)
    assert all(not (a < y and x < b) for a, _, b in found for x, _, y in base[:3])
    assert {text[a:b] for a, _, b in found} >= {"Hs5Jd1fGa0Ue6WtKx4Vb"}
