"""Operators on conversations against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
DATA = "/root/testdata/sf0.001"


def odd_conversations():
    """Nulls in any column, ties and repeated rows, shared beginnings, copies, prefixes of others, faults of all kinds."""
    r, rows = random.Random(7), []
    roles, said = ["user", "assistant", "system", "tool", None, " "], ["Yes.", "No!", "", " \t", None, "Why?", "and then", "Stop. here", "é ", "a\x85"]
    for c in range(-12, 60):
        if c % 7 == 3:
            continue  # not every conversation to share with is there
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(roles[:2]) if r.random() < 0.7 else r.choice(roles), r.choice(said)))
    for c in range(100, 130):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{t} same.") for t in range(3 + c % 4)]
    rows += [(200, None, "user", "first."), (200, None, None, None), (200, 0, "user", "x."), (200, 0, "user", "x."), (200, 0, "assistant", "y."), (200, 5, "system", "late."), (201, 1, "user", "x" * 50_000)]
    rows += [(None, 0, "user", "lost"), (None, 1, "assistant", "lost too."), (203, 2**40, "user", "far."), (203, -(2**40), "user", "near.")]
    return rows + [(300, t, "user" if t % 2 == 0 else "assistant", f"long {t}.") for t in range(70)] + [(301 + i, t, "user" if t % 2 == 0 else "assistant", f"long {t}." if t < 40 + 5 * i else "other.") for i in range(4) for t in range(60)]


def grouped(rows, key):
    found = defaultdict(list)
    for c, t, role, text in rows:
        found[c].append((t, role, text))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, *key(r))) for c, x in found.items()}


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def op11(rows):
    full = [(c, t, role or "", text or "") for c, t, role, text in rows if c is not None]
    own = {c: [x[1:] for x in v] for c, v in grouped(full, lambda r: (r[1], sha(f"{len(r[1])}:{r[1]}{r[2]}"))).items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
        ends[seq].append(c)
    out = []
    children = defaultdict(list)
    for s in nodes:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s in sorted(nodes, key=len, reverse=True):
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + ((len(nodes[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    for s, members in nodes.items():
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children[s]), leaves[s], saved[s], sha(",".join(map(str, sorted(ends[s]))))))
    return out


@pytest.fixture(scope="module", params=["odd", "sf0.001", "empty"])
def case(request, spark):
    rows = {"odd": odd_conversations, "empty": list, "sf0.001": lambda: [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]}[request.param]()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("seq", "n", "strand", "depth", "base", "audit", "place"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(5).cache(), rows


def same(df, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_prefix_trie(case):
    """Against plain Python and its SQL."""
    import duckdb
    from wirelake.llm import trie

    df = trie.op11(case[0]).cache()
    same(df, op11(case[1]))
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", case[1]) if case[1] else None
    found = con.execute(trie.OP11_SQL)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    same(df.select(*names), found.fetchall())


def test_two_fattest_numbers(spark):
    from wirelake.llm import trie

    rows = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    for r in spark.createDataFrame(rows, "a int, b int").select("a", "b", trie.fattest("a", "b").alias("f")).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_long_random_sequences_in_a_trie(spark):
    """Many branches at all depths: handles at any depth, edges cut several times, several batches."""
    from wirelake.llm import trie

    r, rows = random.Random(11), []
    for i in range(90):
        rows.append((i, [(bytes([r.choice([1, 1, 1, 2])]), 1) for _ in range(r.randrange(0, 14))]))
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<digest:binary,bytes:bigint>>")
    got = {(x.conv_id, x.depth): (x.parent_conv_id, x.n_convs, x.n_leaves, x.saved_tokens) for x in trie.trie(df).collect()}
    members = defaultdict(list)
    for i, t in rows:
        for d in range(len(t) + 1):
            members[tuple(x[0] for x in t[:d])].append(i)
    leaf = {s for s in members if not any((*s, bytes([b])) in members for b in (1, 2))}
    want = {(min(m), len(s)): (min(members[s[:-1]]) if s else None, len(m), sum(x[: len(s)] == s for x in leaf), sum(len(n) - 1 for x, n in members.items() if x[: len(s)] == s and x)) for s, m in members.items()}
    assert got == want


WS = " \t\n\x0b\f\r"


def damaged(rows):
    out = {}
    for c, turns in grouped([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], lambda r: r[1:]).items():
        out[c] = []
        for t, role, text in turns:
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
            out[c] += [(t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def strings_cheapest(rows):
    """The same programme with whole strings."""
    moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def inserts(best):
        best = dict(best)
        for _ in range(3):
            for p, (c, s) in list(best.items()):
                to = 3 if p == 2 else 2
                best[to] = min(best.get(to, (c + 3, s + "I")), (c + 3, s + "I"))
        return best

    best = {0: (0, "")}
    for initial, must_go, truncated in rows:
        found = defaultdict(list)
        for p, (c, s) in inserts(best).items():
            found[p].append((c + 4, s + "D"))
            if not must_go:
                if p in moves.get(initial, {}):
                    found[moves[initial][p]].append((c + 3 * truncated, s + "K"))
                found[3 if p == 2 else 2].append((c + 3 + 3 * truncated, s + "R"))
        best = {p: min(x) for p, x in found.items()}
    best = inserts(best)
    return min(best[p] for p in (0, 3) if p in best)


def op12(rows):
    out, convs = [], damaged(rows)
    for c, turns in convs.items():
        seen, judged, n = set(), [], [0, 0, 0]
        for _, role, text in turns:
            body = text.strip(WS)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            judged.append((role[:1], fault in (0, 1), fault == 2))
        numbers = {t for t, _, _ in turns if t is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit = strings_cheapest(judged)
        i, last, fixed = 0, "", []
        for e in audit:
            if e in "RI":
                last = "a" if last == "u" else "u"
                fixed.append(f"{'assistant' if last == 'a' else 'user'}:{turns[i][2] if e == 'R' else ''}")
            elif e == "K":
                last = turns[i][1][0]
                fixed.append(f"{turns[i][1]}:{turns[i][2]}")
            i += e != "I"
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *n, illegal, cost, audit, sha("\n".join(fixed))))
    return out


def test_conversation_repair(case):
    from wirelake.llm import repair

    same(repair.op12(case[0]), op12(case[1]))


def test_conversation_repair_equals_its_sql(case):
    import duckdb
    from wirelake.llm import repair

    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", case[1]) if case[1] else None
    df = repair.op12(case[0])
    found = con.execute(repair.OP12_SQL)
    same(df.select(*(x[0] for x in found.description)), found.fetchall())


def odd_rows(r, n):
    return [(r.choice("suax "), r.random() < 0.2, r.random() < 0.3) for _ in range(n)]


def test_cheapest_edits_by_definition():
    from wirelake.llm import repair

    r = random.Random(13)
    for n in (0, 1, 1, 2, 2, 2, 2):
        for _ in range(12 if n < 2 else 6):
            rows = odd_rows(r, n)
            assert repair.cheapest(rows) == strings_cheapest(rows) == best_of_all(rows)


def best_of_all(rows):
    from itertools import product

    best = None
    for length in range(len(rows) * 2 + 4):
        for audit in product("DIKR", repeat=length):
            got = price(rows, audit)
            if got is not None and (best is None or (got, "".join(audit)) < best):
                best = got, "".join(audit)
    return best


def price(rows, audit):
    import re

    i, cost, roles = 0, 0, ""
    for e in audit:
        if e == "I":
            cost, roles = cost + 3, roles + ("a" if roles[-1:] == "u" else "u")
            continue
        if i == len(rows) or (e != "D" and rows[i][1]):
            return None
        cost += 4 if e == "D" else 3 * rows[i][2] + 3 * (e == "R")
        roles += "" if e == "D" else rows[i][0] if e == "K" else "a" if roles[-1:] == "u" else "u"
        i += 1
    return cost if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles) else None


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 1, 2, 97])
def test_edits_don_t_depend_on_hashes(modulus):
    from wirelake.llm import repair

    r = random.Random(modulus)
    for n in (3, 8, 30, 120):
        for _ in range(20):
            rows = odd_rows(r, n)
            assert repair.cheapest(rows, modulus) == strings_cheapest(rows)


def test_strings_of_edits():
    from wirelake.llm.repair import Edits

    r, edits, strings = random.Random(2), Edits(), [""]
    for _ in range(3000):
        node, e = r.randrange(max(0, len(strings) - 40), len(strings)), r.choice("DIKR")
        edits.grown(node, e)
        strings.append(strings[node] + e)
    for _ in range(5000):
        a, b = r.randrange(len(strings)), r.randrange(len(strings))
        assert edits.text(a) == strings[a] and edits.less(a, b) == (strings[a] < strings[b])
        assert edits.text(edits.cut(a, len(strings[a]) // 3)) == strings[a][: len(strings[a]) // 3]


def test_repaired_conversations_are_legal(spark):
    import re
    from wirelake.llm import repair

    df = spark.createDataFrame(odd_conversations(), SCHEMA)
    for r in repair.repaired(df).collect():
        assert re.fullmatch(r"(s?(ua)+)?", "".join(t.role[:1] for t in r.repaired))
        assert set(r.audit) <= {"K"} or r.cost > 0
