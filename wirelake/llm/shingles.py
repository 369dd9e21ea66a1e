"""Near-duplicates by the Jaccard similarity of word shingles, verified exactly.

Equal shingle sets are one node. Nodes whose SimHash fingerprints over the same shingles are linked by the keys of simhash.py (a
segment and a Golay codeword near the next) are compared first, which finds the nearest copies; at similarity 0.8 fingerprints
differ in some 10 bits, which no such keys reach, so bands of MinHashes find the others. Nodes that share no band of MinHashes with another one are alone: at similarity 0.8 a
pair is missed with probability (1 - 0.8^4)^32, about 5e-8. In a few rounds each of the others is compared with a few nodes of
other components, one a band, which joins groups of copies by few pairs a node. What is still
in bands of several components is compared where prefixes of the shingle sets meet: sets of similarity 0.8 or more always
share one of their rarest fifth, so a passage that many documents share makes no pairs of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, parts_of, sent, slices, starts_of, texts
from .components import components
from .simhash import fingerprints_of, shingle_hashes
from .simhash import links as fingerprint_links

SHINGLE, BANDS, BAND = 5, 32, 4
#: A pair is similar where the intersection is NUMERATOR / DENOMINATOR of the union or more.
NUMERATOR, DENOMINATOR = 4, 5
#: Rounds before the comparison of prefixes, and pairs of a node in each. They save pairs; the result is the same with any number.
ROUNDS, FEW = 4, 3
#: Nodes up to which a shingle counts as rare; commoner ones come last in a prefix, by how many nodes have them.
RARE = 20
#: Text of a slice of rows, which is small for the sake of many hashes; parts that the pairs of one text are dealt to.
SLICE, SLOTS = 2 << 20, 64
#: Pairs of texts of a partition.
PAIRS_A_PART = 500


def bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys of each row's bands of MinHashes, rows of BANDS."""
    factors = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND, np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
    starts, out = starts_of(n), np.zeros((len(n), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(n), b, np.uint64)
        for f in factors[b * BAND : (b + 1) * BAND]:
            key = (key ^ np.minimum.reduceat(h * f, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def sets(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(n) else []


def _nodes(shingle: int):
    """The rows' nodes, SimHash fingerprints and bands; a text without words is node 0 and has none."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=SLICE):
                rows, n, h = shingle_hashes(texts(part.column("text")), shingle)
                node, sizes = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                node[rows] = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets(h, n)], np.uint64).view(np.int64)
                sizes[rows] = BANDS
                values = bands(h, n).ravel() if len(rows) else np.zeros(0, np.uint64)
                fp = fingerprints_of(part.num_rows, rows, n, h)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("at"), pa.array(node), pa.array(fp.view(np.int64)), lists], ["doc_id", "at", "node", "fp", "bands"])

    return run


def _similar(shingle: int):
    """Of pairs with both texts (x and y) those that are similar. Rows of one a are neighbours, so that its set is made once a slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "y", SLICE):
                both = pa.concat_arrays([part.column("a"), part.column("b")])
                text = pa.concat_arrays([texts(part.column("x")), texts(part.column("y"))])
                nodes, first, place = np.unique(both.to_numpy(), return_index=True, return_inverse=True)
                rows, n, h = shingle_hashes(text.take(pa.array(first)), shingle)
                each = [np.zeros(0, np.uint64)] * len(nodes)
                for r, x in zip(rows.tolist(), sets(h, n), strict=True):
                    each[r] = x
                ok = []
                for i, j in zip(place[: len(part)].tolist(), place[len(part) :].tolist(), strict=True):
                    common = len(np.intersect1d(each[i], each[j], assume_unique=True))
                    ok.append(common * (NUMERATOR + DENOMINATOR) >= (len(each[i]) + len(each[j])) * NUMERATOR)
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(pairs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """Similar ones of kept, distinct pairs (a, b). A text in many pairs is dealt to SLOTS parts; members stay where they are unless there are many pairs."""
    parts = parts_of(pairs.count(), PAIRS_A_PART)
    pairs = pairs.withColumn("slot", F.pmod(F.xxhash64("b"), F.lit(SLOTS)))
    x = members.select(F.col("node").alias("a"), F.col("text").alias("x")).join(sent(pairs.select("a", "slot").distinct()), "a")
    y = members.select(F.col("node").alias("b"), F.col("text").alias("y")).join(sent(pairs), "b")
    return checkpoint(y.join(x, ["a", "slot"]).select("a", "b", "x", "y").coalesce(parts).mapInArrow(_similar(shingle), "a long, b long"))


def _sets(shingle: int):
    """Shingle sets of nodes, sorted hashes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=SLICE):
                rows, n, h = shingle_hashes(texts(part.column("text")), shingle)
                each = sets(h, n)
                sizes = np.zeros(part.num_rows, np.int64)
                sizes[rows] = [len(x) for x in each]
                values = np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))], ["node", "grams"])

    return run


def _prefixes(batches):
    """The rarest shingles of each set, as many as leave fewer than NUMERATOR / DENOMINATOR of it. common and times are its common shingles and their nodes."""
    for batch in batches:
        out = []
        for node, root, grams, common, times in zip(*[batch.column(c) for c in ("node", "root", "grams", "common", "times")], strict=True):
            g = grams.values.to_numpy()
            key = np.zeros(len(g), np.int64)
            if common.is_valid:
                key[np.searchsorted(g.view(np.uint64), common.values.to_numpy().view(np.uint64))] = times.values.to_numpy()
            first = np.lexsort((g, key))[: len(g) + (-len(g) * NUMERATOR) // DENOMINATOR + 1]
            out.append((node.as_py(), root.as_py(), len(g), g[first]))
        lens = [len(x[3]) for x in out]
        cols = [np.repeat(np.array([x[i] for x in out], np.int64), lens) for i in range(3)]
        gram, place = np.concatenate([x[3] for x in out] or [np.zeros(0, np.int64)]), np.concatenate([np.arange(k) for k in lens] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(gram), pa.array(place)], ["node", "root", "n", "gram", "place"])


def _met(open_: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of several roots whose sizes and prefixes allow the similarity.

    Prefixes are in one order, so all that two sets share up to the last place where they meet is known, and what comes after is bounded by the rest.
    """
    grams = checkpoint(members.join(sent(open_.select("node")), "node").mapInArrow(_sets(shingle), "node long, grams array<long>"))
    each = grams.select("node", F.explode("grams").alias("gram"))
    common = checkpoint(each.groupBy("gram").agg(F.count("*").alias("times")).where(F.col("times") > RARE))
    of_node = each.join(sent(common), "gram").groupBy("node").agg(F.collect_list(F.struct("gram", "times")).alias("c")).select("node", F.col("c.gram").alias("common"), F.col("c.times").alias("times"))
    with_small = grams.join(open_, "node").join(of_node, "node", "left").select("node", "root", "grams", "common", "times")
    prefix = checkpoint(with_small.mapInArrow(_prefixes, "node long, root long, n long, gram long, place long"))
    several = checkpoint(prefix.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("gram"))
    kept = checkpoint(prefix.join(sent(several), "gram"))
    a, b = kept.alias("a"), kept.alias("b")
    ok = f"a.gram = b.gram and a.node < b.node and a.root <> b.root and least(a.n, b.n) * {DENOMINATOR} >= greatest(a.n, b.n) * {NUMERATOR}"
    # Where two similar sets first meet, what is left of the smaller rest is all that they share; later meetings count as rest.
    ok += f" and least(a.n - a.place, b.n - b.place) * {NUMERATOR + DENOMINATOR} >= (a.n + b.n) * {NUMERATOR}"
    met = a.join(b, F.expr(ok)).groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("size_a"), F.col("b.n").alias("size_b"))
    most = F.count("*") + F.least(F.col("size_a") - F.max("a.place"), F.col("size_b") - F.max("b.place")) - 1
    return met.agg(most.alias("most")).where((F.col("most") * (NUMERATOR + DENOMINATOR)) >= (F.col("size_a") + F.col("size_b")) * NUMERATOR).select("a", "b")


def _fingerprinted(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes by their fingerprints: the least node of each of two linked ones, and each other node of a fingerprint with its least."""
    each = checkpoint(nodes.select("node", "fp").distinct())
    least = checkpoint(each.groupBy("fp").agg(F.min("node").alias("a")))
    same = each.join(least, "fp").select("a", F.col("node").alias("b"))
    found = fingerprint_links(least.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    ends = [least.select(F.col("fp").alias(c), F.col("a").alias(f"n{c}")) for c in ("x", "y")]
    linked = found.join(ends[0], "x").join(ends[1], "y").select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b"))
    return same.union(linked).where("a <> b").distinct()


def _placed(near: DataFrame, roots: DataFrame) -> DataFrame:
    """band, node and root (of the component so far) of every row of near."""
    return checkpoint(near.join(sent(roots), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node and root of the components that links make of those so far, of which each node's root is all that is needed."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links.select("a", "b")))


def _few(placed: DataFrame, turn: int, parts: int) -> DataFrame:
    """Distinct pairs (a, b): each node with up to FEW nodes of other components that bands choose, those of most bands first."""
    by = F.xxhash64("node", "band", F.lit(turn))
    heads = placed.groupBy("band").agg(F.min_by(F.struct("node", "root"), by).alias("x"), F.max_by(F.struct("node", "root"), by).alias("y"))
    other = F.when(F.col("root") != F.col("x.root"), F.col("x.node")).when(F.col("root") != F.col("y.root"), F.col("y.node"))
    chosen = placed.join(heads, "band").select("node", other.alias("other")).where("other is not null").coalesce(parts).groupBy("node", "other").agg(F.count("*").alias("k")).coalesce(parts)
    best = chosen.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), "other"))).where(F.col("r") <= FEW)
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).coalesce(parts).distinct().coalesce(parts)


def similar(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, at (hash of the text) and component_id of every row: components of texts whose shingle sets are similar.

    A text of fewer words than a shingle is one shingle, texts without words are alike (a null text is one). Repeated rows are
    alike. component_id is the smallest doc_id of the component, null only where all are null. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("at"))
    nodes = checkpoint(rows.mapInArrow(_nodes(shingle), "doc_id long, at long, node long, fp long, bands array<long>"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = checkpoint(banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi"))
    near = checkpoint(banded.join(sent(shared), "band").select("band", "node").distinct())
    tried = checkpoint(_fingerprinted(nodes))
    wanted = checkpoint(near.select("node").union(tried.select("a")).union(tried.select("b")).distinct())
    place = checkpoint(nodes.join(sent(wanted), "node").groupBy("node").agg(F.min("at").alias("at")))
    members = checkpoint(rows.select("text", "at").join(sent(place), "at").groupBy("node").agg(F.first("text").alias("text")))
    parts = parts_of(near.count())
    near = near.coalesce(parts)
    roots = components(_verified(tried, members, shingle))
    for turn in range(ROUNDS):
        pairs = _few(_placed(near, roots), turn, parts)
        pairs = checkpoint(pairs.join(sent(tried), ["a", "b"], "left_anti").coalesce(parts))
        roots, tried = _joined(roots, _verified(pairs, members, shingle)), tried.union(pairs)
    placed = _placed(near, roots)
    split = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band")
    open_ = checkpoint(placed.join(sent(checkpoint(split)), "band").select("node", "root").distinct())
    rest = checkpoint(_met(open_, members, shingle).join(sent(tried), ["a", "b"], "left_anti"))
    roots = _joined(roots, _verified(rest, members, shingle))
    each = nodes.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return nodes.select("doc_id", "at", "node").join(each.join(least, "root").select("node", "component_id"), "node").select("doc_id", "at", "component_id")
