"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length; a length has as many places as it has documents, times the
cap. Of a source's target each length gives its proportional part, rounded in a seeded order, and what
remains, a small budget or a few long documents, is met by a bounded knapsack over the places that are left. A length's places go
to its documents evenly, the odd ones by a seeded order. Only lengths and counts meet in one task; documents are
dealt by source, length and a bucket of the seeded order, so that no length's documents do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from .common import checkpoint, fresh_name, n_words, sent

WEIGHTS, CAP, SEED = (5, 2, 1), 3, 42
#: Words of a budget that the knapsack meets exactly; documents of a length in one bucket, about.
KNAPSACK, BUCKET = 1 << 16, 1_000


def knapsack(budget: int, lengths: np.ndarray, counts: np.ndarray, spare: int = 0, aim: int = 0) -> np.ndarray:
    """How many of each length make the sum nearest to budget, the smaller of two (0/1 by binary parts of the counts).

    What others can add, up to `spare`, counts as there; of sums that are equally near then, the one nearest to aim is taken.
    """
    take, usable = np.zeros(len(lengths), np.int64), (lengths > 0) & (counts > 0)
    if not usable.any():
        return take
    limit = budget + min(budget, int(lengths[usable].max()))  # a larger sum is no nearer than nothing, or has an item too many
    reached, by = np.zeros(limit + 1, bool), np.full(limit + 1, -1, np.int32)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for i in np.flatnonzero(usable & (lengths <= limit)).tolist():
        left, k = min(int(counts[i]), limit // int(lengths[i])), 1
        while left and (spare or not reached[budget]):
            n = min(k, left)
            w = n * int(lengths[i])
            new = reached[: limit + 1 - w] & ~reached[w:]
            by[w:][new] = len(parts)
            reached[w:] |= new
            parts.append((i, n))
            left, k = left - n, 2 * k
    sums = np.flatnonzero(reached)
    far = np.where(sums > budget, sums - budget, np.maximum(budget - spare - sums, 0))
    near = sums[far == far.min()]
    s = int(near[np.abs(near - aim).argmin()]) if spare else int(near[0])
    while s:
        i, n = parts[by[s]]
        take[i] += n
        s -= n * int(lengths[i])
    return take


def nearest(rest: int, lengths: np.ndarray, counts: np.ndarray, knapsack_words: int = KNAPSACK, seed: int = SEED) -> np.ndarray:
    """The knapsack at any remainder, over all lengths. A large one is met in cells of several words by long documents, which leave what
    short ones can fill; these have their proportional parts of it; what is left then is met again, in smaller cells, exactly in the end."""
    cell = -(-rest // (2 * knapsack_words))
    if cell <= 1:
        return knapsack(rest, lengths, counts)
    short = lengths < 8 * cell
    words = lengths * counts
    fill = int(words[short].sum())
    aim = rest // cell * int(words[~short].sum()) // max(1, int(words.sum()))
    take = knapsack(rest // cell, -(-lengths // cell), np.where(short, 0, counts), fill // cell, aim)
    left = rest - int(take @ lengths)
    if left > 0 and fill:
        take = take + fit(left, lengths, np.where(short, counts, 0), knapsack_words, seed)
        left = rest - int(take @ lengths)
    return take + (nearest(left, lengths, counts - take, knapsack_words, seed) if 0 < left < rest else 0)


def fit(budget: int, lengths: np.ndarray, counts: np.ndarray, knapsack_words: int = KNAPSACK, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take, so that their words come near the budget.

    Each length gets its proportional part, rounded down or up: what rounding loses is carried on from length to length
    in a seeded order. Some words are held back for the knapsack.
    """
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return take
    budget = min(budget, total)
    dealt = budget - knapsack_words // 2 - int(lengths[counts > 0].max()) if budget < total else total
    carry = 0  # words times total
    for i in np.random.default_rng(seed).permutation(len(lengths)).tolist() if dealt > 0 else ():
        n, more = divmod(int(counts[i]) * dealt, total)
        carry += more * int(lengths[i])
        up = more > 0 and 2 * carry >= total * int(lengths[i])
        take[i] = n + up
        carry -= up * total * int(lengths[i])
    rest = budget - int((take * lengths).sum())
    take = take + nearest(rest, lengths, counts - take, knapsack_words, seed) if rest > 0 else take
    return exchanged(budget, lengths, counts, take, knapsack_words, seed)


def exchanged(budget: int, lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, knapsack_words: int, seed: int) -> np.ndarray:
    """What is taken, nearer to the budget if it can be: some short documents are given back, and what they and the gap need is met exactly."""
    off, back, words = budget - int(take @ lengths), np.zeros(len(lengths), np.int64), 0
    if not off:
        return take
    short = np.random.default_rng(seed).permutation(np.flatnonzero((take > 0) & (lengths > 0) & (lengths <= knapsack_words // 4))).tolist()
    for i in short:
        back[i] = min(int(take[i]), 1 + knapsack_words // (2 * len(short) * int(lengths[i])))
        words += int(back[i] * lengths[i])
        if words >= knapsack_words:
            break
    if words + off <= 0:
        return take
    again = knapsack(words + off, lengths, counts - take + back)
    return take - back + again if abs(words + off - int(again @ lengths)) < abs(off) else take


def targets(sources: DataFrame, total: int, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size and target. Sources, in order of code points and null last, have the weights in turn;
    a share above cap times the source's size stops there and the excess goes to the others by weight."""
    ordered = checkpoint(sources.repartitionByRange(8, F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()))
    before, base = 0, []
    for p, n in sorted(ordered.groupBy(F.shiftright("at", 33).alias("p")).count().collect()):  # a row for each partition
        base += [F.lit(p), F.lit(before)]
        before += n
    rank = (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.create_map(*base)[F.shiftright("at", 33)]) if base else F.lit(0)
    ranked = ordered.select("source", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")).alias("weight"))
    limit, level, seen = cap * F.col("source_size").cast("double"), 0.0, -1
    while True:
        full = limit <= level * F.col("weight") if seen >= 0 else F.lit(False)
        n, capped, free = ranked.agg(F.count_if(full), F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == seen or not free:
            break
        seen, level = n, (total - capped) / free
    return ranked.select("source", "source_size", F.least(limit, level * F.col("weight")).alias("target"))


def _key(docs: DataFrame, seed: int) -> Column:
    """What repeated rows share: a hash of doc_id, source and text, in which a null has its place."""
    return F.xxhash64(F.lit(seed), *_marked(docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["text"]))


def _marked(*columns: Column) -> list[Column]:
    """Columns, each with a mark of its nulls, which a hash skips."""
    return [x for c in columns for x in (c.isNull(), c)]


def _of_group(docs: DataFrame, groups: DataFrame, names: dict[str, str], seed: int) -> Column:
    """Whether a row is of a group: by its hash, doc_id and source."""
    return (_key(docs, seed) == groups[names["key"]]) & docs["doc_id"].cast("long").eqNullSafe(groups[names["doc_id"]]) & docs["source"].cast("string").eqNullSafe(groups[names["source"]])


def _planned(docs: DataFrame, weights: tuple, cap: int, seed: int) -> DataFrame:
    """doc_id, size, source_size, target, key, n_rows and copies (of all of them together) of each group of repeated rows.

    A group's documents have neighbouring places in the seeded order, so that a text repeated any number of times is one row here.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), _key(docs, seed).alias("key"))
    rows = checkpoint(words.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n_rows")))
    lengths = checkpoint(rows.groupBy("source", "size").agg(F.sum("n_rows").alias("n")))
    total = lengths.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    sources = checkpoint(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), total, weights, cap))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        return rows.assign(take=fit(round(rows["target"].iloc[0]), rows["size"].to_numpy(np.int64), cap * rows["n"].to_numpy(np.int64)))

    joined = lengths.join(sent(sources), lengths.source.eqNullSafe(sources.source)).select(lengths.source, "size", "n", "source_size", "target")
    planned = checkpoint(joined.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, take long"))
    p = planned.withColumnsRenamed({"source": "of", "size": "of_size"})
    buckets = (F.col("n") / BUCKET).cast("long") + 1
    dealt = rows.join(p, rows.source.eqNullSafe(p.of) & (rows["size"] == p.of_size)).withColumn("bucket", F.pmod("key", buckets)).drop("of", "of_size")
    # Documents in the buckets before count in the order, too; only lengths of several buckets have such.
    many = dealt.where(buckets > 1).groupBy("source", "size", "bucket").agg(F.sum("n_rows").alias("rows"))
    w = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = many.select(F.col("source").alias("s"), F.col("size").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("before"))
    dealt = dealt.join(before, dealt.source.eqNullSafe(before.s) & (dealt["size"] == before.l) & (dealt.bucket == before.b), "left")
    w = Window.partitionBy("source", "size", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("n_rows").over(w), F.lit(0))
    odd = F.greatest(F.lit(0), F.least("n_rows", F.col("take") % F.col("n") - place))
    return dealt.withColumn("copies", F.expr("n_rows * (take div n)") + odd).select("doc_id", "source", "size", "source_size", "target", "key", "n_rows", "copies")


def _copies(group: str, rows: str, i: Column) -> Column:
    """Copies of the i-th row (from 0) of a group: evenly, the first ones have the odd ones."""
    return F.expr(f"{group} div {rows}") + (i < F.col(group) % F.col(rows)).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies (times that the mix has the row), taken and key of every row.

    Size is a text's number of words, 0 for a null or empty one. Null is a source of its own, the last one. Of rows that are
    equal in all that is returned it makes no difference which ones are taken. Extra columns don't matter; an empty table gives none.
    """
    rows = _planned(docs, weights, cap, seed).select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("i", "_i"))
    rows = rows.withColumn("row_copies", _copies("copies", "n_rows", F.col("i")))
    return rows.select("doc_id", "size", "source_size", "target", F.col("row_copies").alias("copies"), (F.col("size") * F.col("row_copies")).alias("taken"), "key")


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; nulls, ties, repeated rows and empty tables as in mix."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix has it, with all columns of any names.

    Rows of the same doc_id, source and text are a group, which comes as often as the mix has them all; in it, rows that differ in any
    column, of whatever kind, are rows of their own. A null text is empty, but is not the same as an empty one.
    """
    names = {x: fresh_name(docs.columns, f"group_{x}") for x in ("key", "doc_id", "source", "n_rows", "copies", "copy")}
    groups = checkpoint(_planned(docs, WEIGHTS, CAP, seed).where("copies > 0").select(*[F.col(x).alias(names[x]) for x in ("key", "doc_id", "source", "n_rows", "copies")]))
    n_rows, copies, copy = names["n_rows"], names["copies"], names["copy"]
    columns, one = [docs[c] for c in docs.columns], F.lit(1).cast("long")
    alone = groups.where(F.col(n_rows) == 1)
    single = docs.join(alone, _of_group(docs, alone, names, seed)).select(*columns, F.explode(F.sequence(one, F.col(copies))).alias(copy)).drop(copy)
    tied = checkpoint(groups.where(F.col(n_rows) > 1))
    if tied.isEmpty():
        return single
    # Repeated rows that are equal in all their columns are one row that comes for all of them.
    flat = [isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType) for f in docs.schema]
    nested = [c for c, x in zip(columns, flat, strict=True) if not x]
    alike = F.xxhash64(*_marked(*(c for c, x in zip(columns, flat, strict=True) if x)), *([F.sha2(F.to_json(F.struct(*nested)), 256)] if nested else []))
    tied = sent(tied)
    rows = docs.join(tied, _of_group(docs, tied, names, seed)).select(F.struct(*columns).alias("row"), *(F.col(names[x]).alias(x) for x in ("key", "doc_id", "source", "n_rows", "copies")), alike.alias("same"))
    group = ["key", "doc_id", "source"]
    rows = rows.groupBy(*group, "same").agg(F.count("*").alias("n"), F.first("n_rows").alias("n_rows"), F.first("copies").alias("copies"), F.first("row").alias("row"))
    w = Window.partitionBy(*group).orderBy("same").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.greatest(F.lit(0), F.least("n", F.expr("copies % n_rows") - F.coalesce(F.sum("n").over(w), F.lit(0))))
    rows = rows.withColumn("times", F.expr("n * (copies div n_rows)") + odd).where("times > 0")
    return single.union(rows.select("row", F.explode(F.sequence(one, "times"))).select("row.*"))
