"""Prefix trie of conversations: a z-fast trie whose compacted nodes are rows, found by a hash of their handle.

A conversation is the row of its prefixes' digests; texts meet nowhere. A compacted node covers the depths (lo, hi] of
its edge, and its handle is the prefix of the two-fattest length in there, the one that most powers of two divide. So
the deepest node on a conversation's way is found by a binary search over its own length, each step a join by one
digest (fat binary search); one more join by the next prefix finds the edge on which it leaves the trie.

Distinct sequences are inserted in batches. In each one all that are pending look for their exit; edges are split at
all exits, and of the sequences that leave at one place with the same next turn the longest becomes a new edge to its
end, a strand, while the others go on from there in the next batch. In the end all edges are expanded to a row a depth,
and counts go up from the strands of the last batch to those of the first: within a strand by a window over its depths,
between strands by sums at the places where they hang.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Bytes of a digest; conversations share the first turns of the one whose id is the next lower multiple; ids of a block.
DIGEST, SHARE, BLOCK_BITS = 16, 5, 12
#: A strand is known by its batch and its sequence.
STRAND = "struct<batch:int,seq:binary>"
#: Columns of the rows that are added up at a depth of a strand.
LAID = [("strand", STRAND), ("depth", "int"), ("up", STRAND), ("up_depth", "int"), ("n", "int"), ("size", "long"), ("ends", "string"), ("low", "long"), ("k", "long"), ("members", "long"), ("leaves", "long"), ("saved", "long")]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (digest, bytes) in order of turn (null first; ties by role, then by digest)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARE).repartition("base")
    listed = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "bytes"))).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, of which the first h (by a checksum of the id, 8 at most) are those of the conversation that it shares with."""
    own = turns_of(conversations)
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8))).over(Window.partitionBy("base"))
    own = own.withColumn("head", F.coalesce(head, F.slice("turns", 1, 0))).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
    return own.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def sequences(rows: DataFrame) -> DataFrame:
    """seq, n, prefix, bytes, n_ends, min_conv and ends of each distinct sequence of turns.

    prefix has the digest of each depth, seq is the last one (no bytes for no turns), ends the SHA-256 of the ids, which
    pass a task in sorted blocks of neighbouring ids, a hash at a time, so that any number of copies needs no memory.
    """
    listed = "conv_id long, seq binary, prefix array<binary>, bytes array<long>"

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column("turns").to_pylist():
                so_far, prefix = hashlib.sha256(), []
                for t in turns:
                    so_far.update(t["digest"])
                    prefix.append(so_far.digest()[:DIGEST])
                out.append((prefix[-1] if prefix else b"", prefix, [t["bytes"] for t in turns]))
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "seq", "prefix", "bytes"])

    blocks = rows.mapInArrow(chained, listed).groupBy("seq", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    blocks = blocks.agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.first("prefix").alias("prefix"), F.first("bytes").alias("bytes"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, n, low, prefix, sizes = None, None, 0, None, [], []
        names = ["seq", "n", "prefix", "bytes", "n_ends", "min_conv", "ends"]
        kinds = [pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        done: list[tuple] = []

        def put() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if r["seq"] != seq:
                    if seq is not None:
                        done.append((seq, len(prefix), prefix, sizes, n, low, ids.hexdigest()))
                    seq, ids, n, low, prefix, sizes = r["seq"], hashlib.sha256(), 0, r["low"], r["prefix"], r["bytes"]
                else:
                    ids.update(b",")
                ids.update(r["ids"].encode())
                n += r["n"]
            if done:
                yield put()
        if seq is not None:
            done.append((seq, len(prefix), prefix, sizes, n, low, ids.hexdigest()))
            yield put()

    ordered = blocks.repartition("seq").sortWithinPartitions("seq", "block")
    return ordered.mapInArrow(hashed, "seq binary, n int, prefix array<binary>, bytes array<long>, n_ends long, min_conv long, ends string")


def fattest(a: str, b: str) -> Column:
    """The number in (a, b] that most powers of two divide: b without the bits below the first one in which they differ."""
    return F.expr(f"{b} & shiftleft(-1, length(bin({a} ^ {b})) - 1)")


def with_handles(edges: DataFrame) -> DataFrame:
    """name (the first prefix of the edge), handle and extent of compacted nodes of lo, hi, strand and edge (the prefixes in between)."""
    at = fattest("lo", "hi") - F.col("lo") - 1
    return edges.select(F.get("edge", F.lit(0)).alias("name"), F.get("edge", at).alias("handle"), F.get("edge", F.col("hi") - F.col("lo") - 1).alias("extent"), "lo", "hi", "strand", "edge")


def exits(pending: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """pending (seq, n, prefix, at, strand, ...) with at and strand where it leaves the trie, and the name and hi of the edge, if inside of one.

    at is the depth up to which it was known to be in the trie, an edge's end. A handle that is missing ends the way before it; one
    whose edge goes another way, or beyond, at the edge's start; else the search goes on behind the edge.
    """
    kept = [c for c in pending.columns if c not in ("at", "strand")]
    handles = nodes.select(F.col("handle").alias("_key"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("extent").alias("_extent"), F.col("strand").alias("_strand"))
    rows = pending.withColumns({"a": F.col("at"), "b": F.col("n")})
    for _ in range(steps):
        # Rows that are done have a key of their own that no handle has.
        rows = rows.withColumn("f", fattest("a", "b"))
        rows = rows.withColumn("_key", F.when(F.col("a") < F.col("b"), F.get("prefix", F.col("f") - 1)).otherwise(F.concat("seq", F.lit(b"-"))))
        rows = rows.join(handles, "_key", "left")
        found, whole = F.col("_hi").isNotNull(), F.coalesce(F.get("prefix", F.col("_hi") - 1) == F.col("_extent"), F.lit(False))
        a = F.when(whole, F.col("_hi")).when(found, F.col("_lo")).otherwise(F.col("a"))
        b = F.when(whole, F.col("b")).when(found, F.col("_lo")).when(F.col("a") < F.col("b"), F.col("f") - 1).otherwise(F.col("b"))
        rows = rows.select(*kept, a.alias("a"), b.alias("b"), F.when(whole, F.col("_strand")).otherwise(F.col("strand")).alias("strand"))
    edges = nodes.select(F.col("name").alias("_key"), F.col("name"), F.col("hi"), F.col("edge"), F.col("strand").alias("_strand"))
    rows = rows.withColumn("_key", F.coalesce(F.get("prefix", F.col("a")), F.concat("seq", F.lit(b"-")))).join(edges, "_key", "left")
    alike = F.coalesce(F.expr("size(filter(edge, (e, i) -> e <=> get(prefix, a + i)))"), F.lit(0))
    return rows.select(*kept, (F.col("a") + alike).cast("int").alias("at"), F.coalesce("_strand", "strand").alias("strand"), "name", "hi")


def split(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """Nodes whose edges are cut at the depths of at (name, at)."""
    cuts = at.distinct().groupBy(F.col("name").alias("_name")).agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    rows = nodes.join(cuts, nodes.name == F.col("_name"), "left")
    rows = rows.withColumn("cuts", F.concat(F.array("lo"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("hi")))
    rows = rows.select("strand", "edge", F.col("lo").alias("_lo"), F.explode(F.expr("transform(sequence(1, size(cuts) - 1), i -> struct(get(cuts, i - 1) as lo, get(cuts, i) as hi))")).alias("part"))
    return with_handles(rows.select(F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi"), "strand", F.slice("edge", F.col("part.lo") - F.col("_lo") + 1, F.col("part.hi") - F.col("part.lo")).alias("edge")))


def strands(seqs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The edges that each batch inserted (strand, up, up_depth, n, bytes), and where each sequence ends (strand, depth, n_ends, min_conv, ends)."""
    longest = seqs.agg(F.max("n")).first()[0] or 0
    none = F.lit(None).cast("binary")
    pending, nodes, batches, ends = seqs.where("n > 0").select("*", F.lit(0).alias("at"), F.lit(None).cast(STRAND).alias("strand")), None, [], []
    ended = ["n_ends", "min_conv", "ends"]
    while True:
        if nodes is None:
            found = pending.select("*", none.alias("name"), F.lit(None).cast("int").alias("hi"))
        else:
            found = checkpoint(exits(pending, nodes, longest.bit_length()))
            ends.append(found.where("at = n").select("strand", F.col("at").alias("depth"), *ended))
            found = found.where("at < n")
        new = found.groupBy(F.get("prefix", F.col("at")).alias("_next")).agg(F.max(F.struct("n", "seq", "prefix", "bytes", "at", "strand", *ended)).alias("s")).select("s.*")
        new = checkpoint(new)
        if new.isEmpty():
            return batches, reduce(DataFrame.union, ends) if ends else None
        strand = F.struct(F.lit(len(batches)).alias("batch"), "seq").alias("strand")
        batches.append(new.select(strand, F.col("strand").alias("up"), F.col("at").alias("up_depth"), "n", F.slice("bytes", F.col("at") + 1, F.col("n") - F.col("at")).alias("bytes")))
        ends.append(new.select(strand, F.col("n").alias("depth"), *ended))
        edges = with_handles(new.select(F.col("at").alias("lo"), F.col("n").alias("hi"), strand, F.slice("prefix", F.col("at") + 1, F.col("n") - F.col("at")).alias("edge")))
        nodes = checkpoint(edges if nodes is None else split(nodes, found.where("at < hi").select("name", "at")).union(edges))
        pending = found.drop("name", "hi").join(new.select("seq"), "seq", "left_anti")


def trie(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node over rows of conv_id and turns."""
    seqs = checkpoint(sequences(rows))
    batches, ends = strands(seqs)
    zero, sums = F.lit(0).cast("long"), ["k", "members", "leaves", "saved"]
    done, tops = [], None
    for batch, new in reversed(list(enumerate(batches))):
        # A row for each depth of an edge; what ends there, and what hangs there, are added to it.
        depths = new.select("strand", "up", "up_depth", "n", F.posexplode("bytes").alias("i", "size")).select("strand", (F.col("up_depth") + F.col("i") + 1).alias("depth"), "up", "up_depth", "n", "size")
        named = lambda df, **x: df.select(*(x.get(c, F.lit(None).cast(t)).alias(c) for c, t in LAID))
        laid = named(depths, **{c: F.col(c) for c in depths.columns})
        laid = laid.union(named(ends.where(F.col("strand.batch") == batch), strand=F.col("strand"), depth=F.col("depth"), members=F.col("n_ends"), low=F.col("min_conv"), ends=F.col("ends")))
        if tops is not None:
            laid = laid.union(named(tops.where(F.col("up.batch") == batch), strand=F.col("up"), depth=F.col("up_depth"), low=F.col("low"), **{c: F.col(c) for c in sums}))
        laid = laid.repartition("strand").groupBy("strand", "depth").agg(
            *(F.max(c).alias(c) for c in ("up", "up_depth", "n", "size", "ends")), F.min("low").alias("low"), *(F.coalesce(F.sum(c), zero).alias(c) for c in sums)
        )
        w = Window.partitionBy("strand").orderBy(F.desc("depth"))
        below = w.rowsBetween(Window.unboundedPreceding, 0)
        laid = laid.withColumns({"members": F.sum("members").over(below), "low": F.min("low").over(below), "k": F.col("k") + (F.col("depth") < F.col("n")).cast("long")})
        laid = laid.withColumns({"leaves": F.sum(F.col("leaves") + (F.col("k") == 0).cast("long")).over(below), "saved": F.sum(F.col("saved") + (F.col("members") - 1) * F.col("size")).over(below), "parent": F.lead("low").over(w)})
        laid = checkpoint(laid.select("strand", "depth", "up", "up_depth", "low", "parent", *sums, "ends"))
        done.append(laid)
        first = laid.where("depth = up_depth + 1").groupBy("up", "up_depth").agg(F.count("*").alias("k"), F.min("low").alias("low"), *(F.sum(c).alias(c) for c in sums[1:]))
        tops = checkpoint(first if tops is None else tops.union(first).groupBy("up", "up_depth").agg(F.min("low").alias("low"), *(F.sum(c).alias(c) for c in sums)).select(*first.columns))
    turnless = seqs.where("n = 0").select(F.col("n_ends").alias("members"), F.col("min_conv").alias("low"), "ends", zero.alias("k"), zero.alias("leaves"), zero.alias("saved"))
    if tops is not None:
        turnless = turnless.unionByName(tops.where("up is null").select("members", "low", F.lit(None).cast("string").alias("ends"), "k", "leaves", "saved"))
    top = checkpoint(turnless.agg(F.min("low").alias("low"), F.max("ends").alias("ends"), *(F.sum(c).alias(c) for c in sums)).where("members > 0"))
    top = top.select("low", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), "members", "k", F.greatest("leaves", F.lit(1)).alias("leaves"), "saved", "ends")
    found = [top]
    if done:
        nodes = reduce(DataFrame.union, done)
        columns = top.columns
        found.append(nodes.where("depth > up_depth + 1").select(*columns))
        first, root = nodes.where("depth = up_depth + 1").drop("parent"), top.first()["low"]
        found.append(first.where("up is null").withColumn("parent", F.lit(root)).select(*columns))
        above = nodes.select(F.col("strand").alias("up"), F.col("depth").alias("up_depth"), F.col("low").alias("parent"))
        found.append(first.where("up is not null").join(above, ["up", "up_depth"]).select(*columns))
    out = reduce(DataFrame.union, found)
    return out.select(F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("k").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def op11(conversations: DataFrame) -> DataFrame:
    """The trie's nodes over the rebuilt conversations.

    A null role or text is empty. Turns without a number come first; ties go by role, then by the SHA-256 of role and text; rows
    that repeat are turns of their own. A conversation may be left without a turn and belongs to the root alone. Rows without a
    conv_id are in no conversation; extra columns don't matter; an empty table has no node, not even a root. Turns of a
    conversation meet in one row of digests (some 40 bytes a turn), whatever the length of their texts.
    """
    return trie(rebuilt(conversations))


#: SQL of the checksum of a short text of ASCII characters.
CRC = "xor(list_reduce([4294967295] || list_transform(string_split({}, ''), lambda c: ascii(c)::bigint), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP11_SQL = f"""
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, turn from conversations where conv_id is not null
), own as (
    select conv_id, text, digest, row_number() over (partition by conv_id order by turn nulls first, role, digest) as place from turns
), convs as (
    select conv_id, conv_id - conv_id % 5 as base, {CRC.format("conv_id::varchar")} % 9 as h from own group by conv_id
), built as (
    select c.conv_id, o.place, o.text, o.digest from convs c join own o on o.conv_id = c.base and o.place <= c.h
    union all select c.conv_id, o.place, o.text, o.digest from convs c join own o on o.conv_id = c.conv_id and o.place > c.h
), chained as (
    select conv_id, row_number() over w as depth, strlen(text) as size, md5(string_agg(digest, '') over w) as node, count(*) over (partition by conv_id) as n from built window w as (partition by conv_id order by place)
), members as (
    select conv_id, depth, size, node, coalesce(lag(node) over (partition by conv_id order by depth), '') as parent, depth = n as last from chained
    union all select conv_id, 0, 0, '', null, conv_id not in (select conv_id from chained) from convs
), nodes as (
    select depth, node, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size, sha256(coalesce(string_agg(case when last then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from members group by depth, node
), families as (
    select parent, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by parent, depth
), counted as (
    select n.*, coalesce(f.n_children, 0) as n_children from nodes n left join families f on f.parent = n.node and f.depth = n.depth
), subtrees as (
    select m.depth, m.node, sum((c.n_children = 0)::int) as n_leaves, sum((c.n_convs - 1) * c.size) as saved_tokens from counted c join members m on m.conv_id = c.conv_id and m.depth <= c.depth group by m.depth, m.node
)
select c.conv_id, c.depth::bigint as depth, p.conv_id as parent_conv_id, c.n_convs::bigint as n_convs, c.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, c.ends_sha256
from counted c join subtrees s on s.depth = c.depth and s.node = c.node left join nodes p on p.depth = c.depth - 1 and p.node = c.parent
"""
