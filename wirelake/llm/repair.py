"""Repair of conversations' structure by the cheapest edits, with a persistent dynamic programme.

For each place in an automaton of legal role sequences the programme keeps the cheapest edits so far. Strings of edits
share their beginnings: each is a node with a link to the one before it, ancestors at powers of two and a rolling hash.
Of equally cheap ones the least is found by a search for their longest common prefix over these ancestors; where hashes
are equal the nodes are compared, so that a collision changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .trie import CRC

#: Costs of edits (fixed values), and what a truncated turn costs that stays.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places of the automaton: nothing yet, after a system turn, after a user's, after an assistant's; where it may end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
MOVES = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
BASE, MODULUS = 1_000_003, (1 << 61) - 1
SPACES, STOPS = " \t\n\x0b\f\r", (".", "!", "?")


def next_role(place: int) -> tuple[str, int]:
    """The one role that may be put at a place, and the place behind it."""
    return ("assistant", ASSISTANT) if place == USER else ("user", USER)


class Edits:
    """Strings of edits as linked nodes; node 0 is the empty one."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.edit, self.length, self.hash, self.up = [""], [0], [0], [()]

    def grown(self, node: int, edit: str) -> int:
        """The string with one more edit."""
        ups, k, above = [node], 0, node
        while k < len(self.up[above]):
            above = self.up[above][k]
            ups.append(above)
            k += 1
        self.edit.append(edit)
        self.length.append(self.length[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(edit)) % self.modulus)
        self.up.append(tuple(ups))
        return len(self.edit) - 1

    def cut(self, node: int, length: int) -> int:
        """The prefix of so many edits."""
        k = 0
        while rest := self.length[node] - length:
            k = rest.bit_length() - 1
            node = self.up[node][k]
        return node

    def alike(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal: if their hashes are, they are compared, up to where they share a node."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the first string comes before the second in ASCII order."""
        short = min(self.length[a], self.length[b])
        x, y = self.cut(a, short), self.cut(b, short)
        if self.alike(x, y):
            return self.length[a] < self.length[b]
        for k in range(len(self.up[x]) - 1, -1, -1):  # as far up as they still differ
            if k < len(self.up[x]) and not self.alike(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.edit[x] < self.edit[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def cheapest(rows: Iterable[tuple[str, bool, bool]], modulus: int = MODULUS) -> tuple[int, str]:
    """Cost and edits of rows (initial of the role, must go, truncated)."""
    edits = Edits(modulus)
    best: list[tuple[int, int] | None] = [(0, 0), None, None, None]

    def least(found: list[tuple[int, int, str]]) -> tuple[int, int] | None:
        """The cheapest of (cost, node, edit to come, or none)."""
        if not found:
            return None
        cost = min(x[0] for x in found)
        nodes = [edits.grown(n, e) if e else n for c, n, e in found if c == cost]
        first = nodes[0]
        for n in nodes[1:]:
            if edits.less(n, first):
                first = n
        return cost, first

    def with_inserts(best: list) -> list:
        best = list(best)
        best[USER] = least([(best[p][0] + (p != USER) * INSERT, best[p][1], "I" if p != USER else "") for p in (USER, NONE, SYSTEM, ASSISTANT) if best[p]])
        best[ASSISTANT] = least([(best[p][0] + (p == USER) * INSERT, best[p][1], "I" if p == USER else "") for p in (ASSISTANT, USER) if best[p]])
        return best

    for initial, must_go, truncated in rows:
        found: list[list] = [[], [], [], []]
        more, moves = TRUNCATED * truncated, MOVES.get(initial, {})
        for place, at in enumerate(with_inserts(best)):
            if at:
                cost, node = at
                found[place].append((cost + DELETE, node, "D"))
                if not must_go:
                    if place in moves:
                        found[moves[place]].append((cost + more, node, "K"))
                    found[next_role(place)[1]].append((cost + RENAME + more, node, "R"))
        best = [least(x) for x in found]
    best = with_inserts(best)
    cost, node = least([(*best[p], "") for p in ENDS if best[p]])
    return cost, edits.text(node)


def applied(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired (role, text) rows."""
    place, i, out = NONE, 0, []
    for edit in audit:
        if edit == "K":
            out.append(rows[i])
            place = MOVES[rows[i][0][:1]][place]
        elif edit != "D":
            role, place = next_role(place)
            out.append((role, rows[i][1] if edit == "R" else ""))
        i += edit != "I"
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of each row, some of them damaged by a checksum of id and turn; times is 0 for a dropped row, 2 for a repeated one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    changed = F.when(fault.isin(0, 1), "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))


def repaired(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, and the repaired turns (role, text).

    A null role or text is one space. Turns without a number come first; ties go by role, then by text. Rows without a conv_id are
    one conversation. A role that is no system, user or assistant by its initial, an empty one too, can't be kept. Gaps beyond the
    range of a long count as its end. Rows that repeat are duplicates; extra columns don't matter; an empty table gives none. A conversation passes one task, turn by turn;
    its turns are in memory, other conversations aren't.
    """
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(*map(F.asc_nulls_first, ("conv_id", "turn", "role", "text")))
    rows = damaged(rows) if damage else rows.withColumn("times", F.lit(1))
    last: Column = F.substring(F.btrim("text", F.lit(SPACES)), -1, 1)
    rows = rows.withColumn("last", last)
    kinds = {"conv_id": pa.int64(), **{c: pa.int64() for c in COUNTS}, "audit": pa.string(), "repaired": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}

    def judged(conv: int | None, turns: list[dict]) -> tuple:
        seen, faults, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        said = [(t["role"], t["text"], t["last"]) for t in turns for _ in range(t["times"])]
        for role, text, last in said:
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in STOPS else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            faults.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = {t["turn"] for t in turns if t["times"] and t["turn"] is not None}
        gaps = min(max(numbers) - min(numbers) + 1 - len(numbers), (1 << 63) - 1) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:], strict=False))
        cost, audit = cheapest(faults)
        fixed = [{"role": r, "text": t} for r, t in applied(audit, [x[:2] for x in said])]
        return conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, began = None, [], False
        batch = lambda done: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds.values(), strict=True)], list(kinds))
        for part in (p for b in batches for p in slices(b)):
            done = []
            for t in part.to_pylist():
                if began and t["conv_id"] != conv:
                    done.append(judged(conv, turns))
                    turns = []
                conv, began = t["conv_id"], True
                turns.append(t)
            if done:
                yield batch(done)
        if began:
            yield batch([judged(conv, turns)])

    return rows.mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired array<struct<role:string,text:string>>")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def op12(conversations: DataFrame) -> DataFrame:
    """Counts, audit and repaired_sha256 of every original conv_id after damage; nulls, ties, repeated rows and empty tables as in repaired.

    A conversation of which damage leaves no row has zeros, an empty audit and the hash of the empty text.
    """
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return repaired(conversations, damage=True).select("conv_id", *COUNTS, "audit", F.sha2(text, 256).alias("repaired_sha256"))


def _added(state: str, cost: int | str, edit: str) -> str:
    """SQL for a state, text of twelve digits of cost and the edits, with one more edit."""
    return f"lpad((left({state}, 12)::bigint + {cost})::varchar, 12, '0') || substr({state}, 13) || '{edit}'"


_INSERTED = f"""select *, least(s3, {_added("s2", 3, "I")}) as t3 from (select * replace (least(s2, {_added("s0", 3, "I")}, {_added("s1", 3, "I")}, {_added("s3", 3, "I")}) as s2) from {{}})"""
_KEPT = _added("{}", "more", "K")
_NAMED = _added("{}", "more + 3", "R")

OP12_SQL = f"""
with recursive given as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC.format("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as fault from conversations
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from given
), damaged as (
    select conv_id, turn, place, case when fault = 4 then 'user' else role end as role, case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case fault when 0 then [] when 3 then [1, 2] else [1] end) as copy from placed
), judged as (
    select conv_id, turn, role, text, left(role, 1) as initial, row_number() over (partition by conv_id order by place, copy) as i, right(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last,
        row_number() over (partition by conv_id, role, text order by place, copy) > 1 as seen from damaged
), faulty as (
    select *, last = '' as blank, last <> '' and seen as duplicate, last <> '' and not seen and last not in ('.', '!', '?') as truncated, lag(initial) over (partition by conv_id order by i) || initial as pair from judged
), turns as (
    select *, blank or duplicate as must_go, 3 * truncated::int as more from faulty
), states as (
    select conv_id, 0::bigint as i, repeat('0', 12) as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from (select distinct conv_id from conversations)
    union all
    select s.conv_id, t.i, {_added("s0", 4, "D")}, least({_added("s1", 4, "D")}, case when not must_go and initial = 's' then {_KEPT.format("s0", "s0")} end),
        least({_added("s2", 4, "D")}, case when not must_go and initial = 'u' then least({", ".join(_KEPT.format(x, x) for x in ("s0", "s1", "t3"))}) end, case when not must_go then least({", ".join(_NAMED.format(x, x) for x in ("s0", "s1", "t3"))}) end),
        least({_added("t3", 4, "D")}, case when not must_go and initial = 'a' then {_KEPT.format("s2", "s2")} end, case when not must_go then {_NAMED.format("s2", "s2")} end)
    from ({_INSERTED.format("states")}) s join turns t on t.conv_id is not distinct from s.conv_id and t.i = s.i + 1
), ended as (
    select conv_id, least(s0, t3) as best from ({_INSERTED.format("states")}) qualify row_number() over (partition by conv_id order by i desc) = 1
), audits as (
    select conv_id, left(best, 12)::bigint as cost, substr(best, 13) as audit from ended
), walked as (
    select conv_id, audit, 0::bigint as k, 0::bigint as i, '' as before, '' as repaired from audits
    union all
    select w.conv_id, w.audit, w.k + 1, w.i + (w.e <> 'I')::int, case when w.e = 'K' then t.initial when w.e = 'D' then w.before when w.before = 'u' then 'a' else 'u' end,
        case when w.e = 'D' then w.repaired else w.repaired || case when w.repaired = '' then '' else chr(10) end || case when w.e = 'K' then t.role when w.before = 'u' then 'assistant' else 'user' end || ':' || case when w.e = 'I' then '' else t.text end end
    from (select *, substr(audit, k + 1, 1) as e from walked) w left join turns t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1 where w.e <> ''
), counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(duplicate) as duplicate, count_if(truncated) as truncated, count_if(pair is not null and pair not in ('su', 'ua', 'au')) as illegal from turns group by conv_id
)
select a.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate, coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal, a.cost, a.audit, sha256(w.repaired) as repaired_sha256
from audits a join walked w on w.conv_id is not distinct from a.conv_id and w.k = length(a.audit) left join counted c on c.conv_id is not distinct from a.conv_id
"""
