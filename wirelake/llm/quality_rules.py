"""Line-first cleaning with column functions alone: lines that fail a rule go, then documents that lost too much."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. White space, what ends a sentence, separators of menus, phrases of boilerplate, symbols.
SPACE = r"[\x20\x09-\x0D]"
ENDS = ".!?…。！？\"'”’»)]:;"
MENU = "[|»›•·][^|»›•·]*[|»›•·]"
BOILERPLATE = "(?:^|[^a-z])(?:all rights reserved|privacy policy|cookie policy|accept cookies|terms of (?:use|service)|click here|subscribe to our|sign up (?:now|for)|log in to|enable javascript|share (?:this|on)|powered by|back to top)"
#: A word or two of every phrase above; a text without any of them has no phrase.
PHRASE_WORDS = ("rights reserved", " policy", "cookies", "terms of", "click here", "subscribe to", "sign up", "log in to", "javascript", "share ", "powered by", "back to top")
#: ASCII punctuation and white space, character by character: Java looks such classes up in a table, ranges one by one.
NOT_PUNCTUATION = r"""[^!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""
SPACES = r"[ \t\n\x0B\f\r]+"
NO_SYMBOLS = "[^#*$%&|<>]+"
#: Characters from which a line may end anywhere if a sentence ends within it, punctuation among a line's visible
#: characters (percent), words of a document, percent of words in repeated windows, percent of the text that must stay.
LONG_LINE, MOST_PUNCTUATION, LEAST_WORDS, MOST_REPEATED, LEAST_KEPT = 200, 25, 50, 50, 50

_words = f"case when btrim(t, ' \\t\\n\\u000b\\u000c\\r') = '' then array() else split(btrim(t, ' \\t\\n\\u000b\\u000c\\r'), '{SPACE}+') end"
_visible = f"filter(split(t, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
# Hashes of windows, sorted; those that equal their neighbour are repeated ones. Where few are, each window is looked
# up among them; where many are, windows are sorted with their places and compared with their neighbours.
FEW = 24
_hashes = "transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"
_twice = "array_compact(array_distinct(element_at(transform(array(sort_array(h)), s -> zip_with(s, slice(s, 2, size(s)), (a, b) -> if(a = b, a, null))), 1)))"
_few = "size(array_distinct(flatten(transform(h, (x, i) -> if(array_contains(d, x), array(i, i + 1, i + 2), array())))))"
_many = """element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s -> size(array_distinct(flatten(transform(
    filter(sequence(0, size(s) - 1), k -> coalesce(s[k].h = get(s, k + 1).h, false) or coalesce(s[k].h = get(s, k - 1).h, false)),
    k -> array(s[k].i, s[k].i + 1, s[k].i + 2)))))), 1)"""
_repeated = f"case when size(array_distinct(h)) = size(h) then 0 else element_at(transform(array({_twice}), d -> if(size(d) <= {FEW}, {_few}, {_many})), 1) end"


def _line_ok(line: Column, boilerplate: Column, odd_space: Column) -> Column:
    """If a line with a word passes all rules. boilerplate: if the text has a phrase's word at all; odd_space: if it has other white space than spaces."""
    ends = F.instr(F.lit(ENDS), F.right(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))) > 0
    long = (F.length(line) >= LONG_LINE) & line.rlike(f"[.!?…。]{SPACE}")
    visible = F.when(odd_space, F.length(F.regexp_replace(line, SPACES, ""))).otherwise(F.length(F.replace(line, F.lit(" "), F.lit(""))))
    marks = F.length(F.regexp_replace(line, NOT_PUNCTUATION, ""))
    return (ends | long) & ~line.rlike(MENU) & (100 * marks <= MOST_PUNCTUATION * visible) & ~(boilerplate & F.lower(line).rlike(BOILERPLATE))


def rate(docs: DataFrame, least_kept: int = LEAST_KEPT) -> DataFrame:
    """Counts and verdicts of every row, and its cleaned text.

    A null text is empty, has no words and fails. Lines without a word are neither judged nor counted as lost; a
    text without any line is not kept. Each row is judged alone.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    df = df.select("doc_id", "t", F.expr(_words.replace("\\x", "\\\\x")).alias("words"), F.expr(_visible.replace("\\", "\\\\")).alias("lines"))
    lowered = F.lower("t")
    df = df.withColumns({"phrase": reduce(operator.or_, (F.contains(lowered, F.lit(w)) for w in PHRASE_WORDS)), "odd": F.col("t").rlike("[\\t\\x0B-\\r]")})
    df = df.select("*", F.filter("lines", lambda x: _line_ok(x, F.col("phrase"), F.col("odd"))).alias("good"), F.expr(f"case when size(words) >= 3 then {_hashes} else array() end").alias("h"))
    df = df.withColumn("n_repeat", F.expr(_repeated))
    length = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    n_words, chars, kept_chars = F.size("words").cast("long"), length("lines"), length("good")
    failed = (n_words < LEAST_WORDS) | (100 * F.col("n_repeat") > MOST_REPEATED * n_words)
    return df.select(
        "doc_id",
        n_words.alias("n_words"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (chars > 0) & (100 * kept_chars >= least_kept * chars)).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("good").cast("long").alias("n_good_lines"),
        F.array_join("good", "\n").alias("clean_text"),
    )


def op2(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row, whether the base rules fail, and whether it is kept.

    A null text is empty; it has no words, so that the base fails. Repeated rows are judged alike, extra columns don't matter, an empty table gives none.
    """
    return rate(docs).drop("clean_text")


#: The same for DuckDB; doc_ids are taken to be distinct.
_Q = "[" + ENDS.replace("'", "''").replace("]", "\\]") + "]"
OP2_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) lines from d),
win as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] s from (select doc_id, words, unnest(range(1, len(words) - 1)) i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) c from win) where c > 1),
cov as (select doc_id, count(distinct i + k) n from rep, (values (0), (1), (2)) v(k) group by doc_id),
good as (select *, list_filter(lines, lambda l: (regexp_matches(l, '{_Q}{SPACE}*\\z') or length(l) >= {LONG_LINE} and regexp_matches(l, '[.!?…。]{SPACE}'))
    and not regexp_matches(l, '{MENU}') and not regexp_matches(lower(l), '{BOILERPLATE}')
    and 100 * length(regexp_replace(l, '[^!-/:-@\\[-`{{-~]+', '', 'g')) <= {MOST_PUNCTUATION} * length(regexp_replace(l, '{SPACE}+', '', 'g'))) good from w),
n as (select *, coalesce(cov.n, 0) r, len(words) nw, coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0) chars, coalesce(list_sum(list_transform(good, lambda l: length(l))), 0) kept_chars from good left join cov using (doc_id))
select doc_id, nw::bigint n_words, length(regexp_replace(t, '{SPACE}+', '', 'g'))::bigint word_chars, length(regexp_replace(t, '{NO_SYMBOLS}', '', 'g'))::bigint n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, r::bigint n_repeat_words, (nw < {LEAST_WORDS} or 100 * r > {MOST_REPEATED} * nw) base_failed,
    not (nw < {LEAST_WORDS} or 100 * r > {MOST_REPEATED} * nw) and chars > 0 and 100 * kept_chars >= {LEAST_KEPT} * chars kept, len(lines)::bigint n_lines, len(good)::bigint n_good_lines
from n
"""
