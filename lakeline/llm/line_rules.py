"""Line-first cleaning with DataFrame functions only.

Every line is put to three rules; a line that breaks one is removed, and a document that loses more than half of the
characters in its words is rejected:
- punctuation: over 10 in 100 of the line's word characters are of `#*$%&<>=_~^!`;
- navigation: three or more bars, or one for every four words;
- boilerplate: a line of at most 40 words holds one of the stated phrases.
Documents that fail the base counts (under 50 words, or over half of the words inside repeated three-word windows) are
rejected whatever their lines are. Window counts come from sorting a document's windows inside its row: no shuffle.

Null texts have no words and fail; empty lines don't count; repeated rows are judged alike; very long texts are judged
whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters that part words, and the counted symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORDS_APART = r"[\x20\x09-\x0D]+"
#: Characters of the punctuation rule, and the most of them in 100 word characters.
MARKS, MOST_MARKS = "#*$%&<>=_~^!", 10
#: Bars that make a line navigation, at least, and words per bar, at most.
BARS, WORDS_PER_BAR = 3, 4
#: Phrases of the boilerplate rule (lower case), and the longest line in words that they condemn.
PHRASES = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "click here", "sign up", "log in", "subscribe to", "share on", "lorem ipsum", "licensed under", "released under", "copyright (c)")
LONGEST = 40
#: Most of a document's word characters, in 100, that removed lines may hold.
MOST_LOST = 50


def without(text: F.Column, chars: str) -> F.Column:
    return F.translate(text, chars, "")


def counted(text: F.Column, chars: str) -> F.Column:
    return F.length(text) - F.length(without(text, chars))


def judged_lines(lines: F.Column) -> F.Column:
    """Of an array of lines, structs (line, chars, bad); each count is made once, phrases are sought in short lines only."""
    counts = F.transform(lines, lambda x: F.struct(x.alias("line"), F.length(without(x, SPACE)).cast("long").alias("chars"), counted(x, MARKS).alias("marks"), (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))).alias("bars"), F.size(F.array_remove(F.split(x, WORDS_APART), "")).alias("n_words")))
    short = F.transform(counts, lambda y: F.struct(y["line"].alias("line"), y["chars"].alias("chars"), y["marks"].alias("marks"), y["bars"].alias("bars"), y["n_words"].alias("n_words"), F.when(y["n_words"] <= LONGEST, F.lower(y["line"])).alias("low")))

    def bad(y: F.Column) -> F.Column:
        phrase = F.lit(False)
        for p in PHRASES:
            phrase = phrase | y["low"].contains(p)
        marks = 100 * y["marks"] > MOST_MARKS * y["chars"]
        return marks | (y["bars"] >= BARS) | ((y["bars"] >= 1) & (WORDS_PER_BAR * y["bars"] >= y["n_words"])) | (y["low"].isNotNull() & phrase)

    return F.transform(short, lambda y: F.struct(y["line"].alias("line"), y["chars"].alias("chars"), bad(y).alias("bad")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_bad_lines, lost_chars)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    cut = base.select(
        "doc_id",
        F.array_remove(F.split("t", WORDS_APART), "").alias("w"),
        F.filter(judged_lines(F.split("t", "\n")), lambda y: y["chars"] > 0).alias("judged"),
        counted(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
    )
    n = F.size("w")
    third = F.greatest(n - 2, F.lit(0))
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.arrays_zip(F.slice("w", F.lit(1), third).alias("a"), F.slice("w", F.lit(2), third).alias("b"), F.slice("w", F.lit(3), third).alias("c"), places.alias("p"))
    sorted_ = cut.select("doc_id", "n_symbols", n.cast("long").alias("n_words"), (F.size("judged") - F.size(F.array_distinct("judged.line"))).cast("long").alias("n_dup_lines"), F.transform("judged", lambda y: F.struct(y["chars"].alias("chars"), y["bad"].alias("bad"))).alias("judged"), F.sort_array(windows).alias("s"))
    # neighbours in sorted order that are equal windows give the places of all windows found twice or more
    m = F.greatest(F.size("s") - 1, F.lit(0))
    twice = F.zip_with(F.slice("s", F.lit(1), m), F.slice("s", F.lit(2), m), lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.array(x["p"], y["p"])))
    repeated = sorted_.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))).drop("s")
    k = F.size("starts")
    follow = F.concat(F.slice("starts", F.lit(2), k), F.array(F.lit(2147483647)))
    covered = F.when(k > 0, F.aggregate(F.zip_with("starts", follow, lambda x, y: F.least(F.lit(3), y - x)), F.lit(0), lambda a, x: a + x)).otherwise(0)
    bad = F.filter("judged", lambda x: x["bad"])
    counts = repeated.select(
        "doc_id", "n_words", F.aggregate("judged.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("word_chars"), "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"),
        F.size("judged").cast("long").alias("n_lines"), F.size(bad).cast("long").alias("n_bad_lines"),
        F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("lost_chars"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = ~failed & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict.alias("kept"), "n_lines", "n_bad_lines", "lost_chars")


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the lines that break a rule removed from their texts."""
    lines = F.filter(judged_lines(F.split(F.col(text_col), "\n")), lambda y: (y["chars"] == 0) | ~y["bad"])
    return docs.withColumn(text_col, F.array_join(F.transform(lines, lambda y: y["line"]), "\n"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: judge() in DuckDB's SQL.
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w0 as (select r, unnest(string_split_regex(t, '[\x20\x09-\x0D]+')) as w, generate_subscripts(string_split_regex(t, '[\x20\x09-\x0D]+'), 1) as p from d),
w as (select r, w, row_number() over (partition by r order by p) as p from w0 where w <> ''),
g as (select r, p, w || ' ' || lead(w) over (partition by r order by p) || ' ' || lead(w, 2) over (partition by r order by p) as g from w),
rep as (select r, p from (select r, p, count(*) over (partition by r, g) as c from g where g is not null) where c >= 2),
cov as (select r, count(distinct q) as n from (select r, unnest([p, p + 1, p + 2]) as q from rep) group by r),
l0 as (select r, unnest(string_split(t, chr(10))) as l from d),
l1 as (select r, l, length(translate(l, {" || ".join(f"chr({ord(c)})" for c in SPACE)}, '')) as chars from l0),
l2 as (select r, l, chars, len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as nw,
  length(l) - length(translate(l, '|', '')) as bars, length(l) - length(translate(l, {quoted(MARKS)}, '')) as marks from l1 where chars > 0),
l3 as (select r, l, chars, (100 * marks > {MOST_MARKS} * chars) or bars >= {BARS} or (bars >= 1 and {WORDS_PER_BAR} * bars >= nw)
  or (nw <= {LONGEST} and ({" or ".join(f"contains(lower(l), {quoted(p)})" for p in PHRASES)})) as bad from l2),
ls as (select r, count(*) as n_lines, count(*) - count(distinct l) as dup, count(*) filter (bad) as n_bad, coalesce(sum(chars) filter (bad), 0) as lost from l3 group by r),
ws as (select r, count(*) as n, sum(length(w)) as chars from w group by r),
b as (select d.doc_id, coalesce(ws.n, 0)::bigint as n_words, coalesce(ws.chars, 0)::bigint as word_chars, (length(t) - length(translate(t, {quoted(SYMBOLS)}, '')))::bigint as n_symbols,
  coalesce(dup, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_bad, 0)::bigint as n_bad_lines, coalesce(lost, 0)::bigint as lost_chars
  from d left join ws using (r) left join cov using (r) left join ls using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed) and 100 * lost_chars <= {MOST_LOST} * word_chars as kept, n_lines, n_bad_lines, lost_chars from f
"""
