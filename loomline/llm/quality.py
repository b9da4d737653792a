"""Quality rules, lines first.

Each line of a text is held against punctuation, navigation and boilerplate
rules; failing lines are removed. A document is then rejected if it fails the
base rules (too few words, too many words in repeated five-word windows) or if
over half of its words were in removed lines.

All work is within a row: no shuffle, no Python. Five-word windows are compared
by a 64-bit hash (two different ones of a text of 20,000 words collide with a
chance of about 1e-11); only texts that hold a repeated window are sorted.

Defined results: a null or empty text has no words, fails the base rules, and
stays null or empty. Rows are independent, so ties and repeated rows give equal
results, and an empty table an empty one. Other columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import GAP, SPACES, WORD, masked, unmasked

SYMBOLS = "#*$%&|<>"
#: A word that ends a sentence, closing marks included.
SENTENCE_END = r"""[.!?…][)"'”»]*(?:[\x20\x09-\x0D]|\z)"""
#: A word that shouts.
SHOUT = r"[!?]{2,}(?:[\x20\x09-\x0D]|\z)"
#: A run of marks in place of, or hung on, a word.
MARKS = r"[#*$%&]{2,}"
#: A separator between entries.
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|>»•·](?:[\x20\x09-\x0D]|\z)"
#: What a line must hold for counting marks to be worth while.
ANY_MARK = r"[|>»•·]|[#*$%&]{2}|[!?]{2}"
#: Phrases of notices around a text.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "subscribe to our", "released under the", "licensed under", "click here")
#: Entries of menus, as whole lines.
ENTRIES = ("home", "menu", "search", "next", "previous", "back to top", "skip to content", "log in", "login", "sign in", "sign up", "register", "contact", "contact us", "about us", "share", "read more", "site map", "sitemap")
#: Lines of fewer words need not end a sentence.
LINE_WORDS = 8
MIN_WORDS = 10
REPEAT_PERCENT = 20
LOST_PERCENT = 50
WINDOW = 5


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>"))


def failing_rule(line: Column, n: Column) -> Column:
    """The first rule that a line of n words fails, else null. Counts run only on lines that hold such characters at all."""
    def count(pattern: str) -> Column:
        return F.regexp_count(line, F.lit(pattern))

    marked = (
        F.when(count(SEPARATOR) >= F.greatest(F.ceil(n / 4), F.lit(3)), "navigation")
        .when(count(MARKS) * 4 >= n, "punctuation")
        .when(count(SHOUT) * 2 >= n, "punctuation")
    )
    return F.coalesce(
        F.when(line.rlike(ANY_MARK) & (n > 0), marked),
        F.when(n == 0, F.lit(None)).when((n >= LINE_WORDS) & ~line.rlike(SENTENCE_END), "punctuation").when(_any_phrase(line), "boilerplate").when((n <= 3) & F.lower(F.btrim(line, F.lit(SPACES))).isin(*ENTRIES), "navigation"),
    )


def _any_phrase(line: Column) -> Column:
    found, low = F.lit(False), F.lower(line)
    for phrase in BOILERPLATE:  # plain searches are cheaper than a pattern
        found = found | F.contains(low, F.lit(phrase))
    return found


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text's failing lines removed in ``clean_text``, and the counts and verdicts of the rules.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, lost_words (long), base_failed, kept (boolean), clean_text; existing ones of these names are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_words", "base_failed", "kept", "clean_text"]
    docs, names = masked(docs)
    own, text = [F.col(c) for c in docs.columns], names[text]
    t = F.coalesce(F.col(text), F.lit(""))
    # a line feed is a gap between words, so that the lines' words are the text's
    a = docs.select(*own, F.transform(F.split(t, "\n", -1), lambda x: F.struct(x.alias("line"), words_of(x).alias("words"))).alias("_split"))
    lines = F.transform("_split", lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n")))
    b = a.select(*own, F.flatten(F.transform("_split", lambda x: x["words"])).alias("_words"), lines.alias("_lines"))
    hashes = F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW)))))
    judged = F.transform("_lines", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), failing_rule(x["line"], x["n"]).alias("rule")))
    b = b.select(*own, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), hashes.alias("_hashes"), judged.alias("_judged"))
    order = F.when(F.size("_hashes") > F.size(F.array_distinct("_hashes")), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    c = b.select(*own, "n_words", "word_chars", order.alias("_sorted"), "_judged")
    at = F.sort_array(F.transform(F.filter("_sorted", lambda x, j: (x["h"] == F.get("_sorted", j - 1)["h"]) | (x["h"] == F.get("_sorted", j + 1)["h"])), lambda x: x["i"]))
    worded = F.transform(F.filter("_judged", lambda x: x["n"] > 0), lambda x: x["line"])
    d = c.select(*own, "n_words", "word_chars", "_judged", at.alias("_at"), worded.alias("_worded"), F.filter("_judged", lambda x: x["rule"].isNotNull()).alias("_bad"))
    covered = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda x, y: x + y)
    e = d.select(
        *own,
        "n_words",
        "word_chars",
        F.when(t.rlike(f"[{SYMBOLS}]"), F.regexp_count(t, F.lit(f"[{SYMBOLS}]"))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_bad").cast("long").alias("n_bad_lines"),
        F.aggregate("_bad", F.lit(0), lambda s, x: s + x["n"]).cast("long").alias("lost_words"),
        F.when(F.col(text).isNotNull(), F.array_join(F.transform(F.filter("_judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")).alias("clean_text"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    e = e.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * LOST_PERCENT))
    return e.select(*unmasked(names, added), *added)


def _quote(pattern: str) -> str:
    return pattern.replace("'", "''")


#: The same counts and verdicts by a row for each line and window.
SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
l as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
m as (select doc_id, line, len(regexp_extract_all(line, '{WORD}')) as n from l),
f as (
  select doc_id, line, n, n > 0 and (
    (len(regexp_extract_all(line, '{SEPARATOR}')) >= 3 and len(regexp_extract_all(line, '{SEPARATOR}')) * 4 >= n)
    or len(regexp_extract_all(line, '{MARKS}')) * 4 >= n
    or len(regexp_extract_all(line, '{SHOUT}')) * 2 >= n
    or (n >= {LINE_WORDS} and not regexp_matches(line, '{_quote(SENTENCE_END)}'))
    or regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')
    or (n <= 3 and lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) in {ENTRIES})) as bad
  from m),
g as (
  select doc_id, count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines,
    count(*) filter (bad) as n_bad_lines, coalesce(sum(n) filter (bad), 0) as lost_words
  from f group by doc_id),
x as (select doc_id, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: {{'i': i, 'v': array_to_string(w[i:i + {WINDOW - 1}], ' ')}})) as s from d where len(w) >= {WINDOW}),
y as (select doc_id, s.i as i, count(*) over (partition by doc_id, s.v) as c from x),
z as (select doc_id, count(distinct i + k) as n_repeat_words from y, range({WINDOW}) as r(k) where c > 1 group by doc_id),
v as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '{GAP}', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(t, '[{SYMBOLS}]'))::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, n_bad_lines::bigint as n_bad_lines, lost_words::bigint as lost_words
  from d join g using (doc_id) left join z using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from v)
select *, not base_failed and 100 * lost_words <= {LOST_PERCENT} * n_words as kept from b
"""
