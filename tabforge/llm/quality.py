"""Line-first quality rules (operator 7); DataFrame functions only.

Lines are judged before the document: a line that is navigation, decorated with markup symbols,
shouted, a known boilerplate sentence, or long without any sentence mark is removed.  A document is
rejected if the base rules fail (too short, or too many words in repeated 8-word windows) or if
the removed lines held more than ``max_lost`` of its words.  Everything is one projection per row: no
shuffle, no Python.

Null and empty texts have no words: zero counts, base_failed, not kept.  Repeated rows are judged
alike; other columns pass through ``filter_documents`` and are not read.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed_text

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document goes if its removed lines held more than this percentage of its words.
MAX_LOST_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SENTENCE_MARK = r"[.!?…。！？]"
SEPARATOR = r"(?:^|\s)(?:\||»|›|>|·|•|/|–|—|-)(?=\s|$)"
UPPER, LETTER = r"\p{Lu}", r"\p{L}"
BOILERPLATE = (r"(?i)(?:enable javascript|uses cookies|accept cookies|cookie policy|privacy policy|terms of (?:use|service)"
               r"|lorem ipsum|click here|subscribe to our|sign up for|back to top|skip to content|page not found)")
#: Lines up to this many words need no sentence mark.
HEADING_WORDS = 12


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Binds an expensive value once, so that a lambda refers to it and does not compute it again."""
    return F.transform(F.array(value), use)[0]


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once per row: a generator of one row is never merged into later filters or lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def line_words(line: Column) -> Column:
    """Every word, with the white space around it, becomes one character; that is cheaper than a list of the words."""
    return F.when(line.rlike(WORD), F.length(F.regexp_replace(line, f"{SPACE}*{WORD}+{SPACE}*", "w"))).otherwise(0)


def bad_line(line: Column, words: Column) -> Column:
    """True for a line of so many words that the rules remove; lines without a word stay."""
    letters = F.length(line) - F.length(F.regexp_replace(line, f"{LETTER}+", ""))
    navigation = _count(line, SEPARATOR) * 5 >= words
    markup = _count(line, SYMBOLS) * 10 >= F.length(line)
    shouted = (words >= 5) & ((_count(line, "!!") * 5 >= words) | (_count(line, UPPER) * 10 >= letters * 6))
    no_sentence = (words > HEADING_WORDS) & ~line.rlike(SENTENCE_MARK)
    return (words > 0) & (navigation | markup | shouted | no_sentence | line.rlike(BOILERPLATE))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of 8 found twice or more: windows are hashed, equal hashes are neighbours
    after a sort, and the places of repeated windows are merged from left to right."""
    places = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda each: F.transform(places, lambda i: F.xxhash64(F.slice(each, i, WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = _let(pairs, lambda s: F.transform(
            F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])),
            lambda x: x["p"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(twice), start, lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    repeated = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) >= WINDOW, repeated).otherwise(0)


def measured(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds the base counts, the verdicts and the cleaned text to a table, under ``prefix``ed names."""
    p = prefix
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = _once(df, {f"{p}words": F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), f"{p}lines": F.split(text, "\n")})
    words, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    real = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = _once(step, {
        f"{p}n_words": F.size(words).cast("long"),
        f"{p}word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
        f"{p}n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        f"{p}n_dup_lines": _let(real, lambda r: F.size(r) - F.size(F.array_distinct(r))).cast("long"),
        f"{p}n_repeat_words": repeat_words(words).cast("long"),
        f"{p}lost": F.transform(lines, lambda x: _let(line_words(x), lambda n: F.when(bad_line(x, n), n).otherwise(0))),
    }).drop(f"{p}words")
    lost = F.col(f"{p}lost")
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words"))
    return (_once(step, {
        f"{p}base_failed": failed, f"{p}n_lost_words": F.aggregate(lost, F.lit(0), lambda a, n: a + n).cast("long"),
        f"{p}n_lost_lines": F.size(F.filter(lost, lambda n: n > 0)).cast("long"),
        f"{p}clean_text": F.array_join(F.filter(lines, lambda x, i: F.get(lost, i) == 0), "\n")})
        .withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (100 * F.col(f"{p}n_lost_words") <= MAX_LOST_PERCENT * F.col(f"{p}n_words")))
        .drop(f"{p}lines", f"{p}lost"))


def filter_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept rows with their columns as they were, the text without its removed lines."""
    p = "__q_"
    out = measured(df, text_col, p).where(F.col(f"{p}kept"))
    return out.select(*[F.col(f"{p}clean_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(keyed_text(documents(spark, sf_dir), "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lost_lines", "n_lost_words")


_LINE = r"""(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))"""
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i AS p, array_to_string(words[i:i + 7], ' ') AS g
        FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, p - coalesce(q, -7))) AS n_repeat_words
        FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM rep) GROUP BY rid),
ln AS (SELECT rid, x, {_LINE} AS n, length(x) AS l FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d)),
bad AS (SELECT rid, count(*) AS n_lost_lines, sum(n) AS n_lost_words FROM (SELECT rid, n, (
          len(regexp_extract_all(regexp_replace(x, '([\x20\x09-\x0D])', '\1\1', 'g'),  -- doubled: separators side by side each have their own
                                 '(?:^|[\x20\x09-\x0D])(?:\||»|›|>|·|•|/|–|—|-)(?:[\x20\x09-\x0D]|$)')) * 5 >= n
          OR len(regexp_extract_all(x, '{SYMBOLS}')) * 10 >= l
          OR (n >= 5 AND (len(regexp_extract_all(x, '!!')) * 5 >= n
                          OR len(regexp_extract_all(x, '\p{{Lu}}')) * 10 >= len(regexp_extract_all(x, '\p{{L}}')) * 6))
          OR (n > {HEADING_WORDS} AND NOT regexp_matches(x, '{SENTENCE_MARK}'))
          OR regexp_matches(x, '{BOILERPLATE}')) AS b FROM ln WHERE n > 0) WHERE b GROUP BY rid),
m AS (SELECT d.doc_id, len(w.words) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_extract_all(d.text, '{SYMBOLS}')) AS n_symbols, len(w.lines) - len(list_distinct(w.lines)) AS n_dup_lines,
             CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(b.n_lost_lines, 0) AS BIGINT) AS n_lost_lines, CAST(coalesce(b.n_lost_words, 0) AS BIGINT) AS n_lost_words
      FROM d JOIN w USING (rid) LEFT JOIN cov c USING (rid) LEFT JOIN bad b USING (rid))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words) AS kept
FROM m
"""
