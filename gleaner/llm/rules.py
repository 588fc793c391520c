"""Operator 10: a table of quality thresholds compiled into one Spark projection.

``RULES`` is data: (name, measure, lowest, highest).  ``measures`` are column
expressions of the text alone, ``verdict`` turns the table into one boolean
expression; no user function, join or shuffle is involved.

Defined cases: a null or empty text has no words (every count 0, base_failed, no
measure of the table is taken of it);
texts of any length are read whole; repeated rows give repeated rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the four languages.  Fixed values.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was",
              "are", "be", "by", "this", "or", "an", "le", "la", "les", "de", "des", "du", "un", "une",
              "et", "est", "que", "qui", "dans", "en", "pour", "par", "sur", "au", "pas", "der", "die",
              "das", "und", "ist", "den", "von", "zu", "mit", "im", "auf", "für", "eine", "sich", "el",
              "los", "las", "y", "del", "se", "su", "una", "no", "con", "para", "lo")

#: (name, measure, lowest allowed, highest allowed); None: no bound.
RULES = (
    ("length", "n_words", 20, None),
    ("mean_word_length", "word_chars / n_words", 2.0, 25.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.4),
    ("stop_word_share", "n_stop_words / n_words", 0.01, None),
    ("duplicate_line_share", "n_dup_lines / n_lines", None, 0.5),
)


def let(value: Column, fn) -> Column:
    """Bind a value once for several uses inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""
    def windows(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def repeated(s):
        return F.transform(
            F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])

    def covered(h):
        starts = F.sort_array(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                                  repeated))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + WINDOW).alias("end"),
                                  (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n")))["n"]

    found = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows),
                lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > WINDOW, found).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the eight measures: projections only, words split once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(words_of(text), lambda w: F.struct(
        F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).alias("n_stop_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"),
                                            (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    got = docs.select(
        "doc_id", by_word.alias("w"), by_line.alias("x"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    names = ("w.n_words", "w.n_repeat_words", "w.n_stop_words", "x.n_lines", "x.n_dup_lines")
    return got.select("doc_id", "word_chars", "n_symbols",
                      *[F.col(n).cast("long").alias(n[2:]) for n in names])


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression (a null ratio passes).

    Each measure is guarded by itself, as Spark may evaluate it ahead of the others: a
    measure with two bounds is a common subexpression.  Without words there is none."""
    out = F.lit(True)
    for _, measure, low, high in rules:
        m = F.when(F.col("n_words") > 0, F.expr(measure))
        if low is not None:
            out = out & F.coalesce(m >= low, F.lit(True))
        if high is not None:
            out = out & F.coalesce(m <= high, F.lit(True))
    return out


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs``."""
    got = measures(docs)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(table_path(sf_dir, "documents")))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT rid, i, list_slice(words, i, i + 7) AS win
        FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS k FROM rep WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
        len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop_words
      FROM t JOIN w USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words >= 20 AND word_chars / n_words BETWEEN 2 AND 25 AND n_symbols / n_words <= 0.4
  AND n_stop_words / n_words >= 0.01 AND n_dup_lines / n_lines <= 0.5 AS kept FROM b
"""
