"""Operator 11: phrase collocations by the stripes pattern.

A stripe is an associative counter of the words that follow a prefix; the entry "" of
a one-word prefix counts the rest (no word follows in the piece, or a rare one), so that
the sum of its stripe is the word's count.  Tasks build the stripes of their batches and ship
them whole, one row per prefix; stripes of one prefix meet in one partition and are
merged elementwise; entries below the threshold are then folded into the rest.  The
stripes of one-word prefixes give the counts of words and of pairs; those of pairs
give the counts of triples and the largest extension of every pair.

A phrase that is frequent consists of frequent words and pairs, so the first pass
only counts hashes of words, and a stripe names a word only if a bitmap of fixed
size (``BITS``) says that its prefix and extension may be frequent.  The bitmap has no false
negatives and every occurrence is judged alike: counts are exact.

Prefixes with more than 1 / ``SHARE`` of all words (at most ``SHARE`` of them) are
split by the hash of the next word, and joins find their counts in a broadcast
table of at most that many rows; no other key has more than that share of the rows.

A task holds one step of ``BATCH_BYTES`` of text, with nothing of 8 bytes for each byte of
it, and hands its stripes on in batches of about ``ENTRIES`` entries.

Defined cases: null and empty texts and pieces without words have no phrases; a
null lang is ``und``; very long texts and words are whole; repeated rows count each;
of equal scores and counts the smaller phrase in UTF-8 bytes comes first; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import drop, mix, prefix_sums, slices, span_hashes, store

LEAST, TOP, SCALE, SUBSUMED = 10, 2000, 1_000_000, 50
BITS, SHARE, BATCH_BYTES = 26, 10_000, 4e6
#: Entries of stripes in one batch that a task hands on.
ENTRIES = 100_000
#: Bytes of words that are hashed at once: sums and powers take 40 bytes for each.
HASHED = 1 << 18
#: Rows of one lang that one task ranks.
BLOCK = 16_000
_BITMAP = 1 << 15                                       # bits of one row of Spark's bitmap functions
_K = np.uint64(0xD6E8FEB86659FD93)

# tables of bytes.translate: an index by uint8 would take 8 bytes for each byte of text
_CLASS = bytes(2 if b in b".,;:!?\n\v\f\r" else 1 if b in b" \t" else 0 for b in range(256))    # 0 word, 1 blank, 2 end of a piece
_LOWER = bytes(range(256)).lower()


# --- one batch ------------------------------------------------------------------------

def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    out = np.empty(len(words), np.uint64)
    edges = np.unique(np.append(np.searchsorted(off[:-1], np.arange(0, off[-1], HASHED)), [0, len(words)]))
    for low, high in zip(edges[:-1], edges[1:]):
        at = off[low:high + 1] - off[low]
        out[low:high] = span_hashes(prefix_sums(data[off[low]:off[high]]), at[:-1], at[1:])
    return out


def of_lang(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(word ^ (lang * _K))


def of_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _K + second)


class Words:
    """The words of a batch in order: ``code`` (into ``names``), ``lang`` (into
    ``langs``), ``hash`` of lang and word, and whether the ``next`` word is in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        lang = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = (text.buffers()[2] or pa.py_buffer(b""))[off[0]:off[-1]].to_pybytes().translate(_LOWER)
        off = off - off[0]
        kind = np.frombuffer(data.translate(_CLASS), np.uint8)
        word = kind == 0
        first, last = word.copy(), word.copy()
        np.greater(word[1:], word[:-1], out=first[1:])
        np.greater(word[:-1], word[1:], out=last[:-1])
        edge = off[:-1][np.diff(off) > 0]
        first[edge] = word[edge]
        edge = edge[edge > 0] - 1
        last[edge] = word[edge]
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        del first, last
        size = np.concatenate([[0], np.cumsum(end - start + 1)]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [
            None, pa.py_buffer(size), pa.py_buffer(np.frombuffer(data, np.uint8)[word])]).dictionary_encode()
        del data, word, end, size
        doc = np.searchsorted(off, start, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), start) + doc       # grows with every piece and text
        self.next = np.zeros(len(start), bool)
        self.next[:-1] = piece[1:] == piece[:-1]
        del kind, start, piece
        self.names = coded.dictionary.cast(pa.large_string())
        self.name_hash = hashes(self.names)
        self.code = coded.indices.to_numpy()
        self.langs = lang.dictionary.cast(pa.large_string())
        self.lang = lang.indices.to_numpy()[doc]
        del coded, doc
        # a lang and word together; their hash is computed once
        n = max(1, len(self.names))
        self.keys, of = np.unique(self.lang * np.int64(n) + self.code, return_inverse=True)
        self.of = of.astype(np.int32)
        self.key_hash = of_lang(self.name_hash[self.keys % n], hashes(self.langs)[self.keys // n])


def allowed(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def stripes(langs: pa.Array, prefixes: pa.Array, names: pa.Array, name_hash: np.ndarray, prefix: np.ndarray,
            lang_of: np.ndarray, after: np.ndarray, split: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, stripe) of occurrences: ``prefix`` (into ``prefixes``, of langs ``lang_of``)
    followed by ``after`` (0: the rest, else 1 + a name); the stripe of a prefix
    has ``split`` slices.

    Words hold no blank and no tab, so a key is "prefix TAB slice TAB lang" and a
    stripe is its entries "word TAB count" with blanks between."""
    n = len(names) + 1
    pairs, count = np.unique(prefix * np.int64(n) + after, return_counts=True)
    who, what = pairs // n, pairs % n
    del pairs, prefix, after
    part = np.zeros(len(who), np.int64)
    cut = np.flatnonzero((split > 1)[who] & (what > 0))
    if len(cut):
        part[cut] = name_hash[what[cut] - 1] % split[who[cut]].astype(np.uint64)
        order = np.lexsort((part, who))
        who, what, part, count = who[order], what[order], part[order], count[order]
        del order
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (part[1:] != part[:-1])
    at = np.append(np.flatnonzero(new), len(who))
    names = pa.concat_arrays([pa.array([""], pa.large_string()), names])

    def text(x):
        return pa.array(x).cast(pa.large_string())

    tab, blank = (pa.scalar(x, pa.large_string()) for x in ("\t", " "))
    edges = np.unique(np.append(np.searchsorted(at, np.arange(0, len(who), ENTRIES)), len(at) - 1))
    for low, high in zip(edges[:-1], edges[1:]):
        begin, of = at[low:high + 1], slice(at[low], at[high])
        entries = pc.binary_join_element_wise(names.take(pa.array(what[of])), text(count[of]), tab)
        row, begin = begin[:-1], begin - begin[0]
        key = pc.binary_join_element_wise(prefixes.take(pa.array(who[row])), text(part[row]), langs.take(pa.array(lang_of[who[row]])), tab)
        stripe = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(begin), entries), blank)
        yield pa.RecordBatch.from_arrays([key.cast(pa.string()), stripe.cast(pa.string())], names=["key", "stripe"])


def split_of(h: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Slices of the stripes with these hashes: ``hot`` has the hashes and slices of the large ones."""
    if not len(hot[0]):
        return np.ones(len(h), np.int64)
    at = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
    return np.where(hot[0][at] == h, hot[1][at], 1)


def words_of(batch: pa.RecordBatch, bits: np.ndarray, large: tuple) -> Iterator[pa.RecordBatch]:
    """Stripes of the one-word prefixes of a batch."""
    w = Words(batch)
    n = max(1, len(w.names))
    ok = allowed(bits, w.key_hash)[w.of]
    after = np.zeros(len(ok), np.int32)
    both = np.flatnonzero(ok[:-1] & ok[1:] & w.next[:-1])
    after[both] = w.code[both + 1] + 1
    del both
    return stripes(w.langs, w.names.take(pa.array(w.keys % n)), w.names, w.name_hash, w.of[ok], w.keys // n, after[ok],
                   split_of(w.key_hash, large))


def pairs_of(batch: pa.RecordBatch, bits: np.ndarray, large: tuple) -> Iterator[pa.RecordBatch]:
    """Stripes of the two-word prefixes of a batch."""
    w = Words(batch)
    n = np.int64(max(1, len(w.keys)))
    at = np.flatnonzero(w.next)
    pair, of = np.unique(w.of[at] * n + w.of[at + 1], return_inverse=True)
    one, two = pair // n, pair % n
    h = of_pair(w.key_hash[one], w.key_hash[two])
    good = allowed(bits, h)
    # only pairs that may be frequent, numbered anew
    number = np.where(good, np.cumsum(good) - 1, -1).astype(np.int32)
    one, two, h = one[good], two[good], h[good]
    id_at = np.full(len(w.code), -1, np.int32)
    id_at[at] = number[of]
    del at, pair, of, good, number
    # a triple that may be frequent is two such pairs in a row
    begin = np.flatnonzero((id_at[:-1] >= 0) & (id_at[1:] >= 0))
    name = max(1, len(w.names))
    text = [w.names.take(pa.array(w.keys[x] % name)) for x in (one, two)]
    prefixes = pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string()))
    return stripes(w.langs, prefixes, w.names, w.name_hash, id_at[begin], w.keys[one] // name, w.code[begin + 2] + 1, split_of(h, large))


# --- jobs -----------------------------------------------------------------------------

def count_words(docs: DataFrame) -> DataFrame:
    """(lang, null, n): words per lang; (null, h, n): occurrences per hash of a word that may be frequent."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in slices(batches, BATCH_BYTES):
            w = Words(batch)
            count, total = np.bincount(w.of, minlength=len(w.keys)), np.bincount(w.lang, minlength=len(w.langs))
            none = pa.nulls(len(w.keys), pa.string())
            yield pa.RecordBatch.from_arrays([none, pa.array(w.key_hash.view(np.int64)), pa.array(count, pa.int64())], schema=schema)
            yield pa.RecordBatch.from_arrays([w.langs.cast(pa.string()), pa.nulls(len(w.langs), pa.int64()), pa.array(total, pa.int64())],
                                             schema=schema)

    counted = docs.mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    return store(counted.where(f"h IS NULL OR n >= {LEAST}"), "words")


def bitmap_of(hashed: DataFrame) -> np.ndarray:
    """The bitmap (2^``BITS`` bits, whatever the input) of column h."""
    at = F.col("h").bitwiseAND((1 << BITS) - 1) + 1
    rows = hashed.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in rows:
        out[(r["b"] - 1) * (_BITMAP >> 3):][:_BITMAP >> 3] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def hot_of(hashed: DataFrame, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, slices) of the prefixes with at least ``cut`` occurrences: at most ``SHARE``."""
    rows = sorted((r["h"] & (2**64 - 1), -(-r["n"] // cut)) for r in hashed.where(F.col("n") >= cut).select("h", "n").collect())
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def merge(shipped: DataFrame, name: str) -> DataFrame:
    """Merged stripes as rows (lang, prefix, next, n): entries of at least ``LEAST`` and the rest.

    Stripes are dealt by prefix and slice once; what follows stays in the partition."""
    entries = shipped.repartition("key").select("key", F.explode(F.split("stripe", " ")).alias("e"))
    summed = entries.groupBy("key", F.substring_index("e", "\t", 1).alias("next")).agg(
        F.sum(F.substring_index("e", "\t", -1).cast("long")).alias("n"))
    folded = (summed.withColumn("next", F.when(F.col("n") >= LEAST, F.col("next")).otherwise(F.lit("")))
              .groupBy("key", "next").agg(F.sum("n").alias("n")))
    return store(folded.select(F.regexp_extract("key", r"(?s)^[^\t]*\t\d+\t(.*)$", 1).alias("lang"),
                               F.substring_index("key", "\t", 1).alias("prefix"), "next", "n"), name)


_STRIPE = "key string, stripe string"


def word_stripes(docs: DataFrame, bitmap: np.ndarray, hot: tuple) -> DataFrame:
    """Stripes of one-word prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, hot))

    def run(batches):
        for batch in slices(batches, BATCH_BYTES):
            yield from words_of(batch, *shared.value)

    return merge(docs.mapInArrow(run, _STRIPE), "word-stripes")


def pair_hashes(pairs: DataFrame) -> DataFrame:
    """h and n of (lang, prefix, next, n)."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            lang = hashes(batch.column("lang"))
            h = of_pair(of_lang(hashes(batch.column("prefix")), lang), of_lang(hashes(batch.column("next")), lang))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("n")], schema=schema)

    return pairs.select("lang", "prefix", "next", "n").mapInArrow(run, "h long, n long")


def pair_stripes(docs: DataFrame, bitmap: np.ndarray, hot: tuple) -> DataFrame:
    """Stripes of two-word prefixes, without a rest: a pair's count is its entry in the
    stripe of its first word."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, hot))

    def run(batches):
        for batch in slices(batches, BATCH_BYTES):
            yield from pairs_of(batch, *shared.value)

    return merge(docs.mapInArrow(run, _STRIPE), "pair-stripes")


def with_count(rows: DataFrame, counts: DataFrame, cut: int, key: str, name: str) -> DataFrame:
    """``rows`` with the count of (lang, ``key``) as ``name``; ``counts`` is (lang, phrase, f).

    Counts of ``cut`` and more, at most ``SHARE`` rows, are broadcast, and rows that find theirs
    there go to the second join under their own phrase, which meets nothing
    and spreads them; another key has at most ``cut`` / ``LEAST`` rows."""
    large = counts.where(F.col("f") >= cut).select("lang", F.col("phrase").alias(key), F.col("f").alias("_large"))
    small = counts.where(F.col("f") < cut).select("lang", F.col("phrase").alias("_probe"), F.col("f").alias("_small"))
    probe = F.when(F.col("_large").isNull(), F.col(key)).otherwise(F.concat(F.lit("\t"), F.col("phrase")))
    found = rows.join(F.broadcast(large), ["lang", key], "left").withColumn("_probe", probe).join(small, ["lang", "_probe"], "left")
    return found.withColumn(name, F.coalesce("_large", "_small")).drop("_probe", "_large", "_small")


def top_of(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The first ``top`` rows of every lang, with rank.  A task ranks about ``BLOCK`` rows
    of a lang; as long as a lang has more, each of its parts keeps its first ``top``."""
    block = max(BLOCK, 4 * top)
    while True:
        most = rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        if most <= block:
            return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(-(-most // block)))).orderBy(*order)
        before, rows = rows, store(rows.withColumn("_nth", F.row_number().over(part)).where(F.col("_nth") <= top).drop("_nth"), "ranked")
        drop(before)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of every lang."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = count_words(docs)
    per_lang = words.where("h IS NULL").select("lang", "n")
    total = per_lang.agg(F.sum("n")).first()[0] or 0
    cut = max(LEAST, -(-total // SHARE))
    hashed = words.where("h IS NOT NULL")
    ones = word_stripes(docs, bitmap_of(hashed), hot_of(hashed, cut))
    pairs = ones.where("next <> ''")
    hashed = store(pair_hashes(pairs), "pair-hashes")
    twos = pair_stripes(docs, bitmap_of(hashed), hot_of(hashed, cut))
    drop(hashed)

    f1 = store(ones.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("f")), "word-counts")
    f2 = pairs.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("f"))

    def score(l, r):
        wide = [F.col(c).cast("decimal(19,0)") for c in ("a", l, r)]
        return F.call_function("div", wide[0] * wide[0] * F.lit(SCALE).cast("decimal(7,0)"), wide[1] * wide[2])

    two = pairs.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("prefix").alias("w1"), F.col("next").alias("w2"),
                       F.col("n").alias("a"))
    three = twos.where("next <> ''").select(
        "lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.substring_index("prefix", " ", 1).alias("w1"),
        F.concat_ws(" ", F.substring_index("prefix", " ", -1), "next").alias("w23"), F.col("prefix").alias("w12"),
        F.col("next").alias("w3"), F.col("n").alias("a"))
    # the largest extension of a pair after it (in its stripe) and before it
    longer = (three.select("lang", F.col("w23").alias("phrase"), "a").unionByName(three.select("lang", F.col("w12").alias("phrase"), "a"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    two = two.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < SUBSUMED * F.col("a"), F.lit(True))).drop("longer")
    two = with_count(with_count(two, f1, cut, "w1", "l"), f1, cut, "w2", "r").withColumn("score", score("l", "r"))
    for key, counts, name in (("w1", f1, "l1"), ("w23", f2, "r1"), ("w12", f2, "l2"), ("w3", f1, "r2")):
        three = with_count(three, counts, cut, key, name)
    three = (three.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
             .withColumn("best", F.when(F.col("s1") <= F.col("s2"), F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"), F.col("s1").alias("score")))
                         .otherwise(F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"), F.col("s2").alias("score"))))
             .select("lang", "phrase", "a", "best.*"))
    scored = store(two.select("lang", "phrase", "a", "l", "r", "score").unionByName(three), "scored")
    best = top_of(scored, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(per_lang, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(table_path(sf_dir, "documents")))


SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS ws FROM p),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS c FROM (
    SELECT lang, k, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
    FROM w, range(1, 4) t(k)) GROUP BY ALL),
words AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, c, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND c >= {LEAST}),
longer AS (
  SELECT lang, phrase, max(c) AS m FROM (
    SELECT lang, array_to_string(x[1:2], ' ') AS phrase, c FROM cand WHERE k = 3
    UNION ALL SELECT lang, array_to_string(x[2:3], ' '), c FROM cand WHERE k = 3) GROUP BY ALL),
parts AS MATERIALIZED (
  SELECT lang, k, phrase, c, j, array_to_string(x[1:j], ' ') AS p, array_to_string(x[j + 1:k], ' ') AS q FROM cand, range(1, 3) t(j) WHERE j < k),
cuts AS (
  SELECT parts.lang, parts.phrase, parts.c AS a, j, lf.c AS l, rf.c AS r,
         {SCALE}::HUGEINT * parts.c * parts.c // (lf.c::HUGEINT * rf.c) AS score
  FROM parts JOIN f lf ON lf.lang = parts.lang AND lf.phrase = p AND lf.k = j
  JOIN f rf ON rf.lang = parts.lang AND rf.phrase = q AND rf.k = parts.k - j),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts)
  LEFT JOIN longer USING (lang, phrase) WHERE o = 1 AND NOT coalesce(100 * m >= {SUBSUMED} * a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, n, CAST(score AS BIGINT) AS score
FROM best JOIN words USING (lang) QUALIFY rank <= {TOP}"""
