"""Operator 7: language identification by bit-sliced Bloom filters of n-grams.

Every language owns one bit of a row of 64-bit words, one word for 64 languages.  The
filters of all languages are stored sliced: row ``i`` of the slice table has bit ``l``
set when position ``i`` of the filter of language ``l`` is set, so the AND of a few
rows, word by word, returns all the languages that contain an n-gram at once.  Per-language popcounts over the
n-grams of a text, corrected for each filter's false-positive rate, decide.

Learning counts n-grams (as 22-bit fingerprints, ``ID_BITS``) over all training
rows: each task counts its first ``HELD`` languages into fixed arrays and hands on the
counts of others batch by batch.  A language's filter takes the n-grams whose share in
it is at least ``LEAST`` and at least ``RATIO`` of the highest share in any language.

Defined cases: a null text or one without a letter is ``und`` with score 0; an
empty table gives an empty result; without training rows every text is ``und``;
ties go to the language with more training rows, then the smaller name; repeated rows give
repeated rows; extra columns are ignored; any number of languages.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import crc_mod, map_batches, mix

N, ID_BITS, LEAST, RATIO = 4, 22, 2e-6, 0.15
PROBES, BITS_PER_ITEM, HELD = 3, 10, 16


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def grams(texts: list, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram fingerprints of all texts in order, n-grams per text, whether it has a letter).

    A text is lower-cased, every other character becomes a space, runs of spaces
    become one; an n-gram that starts with a space counts, one that ends in a
    longer run doesn't exist."""
    codes = [np.frombuffer(f"  {(t or '').lower()}  ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes])
    c = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(codes), dtype=np.int32), sizes)
    high = c >= 0x10000
    is_letter = letters[np.where(high, 0, c)]
    if high.any():
        is_letter[high] = [chr(x).isalpha() for x in c[high]]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]           # the one space after a letter
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int) if len(sizes) else np.zeros(0, int)
    keep[first] = True                   # and the one before the first
    c = np.where(is_letter, c, np.uint32(32))[keep].astype(np.uint64)
    doc = doc[keep]
    has = np.bincount(doc, c != 32, len(codes)) > 0 if len(codes) else np.zeros(0, bool)
    if len(c) < N:
        return np.zeros(0, np.int64), np.zeros(len(codes), np.int64), has
    h = c[: len(c) - N + 1].copy()
    for k in range(1, N):
        h = h * np.uint64(1 << 16 | 0x1F35) + c[k: len(c) - N + 1 + k]
    same = doc[: len(h)] == doc[N - 1:]
    ids = (mix(h[same]) >> np.uint64(64 - ID_BITS)).astype(np.int64)
    return ids, np.bincount(doc[: len(h)][same], minlength=len(codes)), has


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, id, n, total): counts of every fingerprint over all ``rows`` (text, lang)."""
    import pyarrow as pa

    def counted(lang, at, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n.astype(np.int64))],
                                          names=["lang", "id", "n"])

    def run(batches):
        letters, counts = letter_table(), {}
        for batch in batches:
            step = max(1, int(batch.num_rows * 8e6 / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step).to_pydict()
                by = {}
                for t, x in zip(part["text"], part["lang"]):
                    by.setdefault(x, []).append(t)
                for lang, texts in by.items():
                    ids, _, _ = grams(texts, letters)
                    if lang not in counts and len(counts) == HELD:
                        yield counted(lang, *np.unique(ids, return_counts=True))
                        continue
                    if lang not in counts:
                        counts[lang] = np.zeros(1 << ID_BITS, np.int32)
                    counts[lang] += np.bincount(ids, minlength=1 << ID_BITS).astype(np.int32)
        for lang, n in sorted(counts.items()):
            at = np.flatnonzero(n)
            yield counted(lang, at, n[at])

    return (rows.select("text", "lang").mapInArrow(run, "lang string, id long, n long")
            .groupBy("lang", "id").agg(F.sum("n").alias("n")))


def learn(rows: DataFrame) -> dict:
    """Bit-sliced filters from all ``rows`` (text, lang)."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    langs = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    from pyspark.sql import Window

    counts = count_grams(rows)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    # at most 2^ID_BITS fingerprints: the filters are bounded, whatever the corpus
    best = F.max("share").over(Window.partitionBy("id"))
    kept = (share.withColumn("best", best).where((F.col("share") >= LEAST) & (F.col("share") >= RATIO * F.col("best")))
            .groupBy("id").agg(F.collect_set("lang").alias("langs")))
    at = {x: i for i, x in enumerate(langs)}
    got = kept.toPandas().sort_values("id")
    ids = got["id"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(ids)), [len(ls) for ls in got["langs"]])
    bit = np.array([at[x] for ls in got["langs"] for x in ls], np.int64)
    masks = np.zeros((len(ids), max(1, -(-len(langs) // 64))), np.uint64)
    np.bitwise_or.at(masks, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    size = max(1024, BITS_PER_ITEM * len(ids))
    slices = np.zeros((size, masks.shape[1]), np.uint64)
    for p in range(PROBES):
        np.bitwise_or.at(slices, probe(ids, p, size), masks)
    fill = [on(slices, i).mean() for i in range(len(langs))]
    return {"langs": langs, "slices": slices, "false": np.array(fill) ** PROBES}


def probe(ids: np.ndarray, p: int, size: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + np.uint64((p + 1) << 40)) % np.uint64(size)).astype(np.int64)


def on(masks: np.ndarray, i: int) -> np.ndarray:
    """The bit of language ``i`` in each row."""
    return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)


def languages_of(model: dict, ids: np.ndarray) -> np.ndarray:
    """The words of bits of all languages whose filter contains each n-gram."""
    out = model["slices"][probe(ids, 0, len(model["slices"]))]
    for p in range(1, PROBES):
        out &= model["slices"][probe(ids, p, len(model["slices"]))]
    return out


def predict(model: dict, texts: list, letters: np.ndarray) -> tuple[list, np.ndarray]:
    ids, sizes, has = grams(texts, letters)
    doc = np.repeat(np.arange(len(texts)), sizes)
    masks = languages_of(model, ids)
    hits = np.zeros((len(texts), max(len(model["langs"]), 1)))
    for i in range(len(model["langs"])):
        hits[:, i] = np.bincount(doc, on(masks, i).astype(float), len(texts))
        hits[:, i] = np.maximum(hits[:, i] - sizes * model["false"][i], 0) / (1 - model["false"][i] + 1e-12)
    total = hits.sum(1)
    best = hits.argmax(1) if len(texts) else np.zeros(0, int)
    known = has & (len(model["langs"]) > 0)
    top = hits.max(1) if len(texts) else total
    score = np.where(known, np.where(total > 0, top / np.maximum(total, 1e-12), 1 / max(len(model["langs"]), 1)), 0.0)
    return [model["langs"][b] if k else "und" for b, k in zip(best, known)], np.clip(score, 0, 1)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    def fn(cols, letters):
        lang, score = predict(model, cols["text"], letters)
        return {"doc_id": cols["doc_id"], "lang_pred": lang, "score": score}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn,
                       "doc_id long, lang_pred string, score double", start=letter_table)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents")).select("doc_id", "text", "lang")
    model = learn(docs.where(crc_mod("doc_id", 3) != 1).select("text", "lang"))
    return (identify(docs, model)
            .select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"))
