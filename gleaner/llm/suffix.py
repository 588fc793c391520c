"""Operator 4: removal of repeated 200-byte strings by column-wise construction of
a multi-string Burrows-Wheeler transform and its common prefixes.

The construction inserts one symbol of every string per round, right to left: a
round sorts the strings' suffixes by the new symbol, stably on the order of the
round before (the symbols read in that order are the round's part of the
transform), and the common prefix of two neighbours is one more than the minimum
over the stretch that lay between them.  Run over whole documents this takes as
many rounds as the longest document has bytes, each over everything, so the
corpus is cut first, without losing a match:

* Every 200-byte string contains a smallest 64-byte hash (its anchor, the
  leftmost of 137).  Equal strings have equal anchors at equal offsets, so all
  occurrences of a string meet in the bucket of its anchor, and adjacent strings
  with one anchor travel as one segment of at most 336 bytes.
* Anchors seen once in the corpus cannot be in a repeated string: dropped.
* Equal segments collapse into one with a count before they are shuffled.
* In a bucket, segments are aligned at the anchor: equal strings start in the
  same column, so a round has only suffixes of its own column to merge, and 336
  rounds do, whatever the corpus.  A task reads its sorted shuffle file in
  sequence, a bounded number of whole buckets at a time; the two columns of a
  round (transform and common prefixes) follow each other and aren't kept.
* A bucket of more than ``MAX_SEGMENTS`` distinct segments is split exactly: its
  200-byte strings are counted one by one under their own digest.

Every step is linear in its input.  A text that occurs twice or more is repeated
as a whole; it is one text here and only a source for others.

Defined cases: null counts as empty; texts under 200 bytes keep everything;
overlapping matches inside one text count; repeated rows are copies of each
other; a null doc_id stays null; an empty table gives an empty result; very long
texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import drop, prefix_sums, released, row_of, span_hashes, store

LENGTH, ANCHOR = 200, 64
SPAN = LENGTH - ANCHOR + 1                 # 137 anchors to choose from
WIDTH = SPAN - 1 + LENGTH                  # 336 columns of a bucket
MAX_SEGMENTS, CHUNK = 16_384, 16_384
STEP = 2e6                                 # bytes of text that a step holds


# --- anchors and segments -----------------------------------------------------------

def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, hash) of every run of 200-byte
    strings with one anchor; positions are relative to the text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    at = np.arange(n - ANCHOR + 1)
    h = span_hashes(prefix_sums(data), at, at + ANCHOR)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size:])
    pos = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)      # anchor of the string at each byte
    end = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(pos)]
    valid = np.arange(len(pos)) + LENGTH <= end[owner]
    key = np.where(valid, pos, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[-2], key, [-2]])))
    a, b = edge[:-1], edge[1:] - 1
    real = key[a] >= 0
    a, b = a[real], b[real]
    doc = owner[a]
    base = (end - sizes)[doc]
    return doc, a - base, b - base, pos[a] - base, h[pos[a]]


def _steps(batch: pa.RecordBatch, column: str):
    """(from row, to row, texts) in steps of about STEP bytes."""
    texts = batch.column(column).to_pylist()
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= STEP or i == len(texts) - 1:
            yield at, i + 1, texts[at:i + 1]
            at, held = i + 1, 0


def anchors(docs: DataFrame) -> DataFrame:
    """(hash, key, key2): the anchor of every run of every text."""
    schema = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("key2", pa.int64())])

    def run(batches):
        for batch in released(batches):
            key, key2 = (batch.column(c).to_numpy() for c in ("key", "key2"))
            for at, _, texts in _steps(batch, "data"):
                doc, _, _, _, h = runs(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(key[doc + at]), pa.array(key2[doc + at])], schema=schema)

    return docs.select("data", "key", "key2").mapInArrow(run, "hash long, key long, key2 long")


def segments(work: DataFrame) -> DataFrame:
    """(bucket, d1, d2, off, seg, n, key, key2, copies, starts): segments with a repeated
    anchor; ``off`` is the anchor's offset, ``starts`` where the text has the segment."""
    schema = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("off", pa.int32()), ("seg", pa.binary()),
                        ("n", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("copies", pa.int64()),
                        ("starts", pa.list_(pa.int64()))])

    def run(batches):
        for batch in released(batches):
            cols = {c: batch.column(c).to_pylist() for c in ("key", "key2", "copies", "hashes")}
            for at, _, texts in _steps(batch, "data"):
                doc, a, b, p, h = runs(texts)
                h = h.view(np.int64)
                wanted = [np.array(x, np.int64) for x in cols["hashes"][at:at + len(texts)]]
                first = np.searchsorted(doc, np.arange(len(texts) + 1))
                out = {}
                for i, w in enumerate(wanted):
                    x = slice(first[i], first[i + 1])
                    hit = np.flatnonzero(np.isin(h[x], w)) + first[i]
                    for r in hit.tolist():
                        seg = texts[i][a[r]:b[r] + LENGTH]
                        out.setdefault((i, seg, int(p[r] - a[r]), int(h[r])), []).append(int(a[r]))
                rows = [(k[3], hashlib.md5(k[1]).digest(), k[2], k[1], len(v) * cols["copies"][at + k[0]],
                         cols["key"][at + k[0]], cols["key2"][at + k[0]], cols["copies"][at + k[0]], v)
                        for k, v in out.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return work.mapInArrow(run, "bucket long, digest binary, off int, seg binary, n long, key long, key2 long, "
                                "copies long, starts array<long>")


# --- the construction ----------------------------------------------------------------

def insert_columns(segs: list[bytes], offs: list[int]) -> np.ndarray:
    """Rounds of the construction over segments aligned at their anchors.  Row i of
    the result says which 200-byte strings of segment i also start in another
    segment (by column; the anchor is in column 136)."""
    m = len(segs)
    cols = np.full((WIDTH, m), 256, np.uint16)
    size = np.array([len(s) for s in segs])
    left = SPAN - 1 - np.array(offs)
    flat = np.frombuffer(b"".join(segs), np.uint8)
    row = np.repeat(np.arange(m), size)
    cols[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size - left, size), row] = flat
    order = np.arange(m)
    common = np.zeros(m, np.int16)
    out = np.zeros((m, SPAN), bool)
    for j in range(WIDTH - 1, -1, -1):
        symbols = cols[j, order]                         # the transform's column, in suffix order
        by = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[by]
        group = np.flatnonzero(np.diff(sorted_symbols, prepend=-1))
        fresh = np.zeros(m, np.int16)
        for s, e in zip(group.tolist(), [*group[1:].tolist(), m]):
            if e - s > 1 and sorted_symbols[s] != 256:
                old = by[s:e]
                fresh[s + 1:e] = np.minimum.reduceat(common[: old[-1] + 1], old[:-1] + 1) + 1
        order, common = order[by], fresh
        if j < SPAN:
            same = common >= LENGTH
            same[:-1] |= same[1:]                        # equal to the next or to the one before
            out[order[same], j] = True
    return out


def mask_of(row: np.ndarray, size: int, off: int, n: int) -> bytes:
    """One byte per 200-byte string of a segment: 1 if it is repeated."""
    count = size - LENGTH + 1
    if n > 1:
        return b"\1" * count
    return row[SPAN - 1 - off:SPAN - 1 - off + count].astype(np.uint8).tobytes()


def bucket_masks(distinct: DataFrame) -> DataFrame:
    """(bucket, digest, mask) of the segments that hold a repeated string, in buckets
    of bounded size."""
    schema = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("mask", pa.binary())])

    def solve(rows):
        table = insert_columns([r["seg"] for r in rows], [r["off"] for r in rows])
        masks = [mask_of(t, len(r["seg"]), r["off"], r["n"]) for t, r in zip(table, rows)]
        keep = [i for i, x in enumerate(masks) if b"\1" in x]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i]["bucket"] for i in keep], pa.int64()), pa.array([rows[i]["digest"] for i in keep], pa.binary()),
             pa.array([masks[i] for i in keep], pa.binary())], schema=schema)

    def run(batches):
        held = []
        for batch in released(batches):                            # sorted by bucket
            for r in batch.to_pylist():
                if len(held) >= CHUNK and held[-1]["bucket"] != r["bucket"]:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)

    return (distinct.repartition("bucket").sortWithinPartitions("bucket")
            .select("bucket", "digest", "off", "seg", "n").mapInArrow(run, "bucket long, digest binary, mask binary"))


def split_masks(distinct: DataFrame) -> DataFrame:
    """The same for segments of larger buckets: their strings are counted under
    their own digests, with partial counts before the shuffle."""
    def strings(batches):
        for batch in released(batches):
            out = []
            for r in batch.to_pylist():
                out += [(hashlib.md5(r["seg"][i:i + LENGTH]).digest(), r["bucket"], r["digest"], i, r["n"])
                        for i in range(len(r["seg"]) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64()))],
                names=["g", "bucket", "digest", "i", "n"])

    rows = distinct.select("bucket", "digest", "seg", "n").mapInArrow(
        strings, "g binary, bucket long, digest binary, i int, n long")
    often = rows.groupBy("g").agg(F.sum("n").alias("m")).where("m > 1").select("g")
    at = rows.join(often, "g", "left_semi").groupBy("bucket", "digest").agg(F.collect_set("i").alias("at"))
    sized = distinct.select("bucket", "digest", F.length("seg").alias("size")).join(at, ["bucket", "digest"])
    bits = F.transform(F.sequence(F.lit(0), F.col("size") - LENGTH),
                       lambda i: F.when(F.array_contains("at", i), "01").otherwise("00"))
    return sized.select("bucket", "digest", F.unhex(F.array_join(bits, "")).alias("mask"))


def cut(data: bytes, found) -> tuple[bytes, int, int]:
    """(what is left, removed bytes, removed runs) of a text with its masks."""
    cover = np.zeros(len(data) + 1, np.int32)
    for f in found:
        at = np.flatnonzero(np.frombuffer(f["mask"], np.uint8))
        for s in f["starts"]:
            cover[at + s] += 1
    # a string covers LENGTH bytes from its start
    hit = np.flatnonzero(cover[:-1])
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, hit, 1)
    np.add.at(edges, np.minimum(hit + LENGTH, len(data)), -1)
    gone = np.cumsum(edges[:-1]) > 0
    spans = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) > 0).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the two hashes that name a text, and its bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("data"), *text_keys())


def text_keys() -> tuple[Column, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text).alias("key"), F.xxhash64(F.sha2(text.cast("binary"), 256)).alias("key2")


def repeated(docs: DataFrame, keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(copies, cuts): copies (key, key2, copies) of every text, and for texts that
    occur once and lose bytes (key, key2, n_removed, n_spans, kept_sha256[, kept])."""
    rows = keyed(docs)
    long = rows.where(F.octet_length("data") >= LENGTH)
    copies = rows.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("copies"))
    found = store(anchors(long), "anchors")
    often = found.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("hash")
    wanted = (found.join(often, "hash").distinct().groupBy("key", "key2").agg(F.collect_list("hash").alias("hashes")))
    wanted = store(wanted, "repeat-anchors")
    drop(found)
    once = long.groupBy("key", "key2").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("copies"))
    work = store(once.join(wanted, ["key", "key2"]), "repeat-texts")
    segs = store(segments(work), "segments")
    distinct = (segs.groupBy("bucket", "digest").agg(F.first("seg").alias("seg"), F.first("off").alias("off"),
                                                     F.sum("n").alias("n")))
    big = store(segs.select("bucket", "digest").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
                .where(f"size > {MAX_SEGMENTS}").select("bucket"), "large-buckets")
    if big.limit(1).count():
        masks = (bucket_masks(distinct.join(big, "bucket", "left_anti"))
                 .unionByName(split_masks(distinct.join(big, "bucket", "left_semi"))))
    else:
        masks = bucket_masks(distinct)
    masks = store(masks, "masks")
    hits = (segs.where("copies = 1").select("bucket", "digest", "key", "key2", "starts").join(masks, ["bucket", "digest"])
            .groupBy("key", "key2").agg(F.collect_list(F.struct("starts", "mask")).alias("found")))
    fields = [("key", pa.int64()), ("key2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())] + ([("kept", pa.string())] if keep_text else [])

    def run(batches):
        for batch in released(batches):
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    left, n, spans = cut(r["data"], r["found"])
                    out.append((r["key"], r["key2"], n, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)],
                                                 schema=pa.schema(fields))

    cuts = (work.where("copies = 1").select("key", "key2", "data").join(hits, ["key", "key2"])
            .mapInArrow(run, "key long, key2 long, n_removed long, n_spans long, kept_sha256 string"
                             + (", kept string" if keep_text else "")))
    return copies, cuts


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    log = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                      F.sha2(text.cast("binary"), 256).alias("sha"), *text_keys())
    log = store(log, "texts")
    _, cuts = repeated(docs)
    copies = log.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("copies"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    empty = hashlib.sha256(b"").hexdigest()
    return (log.join(copies, ["key", "key2"]).join(cuts, ["key", "key2"], "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(table_path(sf_dir, "documents")))


def cut_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all rows, texts without their repeated strings (bytes of a
    character that was cut in two go as well)."""
    copies, cuts = repeated(docs, keep_text=True)
    rows = docs.select(row_of(docs), *text_keys())
    twice = copies.where("copies > 1").select("key", "key2", F.lit(True).alias("twice"))
    out = rows.join(twice, ["key", "key2"], "left").join(cuts.select("key", "key2", "kept"), ["key", "key2"], "left")
    text = F.col("doc.text")
    new = (F.when(F.col("twice") & (F.octet_length(F.coalesce(text, F.lit(""))) >= LENGTH), F.lit(""))
           .otherwise(F.coalesce("kept", text)))
    return out.select(*(new.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
