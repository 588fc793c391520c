"""Operator 8: near-duplicates by min-max hashing.

A document's set is its distinct 5-word shingles (64-bit hashes).  Under each of
``PERMUTATIONS`` permutations a signature keeps both the smallest and the largest
value, so it has two values per hash evaluation; bands of ``ROWS`` values make
bucket keys.  At similarity 0.75 a pair shares no band with probability
(1 - 0.75^5)^40 = 2e-5.

Work per stage: equal sets collapse into a class (its smallest row); classes that
share a bucket are first compared with the bucket's smallest class, links are
confirmed on the full sets, and components are formed; so are members still apart
with one other head.  What is then still apart within a bucket is compared
again, across components and where the sizes allow 0.75, inside tasks that hold
a bounded block of a bucket: only links become rows.  So a bucket of many copies costs one link a
member, and no link between candidates is lost.

Defined cases: null texts and texts without words have an empty set and are linked
with nothing; with fewer than five words the whole sequence is the one shingle;
very long texts are read whole; rows with equal sets are one class; rows that
share a doc_id are one node of the graph; rows with a null doc_id are linked with
nothing and kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import components, drop, mix, prefix_sums, slices, span_hashes, store

WORDS, PERCENT = 5, 75
PERMUTATIONS, ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // ROWS
TURNS = 2
BLOCK_SHINGLES, STEP_BYTES = 1_000_000, 1e6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_P = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]


def shingle_sets(texts: list) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text (nulls: empty)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    words = span_hashes(prefix_sums(data), start, end)
    sizes = np.array([len(r) + 1 for r in raw])
    doc_end = np.cumsum(sizes)
    n_words = np.diff(np.concatenate([[0], np.searchsorted(start, doc_end)]))
    out, at = [], 0
    for n in n_words:
        w = words[at:at + n]
        at += n
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        k = min(n, WORDS)
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += w[j:n - k + 1 + j] * _P[j]
        out.append(np.unique(mix(h + np.uint64(k))))
    return out


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return (rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Row per non-empty set: minimum and maximum under every permutation."""
    a, b = permutations()
    sizes = np.array([len(s) for s in sets], np.int64)
    at = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if len(sets) else np.zeros(0, np.uint32)
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    for p in range(PERMUTATIONS):
        y = x * a[p]
        y ^= y >> np.uint32(15)
        y *= b[p] | np.uint32(1)
        out[:, 2 * p] = np.minimum.reduceat(y, at)
        out[:, 2 * p + 1] = np.maximum.reduceat(y, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band; the band's number is part of it."""
    x = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        h = mix(h + x[:, :, r])
    return h.view(np.int64)


def _mapped(docs: DataFrame, fn, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches):
        for part in slices(batches, STEP_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fn(part), schema)], schema=schema)

    return docs.mapInArrow(run, ddl)


def _lists(arrays: list[np.ndarray], dtype=np.int64) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(dtype)))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set; null: empty) and band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def fn(batch):
        sets = shingle_sets(batch.column("text").to_pylist())
        keys = iter(band_keys(signatures([s for s in sets if len(s)])))
        return (batch.column("doc_id"), [len(s) for s in sets],
                [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                _lists([next(keys) if len(s) else np.zeros(0, np.int64) for s in sets]))

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, schema,
                   "doc_id long, n_shingles long, set_id binary, keys array<long>")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles, keys) of the documents whose id is in ``ids``."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def fn(batch):
        sets = shingle_sets(batch.column("text").to_pylist())
        full = [i for i, s in enumerate(sets) if len(s)]
        sets = [sets[i] for i in full]
        return batch.column("id").take(pa.array(full, pa.int64())), _lists(sets), _lists(list(band_keys(signatures(sets))))

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return _mapped(rows, fn, schema, "id long, shingles array<long>, keys array<long>")


def confirmed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * shared >= 75 * united."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def fn(batch):
        def sets(name):
            col = batch.column(name)
            offsets = np.asarray(col.offsets) - col.offsets[0].as_py()
            return col.flatten().to_numpy(), offsets

        (x, xo), (y, yo) = sets("sa"), sets("sb")
        linked = []
        for i in range(batch.num_rows):
            p, q = x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]
            shared = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(100 * shared >= PERCENT * (len(p) + len(q) - shared))
        return batch.column("a"), batch.column("b"), linked

    one = classes.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = classes.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    full = pairs.select("a", "b").join(one, "a").join(two, "b")
    return _mapped(full, fn, schema, "a long, b long, linked boolean").where("linked").select("a", "b").distinct()


def linked_in_group(rows: list[tuple]) -> list[tuple[int, int]]:
    """Confirmed links (a, b) between members (block, id, part, shingles, keys) of one
    bucket that are in different components.  A pair is looked at only in the first
    of the buckets that it shares, and where the sizes allow the similarity."""
    key, i, j = rows[0][:3]
    block = np.array([r[3] for r in rows])
    ids, parts = (np.array([r[k] for r in rows]) for k in (4, 5))
    sets = [np.array(r[6], np.int64).view(np.uint64) for r in rows]      # sorted as unsigned
    n = np.array([len(x) for x in sets])
    keys = np.array([r[7] for r in rows], np.int64)
    band = int(np.flatnonzero((keys == key).any(0))[0])
    at = np.cumsum(n) - n
    flat = np.concatenate(sets)
    # members of the largest component needn't be compared with each other
    _, of, count = np.unique(parts, return_inverse=True, return_counts=True)
    main = of == count.argmax()
    out = []
    for x in np.flatnonzero(~main):
        other = (parts != parts[x]) & (main | (np.arange(len(rows)) > x)) & (i == j or block != block[x])
        other &= 100 * np.minimum(n, n[x]) >= PERCENT * np.maximum(n, n[x])
        ys = np.flatnonzero(other)
        ys = ys[(keys[ys] == keys[x]).argmax(1) == band]
        if not len(ys):
            continue
        take = np.arange(int(n[ys].sum())) + np.repeat(at[ys] - (np.cumsum(n[ys]) - n[ys]), n[ys])
        spot = np.minimum(np.searchsorted(sets[x], flat[take]), n[x] - 1)
        shared = np.add.reduceat((sets[x][spot] == flat[take]).astype(np.int64), np.cumsum(n[ys]) - n[ys])
        hit = ys[100 * shared >= PERCENT * (n[x] + n[ys] - shared)]
        out += [(min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))) for y in hit]
    return out


def compare_groups(left: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) within the buckets of ``left``, by groups of members in
    one task; no pair becomes a row unless it is a link.  A bucket of many shingles
    is cut into blocks by hash, and every two blocks meet in a group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    blocks = (left.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    rows = (left.join(blocks, "key").withColumn("block", block).withColumn("m", F.explode(meets))
            .select("key", "m.i", "m.j", "block", "id", "part").join(classes, "id")
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .select("key", "i", "j", "block", "id", "part", "shingles", "keys"))

    def run(batches):
        group = []

        def solve():
            links = linked_in_group(group) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for r in zip(*(c.to_pylist() if c.type in (pa.int64(), pa.int32()) else [x.values.to_numpy() for x in c]
                               for c in batch.slice(at, 512).columns)):
                    if group and group[0][:3] != r[:3]:
                        yield solve()
                        group = []
                    group.append(r)
        if group:
            yield solve()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _apart(in_buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, n, part) of the buckets whose members are in different components."""
    found = components(links).withColumnRenamed("node", "id")
    parts = store(in_buckets.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("part")), "parts")
    split = parts.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    return parts.join(split, "key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_links (confirmed links of its
    class that were looked at) of every row."""
    sets = store(document_sets(docs), "sets")
    # equal sets are one class, named by its smallest document
    members = sets.where("set_id IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_id")
    classes_of = members.groupBy("set_id").agg(F.min("doc_id").alias("id"))
    classes = (sets.join(classes_of.withColumnRenamed("id", "doc_id"), ["doc_id", "set_id"])
               .dropDuplicates(["doc_id", "set_id"]))
    banded = classes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = (banded.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last"))
              .where("head <> last").select("key", "head"))
    in_buckets = store(banded.join(shared, "key"), "buckets")
    classes = store(full_sets(docs, in_buckets.select("id").distinct()), "classes")
    links = None
    for turn in range(TURNS):
        # each bucket's members meet one of them: first the smallest, then others
        # by hash, and only while they are in different components
        if links is None:
            pairs = in_buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
        else:
            apart = _apart(in_buckets, links)
            heads = apart.groupBy("key").agg(F.min_by(F.struct("id", "part"), F.xxhash64("key", "id", F.lit(turn))).alias("h"))
            pairs = (apart.join(heads, "key").where("part <> h.part")
                     .select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct())
        new = confirmed(pairs, classes)
        links = store(new if links is None else links.unionByName(new), "links")
    # what is still apart within a bucket: across components, in groups
    left = store(_apart(in_buckets, links), "apart")
    every = store(links.unionByName(compare_groups(left, classes)), "links")
    found = store(components(every), "components")
    drop(in_buckets)
    drop(left)
    degree = every.unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").count()
    by_set = (classes_of.join(found.withColumnRenamed("node", "id"), "id", "left")
              .join(degree.select(F.col("a").alias("id"), F.col("count").alias("n_links")), "id", "left")
              .select("set_id", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return (sets.select("doc_id", "n_shingles", "set_id").join(by_set, "set_id", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(table_path(sf_dir, "documents")))


def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose id is their component's."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
