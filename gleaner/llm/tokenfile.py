"""Operator 12: token-ID files of patched frame-of-reference blocks.

Texts are range-partitioned and sorted by doc_id, encoded, and written by every
task as files of blocks of ``BLOCK`` ids: the block's minimum is subtracted, the
differences are packed with as many bits as the ``PERCENTILE`` of them needs, and
longer differences are kept whole in an exception list with their positions.  A
footer indexes the starts of all blocks and the documents, so any run of ids is
read without the rest of the file.

A file is (little-endian): magic; blocks, each of minimum (4 bytes), width (2),
number of exceptions (2), ``BLOCK * width / 64`` words of 8 bytes, exception
positions (2 each) and differences (4 each); the footer's block starts (8 each, one
more than blocks), document ids (8 each), ends of documents in ids (8 each) and
flags of null ids (1 each); numbers of blocks, documents and ids (8 each); magic.

A file belongs to the result once the manifest row that its task returns is
stored; files of lost tasks have none and are never read.  The ids before a file
come from sums over the manifest, in two levels.

Defined cases: a null or empty text is its end id alone; very long texts are
encoded and written whole; rows with the same doc_id follow each other in order of
their texts' hashes, then of input; a null doc_id stays null and comes first; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import open_fs, scratch, slices, store
from gleaner.llm.wordbpe import encoder, ended, ragged, vocabulary_text

MAGIC = b"PFORIDS1"
BLOCK, PERCENTILE, END = 512, 0.9, 2
FILE_IDS, FILE_DOCS, STEP = 1 << 25, 1 << 20, 1 << 20
BATCH_BYTES = 8e6
#: Files of this many tasks are summed up together.
TASKS = 4096


# --- blocks -----------------------------------------------------------------------

def pack_words(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` numbers below 2^width as rows of 64-bit words."""
    v = np.ascontiguousarray(v.T.astype(np.uint64)).reshape(BLOCK // 64, 64, -1)
    out = np.zeros((BLOCK // 64, width, v.shape[2]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, word] |= v[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.reshape(-1, v.shape[2]).T)


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.T).reshape(BLOCK // 64, width, -1)
    out = np.zeros((BLOCK // 64, 64, w.shape[2]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        x = w[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = x & mask
    return np.ascontiguousarray(out.reshape(BLOCK, -1).T)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ``ids``, whose number is a multiple of ``BLOCK``."""
    v = ids.reshape(-1, BLOCK).astype(np.uint32)
    low = v.min(1)
    delta = v - low[:, None]
    k = int(np.ceil(PERCENTILE * BLOCK)) - 1
    at = np.partition(delta, k, axis=1)[:, k]
    width = np.zeros(len(v), np.int64)
    for bit in range(32):
        width[at >= (1 << bit)] = bit + 1
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    row, pos = np.nonzero(delta >= limit)
    n_odd = np.bincount(row, minlength=len(v))
    head = np.zeros(len(v), np.dtype([("low", "<u4"), ("width", "<u2"), ("odd", "<u2")]))
    head["low"], head["width"], head["odd"] = low, width, n_odd
    out: list[bytes] = [b""] * len(v)
    odd_at = np.cumsum(n_odd) - n_odd
    odd_pos, odd_delta = pos.astype("<u2"), delta[row, pos].astype("<u4")
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        words = pack_words(delta[rows] & np.uint64((1 << int(w)) - 1), int(w)).astype("<u8") if w else np.zeros((len(rows), 0), "<u8")
        for i, x in zip(rows.tolist(), words):
            a, n = odd_at[i], n_odd[i]
            out[i] = b"".join((head[i].tobytes(), x.tobytes(), odd_pos[a:a + n].tobytes(), odd_delta[a:a + n].tobytes()))
    return out


def unpack_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``start`` in ``data``."""
    head = np.ascontiguousarray(data[start[:, None] + np.arange(8)])
    low = head.view("<u4")[:, 0]
    width, n_odd = head.view("<u2")[:, 2].astype(np.int64), head.view("<u2")[:, 3].astype(np.int64)
    v = np.zeros((len(start), BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            raw = np.ascontiguousarray(data[(start[rows] + 8)[:, None] + np.arange(BLOCK // 8 * w)])
            v[rows] = unpack_words(raw.view("<u8"), int(w))
    row = np.repeat(np.arange(len(start)), n_odd)
    pos_at = start + 8 + BLOCK // 8 * width
    pos = ragged(data, pos_at, 2 * n_odd).view("<u2")
    v[row, pos] = ragged(data, pos_at + 2 * n_odd, 4 * n_odd).view("<u4")
    return (v + low[:, None]).astype(np.uint32).ravel()


class Writer:
    """Writes one file, a batch of documents at a time."""

    def __init__(self, folder: str):
        fs, base = open_fs(folder)
        self.path = f"{base}/{uuid.uuid4().hex}.ids"
        self.out = fs.open_output_stream(self.path, compression=None)
        self.out.write(MAGIC)
        self.at, self.starts, self.rest = len(MAGIC), [], np.zeros(0, np.int32)
        self.docs, self.sizes, self.nulls, self.n_docs, self.n_ids = [], [], [], 0, 0

    def blocks(self, ids: np.ndarray) -> None:
        for a in range(0, len(ids), STEP):
            for b in pack_blocks(ids[a:a + STEP]):
                self.starts.append(self.at)
                self.out.write(b)
                self.at += len(b)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.nulls.append(nulls)
        self.sizes.append(sizes)
        self.n_docs += len(sizes)
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) - len(ids) % BLOCK
        self.rest = ids[whole:].copy()
        self.blocks(ids[:whole])

    def close(self) -> None:
        if len(self.rest):                              # filled up with its minimum: no bits more
            self.blocks(np.concatenate([self.rest, np.full(BLOCK - len(self.rest), self.rest.min(), np.int32)]))
        self.out.write(np.array([*self.starts, self.at], "<u8").tobytes())
        self.out.write(np.concatenate(self.docs).astype("<i8").tobytes())
        self.out.write(np.cumsum(np.concatenate(self.sizes)).astype("<u8").tobytes())
        self.out.write(np.concatenate(self.nulls).astype("u1").tobytes())
        self.out.write(np.array([len(self.starts), self.n_docs, self.n_ids], "<u8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Reads one file: its documents, and any run of its ids."""

    def __init__(self, path: str, fs):
        self.f = fs.open_input_file(path)
        size = self.f.size()
        tail = self.read(size - 32, 32)
        if tail[24:].tobytes() != MAGIC:
            raise ValueError(f"{path}: not a whole file of ids")
        n_blocks, n_docs, self.n_ids = (int(x) for x in tail[:24].view("<u8"))
        foot = self.read(size - 32 - 17 * n_docs - 8 * (n_blocks + 1), 17 * n_docs + 8 * (n_blocks + 1))
        a, b = 8 * (n_blocks + 1), 8 * (n_blocks + 1 + n_docs)
        self.starts = foot[:a].view("<u8").astype(np.int64)
        self.docs = foot[a:b].view("<i8")
        self.ends = foot[b:b + 8 * n_docs].view("<u8").astype(np.int64)
        self.nulls = foot[b + 8 * n_docs:].astype(bool)

    def read(self, at: int, n: int) -> np.ndarray:
        self.f.seek(at)
        return np.frombuffer(self.f.read(n), np.uint8).copy()

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids number ``a`` to ``b`` - 1."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, -(-b // BLOCK)
        at = self.starts[first:last + 1]
        got = unpack_blocks(self.read(int(at[0]), int(at[-1] - at[0])), at[:-1] - at[0])
        return got[a - first * BLOCK:b - first * BLOCK]

    def documents(self):
        """(position of the first document, crc32 of the ids of each) of runs of documents."""
        i = 0
        while i < len(self.ends):
            a = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, a + STEP, "right")))
            if j == i + 1:                              # one long document, in steps
                crc = 0
                for k in range(a, int(self.ends[i]), STEP):
                    crc = zlib.crc32(self.ids(k, min(k + STEP, int(self.ends[i]))).astype("<u4"), crc)
                yield i, [crc]
            else:
                whole = memoryview(self.ids(a, int(self.ends[j - 1])).astype("<u4")).cast("B")
                at = (4 * (np.concatenate([[a], self.ends[i:j]]) - a)).tolist()
                yield i, [zlib.crc32(whole[x:y]) for x, y in zip(at[:-1], at[1:])]
            i = j


# --- jobs -------------------------------------------------------------------------

MANIFEST = "task long, seq long, path string, n_docs long, n_ids long"


def write_files(docs: DataFrame, spec: str, folder: str) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest (task, seq, path,
    n_docs, n_ids), in whose order the files follow each other."""
    start_task = encoder(docs.sparkSession, spec)
    schema = pa.schema([("task", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        bpe, w, seq, task = start_task(), None, 0, TaskContext.get().partitionId()

        def row():
            w.close()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((task, seq, w.path, w.n_docs, w.n_ids), schema)],
                                              schema=schema)

        for batch in slices(batches, BATCH_BYTES):
            if w is None:
                w = Writer(folder)
            doc_id = batch.column("doc_id")
            w.add(doc_id.fill_null(0).to_numpy(zero_copy_only=False), doc_id.is_null().to_numpy(zero_copy_only=False),
                  *ended(*bpe.encode(batch.column("text")), END))
            if w.n_ids >= FILE_IDS or w.n_docs >= FILE_DOCS:
                yield row()
                w, seq = None, seq + 1
        if w is not None:
            yield row()

    fs, base = open_fs(folder)
    fs.create_dir(base)
    # the last two keys spread and order rows with the same doc_id
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"),
                        F.monotonically_increasing_id().alias("_row"))
    ordered = keyed.repartitionByRange("doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie", "_row")
    return store(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``before``: the ids of all earlier files."""
    cut = manifest.withColumn("part", F.expr(f"task div {TASKS}"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row per TASKS tasks
    parts = cut.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(parts, "part").withColumn("before", F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop("part", "base")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                fs, inner = open_fs(path)
                r = Reader(inner, fs)
                begin = np.concatenate([[0], r.ends[:-1]]) if len(r.ends) else r.ends
                for i, crc in r.documents():
                    part = slice(i, i + len(crc))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.docs[part], pa.int64(), mask=r.nulls[part]), pa.array(before + begin[part]),
                         pa.array(r.ends[part] - begin[part]), pa.array(crc, pa.int64())], schema=schema)
                r.f.close()

    # a file a task: spread by the files themselves, not by a key
    n = max(1, manifest.count())
    return (with_starts(manifest).select("path", "before").repartition(n)
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op12_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return read_files(write_files(docs, vocabulary_text(), scratch(spark, "token-files")))
