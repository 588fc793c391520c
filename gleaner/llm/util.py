"""Shared helpers of the corpus operators: scratch tables, files, batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.batches import release, released, slices  # noqa: F401 (used by the operators)
from gleaner.session import shared_path

#: Word separators of the contracts (ASCII white space).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder (``spark.checkpoint.dir``)."""
    return shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, and survives a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    # Spark frees the shuffle files of finished plans when the driver's JVM collects
    # them; asking for that now keeps the disk in use to one phase's worth
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``store`` once its readers are done."""
    drop_path(df.sparkSession, df._scratch_path)


def open_fs(path: str):
    """(file system, path inside it) for a path of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") \
        else (fs.LocalFileSystem(), path)


def row_of(df: DataFrame):
    """All columns of ``df`` as one struct ``doc``: names beside it can't clash with them."""
    return F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("doc")


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str,
                start: Callable[[], object] | None = None, batch_bytes: float = 8e6) -> DataFrame:
    """Apply ``fn(columns as lists[, state])`` to each Arrow batch; ``start``
    makes per-task state.  A batch is cut so that a step
    holds about ``batch_bytes``."""
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for batch in slices(batches, batch_bytes):
            cols = batch.to_pydict()
            got = fn(cols, state) if start else fn(cols)
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out_schema)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo ``n`` (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _INV)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
    return _POW["p"][:n], _POW["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte polynomials (modulo 2^64), one longer than ``data``."""
    p, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end): depends on its bytes only."""
    _, inv = _powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b longs): (node, component = smallest
    node).  Alternating large-star and small-star rounds; each round is a few
    equi-joins and pre-aggregated minima, stored in the shared folder."""
    spark = edges.sparkSession
    e = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .where("a <> b").distinct(), name)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = store(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                             F.col("m").alias("b"))
                 .where("a <> b").distinct())
        small = store(small, name)
        drop(e)
        drop(large)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    out = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return out.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
