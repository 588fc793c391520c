"""The article registry and its document table, append-only, with a commit log.

Layout under ``root`` (a folder in shared storage):

    data/attempt=A/bucket=B/part-*.parquet   registry rows that attempt A wrote, by URL hash
    documents/attempt=A/part-*.parquet       documents (path, url, kind, body) of the same run
    commits/run-N.json                       the marker of run N: its attempts

Readers see the rows of attempts that a marker names, so what a failed attempt left
behind is never read, and a run's registry rows and documents appear together.
``is_new`` is not stored: it is ``batch_id == last committed run``, which is exactly
"clear the flag on every old row, set it on the rows of this run" without
rewriting the old rows.  A run that inserts nothing still commits, so all flags clear.
Several writers may run at once (see ``gleaner.sources.commits``).  A run that asks which
of its URLs are known reads only the buckets that they fall into.
"""

from __future__ import annotations

from typing import Callable, Mapping, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import materialize
from gleaner.sources.commits import CommitLog

REGISTRY_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("article_file_path", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("publish_date", T.StringType()),
    T.StructField("has_text", T.BooleanType()),
    T.StructField("is_new", T.BooleanType()),
])

# Column order of the registry file format (header line of the CSV form).
REGISTRY_HEADER = ["url", "article_file_path", "title", "source", "publish_date", "has_text", "is_new"]


DOCUMENT_SCHEMA = "path string, url string, kind string, body string"


class RegistryStore:
    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 16):
        self.spark, self.n_buckets = spark, n_buckets       # the number stays with the registry
        self.log = CommitLog(spark, root)

    def bucket(self):
        return F.pmod(F.xxhash64("url"), F.lit(self.n_buckets)).cast("int")

    # -- reading ----------------------------------------------------------
    def current_batch(self) -> Optional[int]:
        """Last committed run id (one scalar to the driver), None when empty."""
        return self.log.last()

    def run_of(self, stream: str, stream_batch: int) -> Optional[int]:
        """The run that committed a stream's micro-batch, if it is committed."""
        return self.log.run_of(stream, stream_batch)

    def read(self, upto: Optional[int] = None) -> DataFrame:
        """Registry rows of committed runs with the derived ``is_new`` flag."""
        cur = self.current_batch() if upto is None else upto
        rows = None if cur is None else self.log.read("data", before=cur + 1)
        if rows is None:
            empty = self.spark.createDataFrame([], REGISTRY_SCHEMA)
            return empty.withColumn("batch_id", F.lit(None).cast("long"))
        return rows.drop("bucket").withColumn("is_new", F.col("batch_id") == F.lit(cur))

    def documents(self, upto: Optional[int] = None) -> DataFrame:
        """Documents of committed runs."""
        rows = self.log.read("documents", before=None if upto is None else upto + 1)
        return self.spark.createDataFrame([], DOCUMENT_SCHEMA + ", batch_id long") if rows is None else rows

    def known_urls(self, before: int, among: Optional[DataFrame] = None) -> DataFrame:
        """URLs of runs before ``before`` (a replayed run must not see its own rows); with
        ``among`` (url) only of the buckets in which those URLs would be."""
        rows = self.log.read("data", before=before)
        if rows is None:
            return self.spark.createDataFrame([], "url string")
        if among is not None:                               # at most n_buckets numbers
            rows = rows.where(F.col("bucket").isin([r[0] for r in among.select(self.bucket().alias("b")).distinct().collect()]))
        return rows.select("url")

    def new_among(self, batch: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
        """(the batch, written once, and the known URLs of its buckets)."""
        batch = materialize(batch, "batch")
        return batch, self.known_urls(run, among=batch)

    # -- writing ----------------------------------------------------------
    def write_attempt(self, new_rows: DataFrame) -> str:
        """Write registry rows that no marker names yet."""
        return self.log.write_attempt("data", new_rows.drop("is_new").withColumn("bucket", self.bucket()), ["bucket"])

    def commit(self, new_rows: DataFrame, batch_id: int, stream: Optional[str] = None,
               stream_batch: Optional[int] = None) -> None:
        """Write the new rows of run ``batch_id`` and commit it; ``RunTaken`` if the
        run is already committed (its rows stay as they are)."""
        self.log.claim(batch_id, {"data": self.write_attempt(new_rows)}, stream, stream_batch)

    def append(self, build: Callable[[int], Mapping[str, DataFrame]], stream: Optional[str] = None,
               stream_batch: Optional[int] = None) -> int:
        """Commit the next run with the tables (``data``, ``documents``) that ``build(run)``
        computes against the runs before it; computed again if another writer was
        first.  Returns the run."""
        def tables(run: int) -> dict:
            out = {name: rows.drop("is_new") for name, rows in build(run).items()}
            return out | {"data": out["data"].withColumn("bucket", self.bucket())} if "data" in out else out

        return self.log.append(tables, stream, stream_batch, partitions={"data": ["bucket"]})

    def next_batch_id(self) -> int:
        cur = self.current_batch()
        return 0 if cur is None else cur + 1


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """The flat CSV form of the registry (header line, fixed schema, no inference)."""
    return spark.read.schema(REGISTRY_SCHEMA).option("header", True).csv(path)


def write_registry_csv(df: DataFrame, path: str) -> None:
    """Write the flat CSV form into a new folder (never onto the folder being read)."""
    df.select(*REGISTRY_HEADER).write.mode("errorifexists").option("header", True).csv(path)
