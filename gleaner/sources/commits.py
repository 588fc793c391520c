"""Runs of several tables that become visible together.

A writer puts the rows of a run into attempt folders of their tables and then
publishes one marker file, ``commits/run-N.json``, that names the attempts.  The
marker is written aside and renamed onto its final name, which fails if the name
is taken: of two writers that aim at the same run one wins, the other computes its
rows again against what the winner has added and takes the next run.  Readers
follow markers only, so the tables of a run appear at once, and what a failed
writer left is never read.

The rename must not replace an existing file (HDFS and file systems like it; an
object store needs a committer that offers this).
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Callable, Mapping, Optional, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import path_exists

MARKER = "batch_id long, attempts map<string,string>, stream string, stream_batch long, committed_at double"


class RunTaken(RuntimeError):
    """Another writer has committed this run."""


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with all of ``text`` at once; False if it exists."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    aside = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        return False
    out = fs.create(aside, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    none[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(aside, target, none)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


class CommitLog:
    """The markers of the runs of the tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/commits"

    def markers(self) -> Optional[DataFrame]:
        """One row per committed run; None while there is none."""
        if not path_exists(self.spark, self.path):
            return None
        return self.spark.read.schema(MARKER).json(self.path)

    def last(self) -> Optional[int]:
        markers = self.markers()
        row = None if markers is None else markers.agg(F.max("batch_id")).first()
        return None if row is None or row[0] is None else int(row[0])

    def run_of(self, stream: str, stream_batch: int) -> Optional[int]:
        """The run that committed a stream's micro-batch, if one has."""
        markers = self.markers()
        if markers is None:
            return None
        row = markers.where((F.col("stream") == stream) & (F.col("stream_batch") == stream_batch)).agg(F.max("batch_id")).first()
        return None if row[0] is None else int(row[0])

    def claim(self, batch_id: int, attempts: Mapping[str, str], stream: Optional[str] = None,
              stream_batch: Optional[int] = None) -> None:
        """Make run ``batch_id`` with these attempts visible; ``RunTaken`` if another has that id."""
        marker = {"batch_id": batch_id, "attempts": dict(attempts), "stream": stream, "stream_batch": stream_batch,
                  "committed_at": time.time()}
        if not publish(self.spark, f"{self.path}/run-{batch_id:012d}.json", json.dumps(marker)):
            raise RunTaken(f"run {batch_id} of {self.root} was committed by another writer")

    # -- tables ----------------------------------------------------------------
    def write_attempt(self, table: str, rows: DataFrame, partitions: Sequence[str] = (), gather: bool = True) -> str:
        """Write rows of ``table`` (``partitions``: further partition columns); the
        attempt's name.  Nothing is visible before a marker names it.  With ``gather``
        the rows of a folder are brought together first; without, every task
        writes its own file per folder, and wide rows stay where they are."""
        attempt = f"a{uuid.uuid4().hex}"
        if partitions and gather:                       # one file or few per folder, whatever the tasks
            rows = rows.repartition(*partitions)
        (rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt", *partitions)
             .parquet(f"{self.root}/{table}"))
        return attempt

    def read(self, table: str, before: Optional[int] = None) -> Optional[DataFrame]:
        """Rows of ``table`` with ``batch_id``, of committed runs (``before`` a run, if given);
        None while there are none."""
        markers, path = self.markers(), f"{self.root}/{table}"
        if markers is None or not path_exists(self.spark, path):
            return None
        names = markers.select("batch_id", F.col("attempts")[table].alias("attempt")).where(F.col("attempt").isNotNull())
        if before is not None:
            names = names.where(F.col("batch_id") < F.lit(before))
        from pyspark.errors import AnalysisException
        try:
            rows = self.spark.read.parquet(path)
        except AnalysisException:                       # no run has written a row yet
            return None
        # one row per run: a small side, and partitions are pruned by attempt
        return rows.join(names, "attempt").drop("attempt")

    def append(self, build: Callable[[int], Mapping[str, DataFrame]], stream: Optional[str] = None,
               stream_batch: Optional[int] = None, tries: int = 20,
               partitions: Mapping[str, Sequence[str]] = {}, gather: bool = True) -> int:
        """Commit one run: ``build(run)`` gives the rows of each table, computed against
        the runs before ``run``.  If another writer takes that run first, they are
        computed again for the next one.  Returns the run."""
        for _ in range(tries):
            last = self.last()
            run = 0 if last is None else last + 1
            attempts = {table: self.write_attempt(table, rows, partitions.get(table, ()), gather) for table, rows in build(run).items()}
            try:
                self.claim(run, attempts, stream, stream_batch)
                return run
            except RunTaken:
                continue
        raise RunTaken(f"no free run of {self.root} in {tries} tries")
