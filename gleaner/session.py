"""Session helpers: building a local session for tests and locating the shared folder.

On a cluster the session comes from the platform; the library only reads
``spark.checkpoint.dir`` from it.  A local default is set only when that
setting is missing (tests, local benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for the jobs in this package.  Shuffle partitions are
# left to AQE coalescing at scale; the local value is sized to the cores.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long HTML documents: keep Arrow batches small so a Python worker never
    # holds thousands of pages at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, app: str = "gleaner") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the conf is all there is
        if conf:
            return conf
        raise RuntimeError("spark.checkpoint.dir is not set")
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    # Unset: local runs and tests only.
    local = tempfile.mkdtemp(prefix="gleaner-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = "/".join([base, "gleaner", *parts])
    if unique:
        path = f"{path}-{uuid.uuid4().hex[:12]}"
    return path


def spread(df):
    """Split an under-partitioned input before heavy per-row work.

    Python stages (HTML parsing) and text explodes cost far more per byte than
    a scan; a table stored as one row group arrives as one task.  When the
    input has fewer partitions than the session's parallelism it is
    round-robin repartitioned to that parallelism; otherwise (any table at
    cluster scale) it is returned unchanged, with no shuffle.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= target else df.repartition(target)


def materialize(df, name: str = "materialized"):
    """Write ``df`` once as a parquet table under the shared checkpoint folder
    and read it back: for inputs read twice (a size count, then the work).
    Upstream work runs once, lineage is cut, a lost executor does not force a
    recomputation, and nothing stays pinned in executor memory."""
    path = shared_path(df.sparkSession, name, unique=True)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the (shared) file system of the session."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).exists(p))
    except Exception:  # noqa: BLE001 - no JVM handle: probe by reading
        from pyspark.errors import AnalysisException
        try:
            spark.read.parquet(path).schema
            return True
        except AnalysisException:
            return False


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
