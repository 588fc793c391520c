"""Operator 5: exact deduplication as a stateful stream.

Every arriving text is normalised (runs of white space become one space) and
digested.  A streaming aggregation keeps, per digest, the stable identifier (the
smallest doc_id), a content locator (file and row of that document) and the number
of texts, in RocksDB state on disk that never expires; it goes on from its
checkpoint when more documents arrive.  Partial aggregation comes before the
state, so a digest that a third of all rows share is one state row per task.

Hits (digests seen more than once) are checked on their full bytes: each text is
compared with the text at the locator of its digest.  Where bytes differ although
digests agree, the rows of that digest are grouped anew by the whole text.

Defined cases: null counts as empty; rows with equal texts and equal doc_id are
told apart by their locator (the smallest stays); a null doc_id sorts after all
others; an empty table gives an empty result; very long texts are read whole;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import SPACE, drop, drop_path, row_of, scratch, store

#: Settings of the disk-backed state; set for the stream, then put back.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # else every state partition sets aside some MB of disk that it doesn't use
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
FILES_PER_BATCH = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with its content locator; a frame that isn't read
    straight from files is written first."""
    try:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                           F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return located(store(docs.select("doc_id", "text"), "exact-input"))


def arrivals(docs: DataFrame, digest_of=digest) -> DataFrame:
    """doc_id, locator and digest of every row."""
    return located(docs).select("doc_id", "file", "row", digest_of(normalised(F.col("text"))).alias("digest"))


def first_of_group() -> Column:
    """The row that stays: smallest doc_id, nulls last, then the locator."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row"))


def run_state(spark: SparkSession, log_path: str, schema, checkpoint: str, out: str,
              files_per_batch: int = FILES_PER_BATCH) -> None:
    """Fold new files of the arrival log into the keyed state and append what
    changed (digest, keep, group_size, batch) to ``out``.  Run again with the same
    checkpoint, it reads only files that it hasn't seen."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
        state = stream.groupBy("digest").agg(first_of_group().alias("keep"), F.count(F.lit(1)).alias("group_size"))

        def write(rows: DataFrame, batch: int) -> None:
            # a replayed batch overwrites its own folder
            rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b{batch:09d}")

        query = (state.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_state(spark: SparkSession, out: str) -> DataFrame:
    """digest, keep, group_size as of the last batch that changed the digest."""
    schema = ("digest string, keep struct<none:boolean,doc_id:long,file:string,row:long>, group_size long, batch int")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.*")


def mismatches(docs: DataFrame, groups: DataFrame, digest_of=digest) -> DataFrame:
    """Digests of which some text differs, byte for byte, from the one that stays."""
    norm = normalised(F.col("text"))
    texts = located(docs).select("file", "row", norm.alias("norm"), digest_of(norm).alias("digest"))
    hit = texts.join(groups.where("group_size > 1").select("digest", F.col("keep.file").alias("f"), F.col("keep.row").alias("r")), "digest")
    kept = hit.where("file = f and row = r").select("digest", F.col("norm").alias("kept_norm"))
    return hit.join(kept, "digest").where("norm <> kept_norm").select("digest").distinct()


def dedup(docs: DataFrame, digest_of=digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the locator of every row."""
    spark = docs.sparkSession
    log = store(arrivals(docs, digest_of), "arrivals")
    out, checkpoint = scratch(spark, "exact-state"), scratch(spark, "exact-checkpoint")
    spark.createDataFrame([], "digest string, keep struct<none:boolean,doc_id:long,file:string,row:long>, "
                              "group_size long, batch int").write.parquet(f"{out}/b")
    run_state(spark, log._scratch_path, log.schema, checkpoint, out)
    groups = store(latest_state(spark, out), "exact-groups")
    drop_path(spark, out)
    wrong = store(mismatches(docs, groups, digest_of), "exact-mismatch")
    cols = ["doc_id", "file", "row", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size",
            ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept")]
    result = log.join(groups, "digest").select(*cols)
    if wrong.limit(1).count():
        norm = normalised(F.col("text"))
        texts = (located(docs).select("doc_id", "file", "row", norm.alias("norm"), digest_of(norm).alias("digest"))
                 .join(wrong, "digest"))
        by_text = texts.groupBy("norm").agg(first_of_group().alias("keep"), F.count(F.lit(1)).alias("group_size"))
        result = result.join(wrong, "digest", "left_anti").unionByName(texts.join(by_text, "norm").select(*cols))
    return result


def op5_exact_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of every group of equal texts.  A frame that isn't read
    straight from files is written first; columns of any name pass through."""
    try:
        rows = docs.select(row_of(docs), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        docs = store(docs, "exact-input")
        rows = docs.select(row_of(docs), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(dedup(docs).where("kept").select("file", "row"), ["file", "row"], "left_semi").select("doc.*")
