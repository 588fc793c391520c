"""Passage retrieval over a stored index: documents -> chunks -> vectors -> passages.

The index has two tables, written and committed together by every build:

    chunks   (bucket, doc_id, chunk_pos, chunk_hash, chunk_text, embedding)
    catalog  (doc_id, tool_id, description, embedding): two tools per document

Only what is new is embedded: a chunk whose (document, hash) is stored, or a document that
is in the catalog, is dropped by an anti-join before its vector is made.  ``bucket``
is a hash of the document, so the chosen documents' passages are read from their buckets.

A question goes through the catalog first (the tools most similar to it), then
through the chunks of the documents that these tools belong to.
"""

from __future__ import annotations

from typing import Callable, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import retrieval as R
from gleaner.operators.ingest import anti_known, dedup_first
from gleaner.session import materialize
from gleaner.sources.commits import CommitLog

#: embed(rows, key columns, text column) -> (key columns, embedding)
Embed = Callable[[DataFrame, Sequence[str], str], DataFrame]

CHUNK = ["doc_id", "chunk_pos", "chunk_hash", "chunk_text"]


class PassageIndex:
    """``embed`` None: the default embedding, made on each row itself."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 16, embed: Optional[Embed] = None):
        self.spark, self.log, self.n_buckets, self.embed = spark, CommitLog(spark, root), n_buckets, embed

    def bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.n_buckets)).cast("int")

    # -- building -------------------------------------------------------------
    def build(self, docs: DataFrame, size: int = R.CHUNK_SIZE, overlap: int = R.CHUNK_OVERLAP) -> int:
        """Add the documents (doc_id, text) that the index lacks, and new chunks of those
        it has; the run.  Of equal chunks of a document the first is stored; a null text
        is an empty one.

        What is new is found by keys alone.  A text is not shuffled unless its document
        is new to an index that has others, or stands in several rows."""
        def rows(run: int) -> dict:
            texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
            have, listed = self.log.read("chunks", before=run), self.log.read("catalog", before=run)
            several = materialize(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several-rows")
            several = None if several.isEmpty() else several

            def chunks_of(some: DataFrame) -> DataFrame:
                """Keys and texts of the first of a document's equal chunks."""
                if several is None:
                    return R.distinct_chunks(some, "text", size, overlap).select(*CHUNK)
                once = R.distinct_chunks(some.join(several, "doc_id", "left_anti"), "text", size, overlap).select(*CHUNK)
                more = R.distinct_chunks(some.join(several, "doc_id", "left_semi"), "text", size, overlap).select(*CHUNK)
                more = dedup_first(more.withColumn("_key", F.struct("doc_id", "chunk_hash")), ["chunk_pos"], key="_key")
                return once.unionByName(more.select(*CHUNK))

            if have is None:
                chunks = chunks_of(texts)
            else:
                have = have.select(F.struct("doc_id", "chunk_hash").alias("_key"))
                keys = R.distinct_chunks(texts, "text", size, overlap).select("doc_id", F.struct("doc_id", "chunk_hash").alias("_key"))
                grown = materialize(anti_known(keys, have, key="_key").select("doc_id").distinct(), "new-keys")
                chunks = chunks_of(texts.join(grown, "doc_id", "left_semi"))
                chunks = anti_known(chunks.withColumn("_key", F.struct("doc_id", "chunk_hash")), have, key="_key").drop("_key")
            if listed is not None:
                unlisted = materialize(anti_known(texts.select("doc_id"), listed, key="doc_id").distinct(), "unlisted")
                texts = texts.join(unlisted, "doc_id", "left_semi")
            tools = R.tool_catalog(texts, "doc_id", "text").select(
                "doc_id", (F.col("doc_id") * 2 + F.col("tool_pos")).alias("tool_id"), "description")
            chunks = self._embedded(chunks, ["doc_id", "chunk_hash"], "chunk_text", "new-chunks")
            if self.embed is not None or several is None:
                tools = self._embedded(tools, ["tool_id"], "description", "new-tools")
            else:                                       # a tool's vector is that of all its rows
                more = materialize(tools.join(several, "doc_id", "left_semi"), "new-tools")
                more = more.join(R.hash_embed(more, ["tool_id"], "description"), "tool_id")
                tools = R.hash_vector(tools.join(several, "doc_id", "left_anti"), "description").unionByName(more)
            return {"chunks": chunks.withColumn("bucket", self.bucket()), "catalog": tools}

        return self.log.append(rows, partitions={"chunks": ("bucket",)}, gather=False)

    def _embedded(self, rows: DataFrame, key: Sequence[str], text: str, name: str) -> DataFrame:
        """``rows`` with their embedding."""
        if self.embed is None:
            return R.hash_vector(rows, text)
        rows = materialize(rows, name)                  # read twice: for the vectors and for the texts
        return rows.join(self.embed(rows, key, text), list(key))

    # -- reading --------------------------------------------------------------
    def chunks(self, doc_ids: Optional[DataFrame] = None) -> Optional[DataFrame]:
        """Stored chunks; with ``doc_ids`` only those documents', from their buckets."""
        rows = self.log.read("chunks")
        if rows is None or doc_ids is None:
            return rows
        # at most n_buckets numbers
        buckets = [r[0] for r in doc_ids.select(self.bucket().alias("b")).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets)).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def catalog(self) -> Optional[DataFrame]:
        return self.log.read("catalog")

    def search(self, questions: DataFrame, qid: str, text: str = "text", k_tools: int = R.TOOL_TOP_K,
               k: int = R.VECTOR_TOP_K) -> DataFrame:
        """(qid, rank, sim, doc_id, chunk_pos, chunk_hash, chunk_text): the ``k`` passages most similar
        to each question among the documents of its ``k_tools`` best tools.  A question
        without tokens finds nothing."""
        q = materialize((self.embed or R.hash_embed)(questions.select(qid, text), [qid], text), "question-vectors")
        tools = R.cosine_topk(q, self.catalog(), k_tools, qid, "tool_id")
        picked = materialize(tools.select("qid", F.expr("cid div 2").alias("doc_id")).distinct(), "picked-documents")
        chunks = materialize(self.chunks(picked), "picked-chunks")
        name = F.concat_ws(":", "doc_id", "chunk_pos")
        asked = q.join(picked.withColumnRenamed("qid", qid), qid)
        found = R.cosine_topk(asked, chunks.select(name.alias("cid"), "embedding", "doc_id"), k, qid, "cid", scope="doc_id")
        return (found.select(F.col("qid").alias(qid), "rank", "sim", "doc_id", F.substring_index("cid", ":", -1).cast("int").alias("chunk_pos"))
                .join(chunks.select("doc_id", "chunk_pos", "chunk_hash", "chunk_text"), ["doc_id", "chunk_pos"]))
