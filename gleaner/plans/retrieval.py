"""Registered queries: chunking, embeddings, top-k retrieval, tool catalog,
tree reduction, idempotent index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import strings as S
from gleaner.operators import retrieval as R
from gleaner.operators.passages import PassageIndex
from gleaner.plans.common import load, page_titles
from gleaner.session import shared_path

# Fixture binding: the page labels a metadata filter keeps.
FILTER_LABELS = [1, 3, 5]


def chunk_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    c = R.chunk(d, "text")
    return c.select("doc_id", F.col("chunk_pos").cast("int").alias("chunk_pos"),
                    F.col("n_tokens").cast("int").alias("n_tokens"), F.md5("chunk_text").alias("chunk_md5"))


def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    return R.hash_buckets(d, ["doc_id"], "text")


def _topk_out(t: DataFrame) -> DataFrame:
    return t.select(F.col("qid").alias("query_id"), F.col("cid").alias("vec_id"),
                    F.round("sim", 6).alias("sim"), F.col("rank").cast("int").alias("rnk"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings", ["vec_id", "embedding"])
    return _topk_out(R.cosine_topk(e, e, R.VECTOR_TOP_K, "vec_id", "vec_id", exclude_self=True))


def topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    coll = e.where(F.col("label").isin(FILTER_LABELS))          # pushed to the scan
    return _topk_out(R.cosine_topk(e, coll, R.VECTOR_TOP_K, "vec_id", "vec_id", exclude_self=True))


def topk_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    t = R.cosine_topk(e, e, R.VECTOR_TOP_K, "vec_id", "vec_id", scope="label", exclude_self=True)
    return _topk_out(t)


def two_level_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    t = R.two_level_topk(e, e, "vec_id", "vec_id", "label", exclude_self=True)
    return _topk_out(t)


def _doc_names(spark, sf):
    """Articles by their file names (title and site of every page)."""
    p = page_titles(spark, sf)
    return p.select(F.col("page_id").alias("doc_id"), S.article_file_name(F.col("title"), F.col("source"), F.lit(None)).alias("name"))


def tool_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return R.tool_catalog(_doc_names(spark, sf), "doc_id", "name").select(
        "doc_id", "kind", "tool_name", "description")


def catalog_topk(spark: SparkSession, sf: str) -> DataFrame:
    cat = R.tool_catalog(_doc_names(spark, sf), "doc_id", "name").withColumn(
        "tool_id", F.col("doc_id") * 2 + F.col("tool_pos"))
    cvec = R.hash_embed(cat, ["tool_id"], "description")
    q = R.hash_embed(load(spark, sf, "benchmark", ["item_id", "text"]), ["item_id"], "text")
    t = R.cosine_topk(q, cvec, R.TOOL_TOP_K, "item_id", "tool_id")
    return t.select(F.col("qid").alias("item_id"), F.col("cid").alias("tool_id"),
                    F.round("sim", 6).alias("sim"), F.col("rank").cast("int").alias("rnk"))


def tree_reduce(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    c = R.chunk(d, "text").select("doc_id", F.col("chunk_pos").cast("long").alias("pos"),
                                  F.col("chunk_text").alias("text"), F.col("n_chunks").cast("long").alias("n"))
    t = R.tree_reduce(c, "doc_id", fanout=4)
    return t.select("doc_id", F.md5("summary").alias("summary_md5"),
                    F.length("summary").cast("long").alias("n_chars"))


def index_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    c = R.chunk(d, "text").select("doc_id", F.col("chunk_pos").cast("int").alias("chunk_pos"),
                                  F.md5("chunk_text").alias("chunk_hash"))
    idx = R.VectorIndex(spark, shared_path(spark, "index", unique=True))
    idx.insert(c)
    idx.insert(c)          # a second start re-reads every document: adds nothing
    return idx.read().select("doc_id", "chunk_hash", "chunk_pos")


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The default embedding of every whole document, a row per component."""
    d = load(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    v = R.hash_embed(d, ["doc_id"], "text").select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    return v.select("doc_id", "dim", F.round("x", 9).alias("x"))


def passage_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark question -> its tools -> passages with text, through a stored
    index that is built twice (the second build finds every chunk and embeds none)."""
    docs = load(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    index = PassageIndex(spark, shared_path(spark, "passages", unique=True))
    for _ in range(2):
        index.build(docs)
    found = index.search(load(spark, sf, "benchmark", ["item_id", "text"]), "item_id")
    return found.select("item_id", F.col("rank").cast("int").alias("rnk"), "doc_id", "chunk_pos",
                        F.md5("chunk_text").alias("passage_md5"), F.round("sim", 6).alias("sim"))


def topk_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark question against all documents, by the languages that the
    question allows: none given (all), one, or two."""
    docs = load(spark, sf, "documents", ["doc_id", "text", "lang"], heavy=True)
    vectors = R.hash_embed(docs, ["doc_id"], "text").join(docs.select("doc_id", "lang"), "doc_id")
    q = load(spark, sf, "benchmark", ["item_id", "text"])
    allowed = (F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>"))
                .when(F.col("item_id") % 3 == 1, F.array(F.lit("en")))
                .otherwise(F.array(F.lit("de"), F.lit("fr"), F.lit("de"))))
    asked = R.hash_embed(q, ["item_id"], "text").withColumn("labels", allowed)
    t = R.topk_labelled(asked, vectors, R.VECTOR_TOP_K, "item_id", "doc_id", "labels", "lang")
    return t.select(F.col("qid").alias("item_id"), F.col("cid").alias("doc_id"),
                    F.round("sim", 6).alias("sim"), F.col("rank").cast("int").alias("rnk"))


QUERIES = {
    "doc_vectors": doc_vectors,
    "passage_topk": passage_topk,
    "topk_labels": topk_labels,
    "chunk_docs": chunk_docs,
    "embed_hash": embed_hash,
    "vector_topk": vector_topk,
    "topk_filtered": topk_filtered,
    "topk_by_doc": topk_by_doc,
    "two_level_topk": two_level_topk,
    "tool_catalog": tool_catalog,
    "catalog_topk": catalog_topk,
    "tree_reduce": tree_reduce,
    "index_idempotent": index_idempotent,
}
