"""Document store: article documents as JSON text, paged documents, folder scans."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from gleaner.functions import strings as S
from gleaner.operators.ingest import anti_known

# Field order of an article document (listing articles; paper articles add
# authors and pdf_url before the text).
ARTICLE_FIELDS = ["title", "publish_date", "url", "source_url", "source"]
PAPER_FIELDS = ["title", "authors", "publish_date", "url", "source_url", "source", "pdf_url"]


def article_documents(articles: DataFrame, fields: Sequence[str] = ARTICLE_FIELDS + ["text"]) -> DataFrame:
    """(url, body) where body is the article as one JSON text, nulls kept."""
    arrays = [f for f in fields if isinstance(articles.schema[f].dataType, ArrayType)]
    return articles.select("url", S.json_document(fields, arrays).alias("body"))


def paged_concat(pages: DataFrame, doc: Sequence[str], page_no: str, text: str = "text",
                 bucket_pages: int = 1024) -> DataFrame:
    """Pages of a document -> one text in page order, no separator.

    Two-level: runs of ``bucket_pages`` pages are concatenated in parallel,
    then joined per document, so a document with a huge page count is not
    sorted by one task."""
    from gleaner.operators.scan import ordered_concat

    out = ordered_concat(pages, doc, [page_no], text, F.floor(F.col(page_no) / bucket_pages))
    return out.select(*doc, F.col("n").alias("n_pages"), "body")


def doc_kind(pdf_url: Column) -> Column:
    """``pdf`` when a PDF link is present (non-empty), else ``json``."""
    return F.when(F.nullif(pdf_url, F.lit("")).isNotNull(), F.lit("pdf")).otherwise(F.lit("json"))


def pending_downloads(wanted: DataFrame, fetched: DataFrame, key: str = "pdf_url") -> DataFrame:
    """Wanted binaries not fetched yet (a binary already present is reused)."""
    w = wanted.where(F.nullif(F.col(key), F.lit("")).isNotNull())
    return anti_known(w, fetched, key)


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text and PDF files of a folder: (path, name, content) with name the
    lower-cased file stem.  Only ``.pdf``/``.txt`` names are read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,txt}")
          .load(folder).select("path", "content"))
    return df.select("path", S.path_stem("path").alias("name"), "content")


def read_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole ``.txt`` files as one row each: (path, name, text)."""
    df = (spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder)
          .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    return df.select("path", S.path_stem("path").alias("name"), "text")


def document_rows(articles: DataFrame, paged: Optional[DataFrame] = None,
                  docs_dir: str = "docs") -> DataFrame:
    """The document table (path, url, kind, body) of new articles.

    An article with a PDF link is stored as the text of its pages (``paged``:
    (pdf_url, body), e.g. from ``paged_concat``); any other article as its JSON
    text.  The path follows the article file naming (``.txt`` added after
    cleaning for paged documents, before it for JSON ones)."""
    cols = set(articles.columns)
    pdf = F.col("pdf_url") if "pdf_url" in cols else F.lit(None).cast("string")
    a = articles.withColumn("_pdf", pdf)
    kind = doc_kind(F.col("_pdf"))
    text = ["text"] if "text" in cols else []
    listing_json = S.json_document([f for f in ARTICLE_FIELDS if f in cols] + text)
    if "authors" in cols:
        # paper articles always carry an authors list; listing articles have no such key
        arrays = [f for f in PAPER_FIELDS if f in cols and isinstance(articles.schema[f].dataType, ArrayType)]
        paper_json = S.json_document([f for f in PAPER_FIELDS if f in cols] + text, arrays)
        doc_json = F.when(F.col("authors").isNotNull(), paper_json).otherwise(listing_json)
    else:
        doc_json = listing_json
    out = a.select("url", "_pdf", kind.alias("kind"),
                   F.concat(F.lit(docs_dir.rstrip("/") + "/"),
                            S.article_file_name(F.col("title"), F.col("source"), F.col("publish_date"),
                                                kind == "pdf")).alias("path"),
                   doc_json.alias("_json"))
    if paged is not None:
        out = out.join(paged.select(F.col("pdf_url").alias("_pdf"), F.col("body").alias("_paged")),
                       "_pdf", "left")
    else:
        out = out.withColumn("_paged", F.lit(None).cast("string"))
    body = F.when(F.col("kind") == "pdf", F.col("_paged")).otherwise(F.col("_json"))
    return out.select("path", "url", "kind", body.alias("body"))
