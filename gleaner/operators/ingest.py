"""Incremental crawl ETL: listing rows -> articles -> keep-first -> unseen -> registry rows.

Plan shape (one Python stage, two shuffles on ``url`` that share one
partitioning):

    pages --dispatch(CASE)--> mapInPandas(listing) --cap, href, absolutize-->
    groupBy(url) min_by(ord)            # keep first, partial agg map-side
    left_anti registry on url           # only the registry side re-shuffles
    [body text]                         # Python, after dedup/anti-join
    registry rows
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import strings as S

ARTICLE_COLUMNS = ["title", "publish_date", "url", "source_url", "source"]


def positional_cap(df: DataFrame, cap: int, group: Sequence[str] = ("page_id",),
                   order: Sequence[str] = ("pos",)) -> DataFrame:
    """First ``cap`` rows per group in document order (before any other filter).

    ``row_number() <= cap`` is planned with a partial ``WindowGroupLimit`` so
    only ``cap`` rows per group and partition reach the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def listing_articles(cands: DataFrame, as_of, base_col: str = "pf_base_url",
                     source_col: str = "pf_source", strict: bool = False) -> DataFrame:
    """Candidate rows -> article rows.

    The cap was applied to candidates already; candidates without a link are
    dropped only now (so fewer than ``cap`` can survive), links are made
    absolute and the publish date is read from the date node.
    """
    return (cands
            .where(F.col("href").isNotNull())
            .select("*",
                    S.absolutize("href", F.col(base_col), strict).alias("url"),
                    D.publish_date("date_raw", "date_kind", as_of).alias("publish_date"),
                    F.col(base_col).alias("source_url"),
                    F.col(source_col).alias("source")))


def dedup_first(df: DataFrame, order: Sequence[str], key: str = "url") -> DataFrame:
    """Keep the first row per ``key`` in arrival order (null is one group).

    ``min_by(struct(row), struct(order))`` is an ordinary aggregate, so Spark
    pre-aggregates map-side: a key holding a third of the rows collapses to one
    row per task before the shuffle.  Not ``dropDuplicates`` (arbitrary row).
    """
    others = [c for c in df.columns if c != key]
    ordc = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in others]), ordc).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def anti_known(df: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not in ``known`` (exact, case-sensitive; null keys stay).

    A shuffled anti-join: both sides hash-partition on the key.  Nothing is
    broadcast on assumption; AQE broadcasts the known side at run time when it
    measures it as small.
    """
    return df.join(known.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def semi_known(df: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    return df.join(known.select(key), key, "left_semi")


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Union of per-source rows with different columns; missing columns are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def new_registry_rows(batch: DataFrame, known_urls: Optional[DataFrame], order: Sequence[str],
                      docs_dir: str = "docs") -> DataFrame:
    """Batch of articles -> registry rows to insert (insert-only upsert).

    Rows with a null/empty URL are rejected, the first article per URL wins,
    URLs already registered are skipped.  ``has_text`` is true for non-empty
    text; the document path follows the article file naming.
    """
    b = batch.where(F.nullif(F.col("url"), F.lit("")).isNotNull())
    b = dedup_first(b, order)
    if known_urls is not None:
        b = anti_known(b, known_urls)
    return registry_rows(b, order, docs_dir)


def registry_rows(b: DataFrame, order: Sequence[str], docs_dir: str = "docs") -> DataFrame:
    """Registry rows of articles that are new and one per URL already: a projection."""
    cols = set(b.columns)
    pdf = F.nullif(F.col("pdf_url"), F.lit("")).isNotNull() if "pdf_url" in cols else F.lit(False)
    text = F.col("text") if "text" in cols else F.lit(None).cast("string")
    return b.select(
        "url",
        F.concat(F.lit(docs_dir.rstrip("/") + "/"),
                 S.article_file_name(F.col("title"), F.col("source"), F.col("publish_date"), pdf)
                 ).alias("article_file_path"),
        F.col("title").cast("string").alias("title"),
        F.col("source").cast("string").alias("source"),
        F.col("publish_date").cast("string").alias("publish_date"),
        F.coalesce(F.length(text) > 0, F.lit(False)).alias("has_text"),
        *[F.col(c) for c in order],
    )


def upsert(registry: DataFrame, batch: DataFrame, order: Sequence[str],
           docs_dir: str = "docs") -> DataFrame:
    """Whole-table view of the insert-only upsert: every old row loses ``is_new``,
    unseen URLs are appended with ``is_new = true``; old rows never change."""
    new = new_registry_rows(batch, registry, order, docs_dir).withColumn("is_new", F.lit(True))
    old = registry.withColumn("is_new", F.lit(False))
    return old.unionByName(new, allowMissingColumns=True)


def ingest_counts(cands: DataFrame, articles: DataFrame, known: DataFrame, cap: int,
                  source: str = "source") -> DataFrame:
    """Per source: candidates found, kept by the cap, articles, unique URLs, new URLs."""
    found = cands.groupBy(source).agg(F.count(F.lit(1)).alias("n_found"))
    known_flag = articles.join(known.select("url").distinct().withColumn("_known", F.lit(True)),
                               "url", "left")
    per = known_flag.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_distinct("url").alias("n_unique"),
        F.count_distinct(F.when(F.col("_known").isNull(), F.col("url"))).alias("n_new"))
    return (found.join(per, source, "left")
            .select(source, "n_found",
                    F.least(F.col("n_found"), F.lit(cap)).alias("n_kept"),
                    F.coalesce("n_articles", F.lit(0)).alias("n_articles"),
                    F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
                    F.coalesce("n_new", F.lit(0)).alias("n_new")))


def new_or_all(registry: DataFrame) -> DataFrame:
    """New rows, or every row when nothing is new.

    The fallback is decided by a scalar subquery (a one-row aggregate Spark
    runs once and inlines), not by a driver-side ``count`` or a join.
    """
    any_new = registry.agg(F.coalesce(F.max(F.col("is_new").cast("int")), F.lit(0))).scalar()
    return registry.where(F.col("is_new") | (any_new == 0))


def section_first(entries: DataFrame, sections: DataFrame, key: Sequence[str],
                  section_order: str, section_cols: Sequence[str]) -> DataFrame:
    """Every entry takes the values of the first section of its page.

    The reference pairs every section with every page-wide entry and keeps the
    first section per entry; reducing the sections to the first one per page
    first gives the same rows without forming the pairs.
    """
    first = sections.groupBy(*key).agg(
        F.min_by(F.struct(*[F.col(c) for c in section_cols]), F.col(section_order)).alias("_s"))
    first = first.select(*key, *[F.col(f"_s.{c}").alias(c) for c in section_cols])
    return entries.join(first, list(key), "inner")


def path_collisions(rows: DataFrame, order: Sequence[str], path: str = "article_file_path") -> DataFrame:
    """Document paths shared by several articles (same title, source and date).

    All rows stay in the registry; this reports, per shared path, how many
    articles map to it and which one a file store would hold last (the last
    writer in ``order``) -- the file the reference would keep."""
    ordc = F.struct(*[F.col(c) for c in order])
    return (rows.groupBy(path)
                .agg(F.count(F.lit(1)).alias("n_articles"), F.max_by("url", ordc).alias("stored_url"))
                .where(F.col("n_articles") > 1))
