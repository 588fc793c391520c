"""Registered queries: listing extraction, cap, keep-first, anti-join, registry.

Each function takes (spark, sf_dir) and returns a DataFrame over the whole
driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import strings as S
from gleaner.operators import extract as E
from gleaner.operators import ingest as I
from gleaner.plans.common import absolute_links, known_links, load, page_links
from gleaner.session import shared_path
from gleaner.sources.registry import RegistryStore


def scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select(
        "page_id", "url", F.length("html").cast("long").alias("n_html"))


def listing_links(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(spark, sf).where(F.col("href").isNotNull()).select("page_id", "pos", "href", "title")


def positional_cap(spark: SparkSession, sf: str) -> DataFrame:
    c = page_links(spark, sf).select("page_id", "pos", "href")
    return I.positional_cap(c, 3).where(F.col("href").isNotNull())


def absolutize(spark: SparkSession, sf: str) -> DataFrame:
    # link variants derived from each extracted link, one per position class
    c = page_links(spark, sf).where(F.col("href").isNotNull())
    v = (F.when(F.col("pos") % 4 == 0, F.col("href"))
          .when(F.col("pos") % 4 == 1, F.concat(F.lit("."), F.col("href")))
          .when(F.col("pos") % 4 == 2, F.concat(F.lit("http://mirror.example"), F.col("href")))
          .otherwise(F.substring(F.col("href"), 2, 1 << 30)))
    return c.select("page_id", "pos", v.alias("href_variant"),
                    S.absolutize(v, S.url_origin("url")).alias("abs_url"))


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    links = absolute_links(spark, sf).select("url", "page_id", "pos", "title")
    return I.dedup_first(links, order=["page_id", "pos"])


def anti_known(spark: SparkSession, sf: str) -> DataFrame:
    batch = absolute_links(spark, sf).select("page_id", "pos", "url")
    return I.anti_known(batch, known_links(spark, sf))


def _registry_old(spark, sf):
    old = known_links(spark, sf).select("url", "title", "source", "page_id", "pos")
    old = old.withColumn("publish_date", F.lit(None).cast("string")).withColumn("text", F.col("title"))
    return I.new_registry_rows(old, None, ["page_id", "pos"])


def _registry_batch(spark, sf):
    return (absolute_links(spark, sf)
            .select("url", "title", "source", "page_id", "pos",
                    F.lit(None).cast("string").alias("publish_date"),
                    F.col("title").alias("text")))


def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    reg = I.upsert(_registry_old(spark, sf), _registry_batch(spark, sf), ["page_id", "pos"])
    return reg.select("url", "article_file_path", "title", "source", "publish_date", "has_text", "is_new")


def new_articles(spark: SparkSession, sf: str) -> DataFrame:
    return registry_upsert(spark, sf).where("is_new")


def registry_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs through the append-only store, then read back."""
    store = RegistryStore(spark, shared_path(spark, "registry", unique=True))
    store.commit(_registry_old(spark, sf), store.next_batch_id())
    run = store.next_batch_id()
    new = I.new_registry_rows(_registry_batch(spark, sf), store.known_urls(before=run), ["page_id", "pos"])
    store.commit(new, run)
    return store.read().select("url", "article_file_path", "title", "source", "publish_date",
                               "has_text", "is_new")


def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    # one listing page = one site run; counts per page
    cands = page_links(spark, sf).select("page_id", "url", "pos", "href")
    arts = (I.positional_cap(cands, 3).where(F.col("href").isNotNull())
            .select("page_id", S.absolutize(F.col("href"), S.url_origin("url")).alias("url")))
    known = known_links(spark, sf).select("url")
    return I.ingest_counts(cands, arts, known, cap=3, source="page_id")


def container_scope(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages", ["page_id", "html"], heavy=True)
    prof = E.Profile(source="page", base_url="", container_tag="nav", cand_tag="a",
                     wrapped=False, title_tag=None, date_tag=None, cap=None)
    c = E.extract_listing(E.with_profile(pages, prof), keep=("page_id",))
    return c.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


def candidate_select(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages", ["page_id", "html"], heavy=True)
    prof = E.Profile(source="page", base_url="", cand_tag="div", cand_classes=("ad",),
                     cand_mode="one", wrapped=False, title_tag=None, date_tag=None, cap=None)
    c = E.extract_listing(E.with_profile(pages, prof), keep=("page_id",))
    return c.select("page_id", "pos", F.col("title").alias("text"))


def nth_date_node(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages", ["page_id", "html"], heavy=True)
    return pages.select("page_id", E.nth_node_text(F.col("html"), "p", None, 1, "article").alias("date_text"))


def body_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages", ["page_id", "html"], heavy=True)
    t = E.body_text(F.col("html"), F.lit("article"), F.lit(None).cast("string"))
    b = pages.select("page_id", t.alias("text"))
    return b.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages", ["page_id", "url", "html"], heavy=True)
    hdr = pages.select("page_id", E.header_item(F.col("html"), "article", None, "h1", None).alias("h"))
    head = hdr.where(F.col("h").isNotNull()).select(
        "page_id", F.lit(-1).alias("pos"), F.col("h.href").alias("href"), F.col("h.title").alias("title"))
    links = page_links(spark, sf).where(F.col("href").isNotNull()).select("page_id", "pos", "href", "title")
    return I.union_sources(head, links)


# Fixture dispatch profiles: three bases in rank order; pages on any other host
# match nothing.
DISPATCH_PROFILES = [
    E.Profile(source="blog", base_url="https://blog.", rank=1, body_rank=3, body_tag="article"),
    E.Profile(source="net", base_url="example.net", rank=2, body_rank=1, body_tag="nav"),
    E.Profile(source="com", base_url="example.com", rank=3, body_rank=2, body_tag="footer"),
]


# Fixture profiles for the listing warnings: a container no page has, the
# navigation list, and a footer without links.
WARNING_PROFILES = [
    E.Profile(source="blog", base_url="https://blog.", rank=1, container_tag="aside",
              cand_tag="a", title_tag=None, date_tag=None, cap=None),
    E.Profile(source="net", base_url="example.net", rank=2, container_tag="nav",
              cand_tag="a", title_tag=None, date_tag=None, cap=None),
    E.Profile(source="com", base_url="example.com", rank=3, container_tag="footer",
              cand_tag="a", title_tag=None, date_tag=None, cap=None),
]


def listing_warnings(spark: SparkSession, sf: str) -> DataFrame:
    from gleaner.operators.crawl import listing_warnings as warnings

    pages = load(spark, sf, "pages", ["page_id", "url", "html"], heavy=True)
    w = warnings(pages.select(F.col("page_id").alias("site_pos"), "url", "html"), WARNING_PROFILES)
    return w.select(F.col("site_pos").alias("page_id"), "source", "n_candidates", "status")


def profile_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages", ["page_id", "url"])
    return E.dispatch(pages, DISPATCH_PROFILES).select("page_id", F.col("pf_source").alias("source"))


def body_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages", ["page_id", "url", "html"], heavy=True)
    d = E.dispatch(pages, DISPATCH_PROFILES, order="body_rank")
    t = E.body_text(F.col("html"), F.col("pf_body_tag"), F.col("pf_body_class"))
    return d.select("page_id", F.col("pf_source").alias("source"), F.md5(t).alias("text_md5"))


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages", ["page_id", "url"]).select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    d = load(spark, sf, "documents", ["doc_id", "source"]).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "source")
    return I.union_sources(p, d)


QUERIES = {
    "scan_pages": scan_pages,
    "listing_warnings": listing_warnings,
    "listing_links": listing_links,
    "positional_cap": positional_cap,
    "absolutize": absolutize,
    "dedup_first": dedup_first,
    "anti_known": anti_known,
    "registry_upsert": registry_upsert,
    "new_articles": new_articles,
    "registry_roundtrip": registry_roundtrip,
    "ingest_counts": ingest_counts,
    "container_scope": container_scope,
    "candidate_select": candidate_select,
    "nth_date_node": nth_date_node,
    "body_text": body_text,
    "header_rows": header_rows,
    "profile_dispatch": profile_dispatch,
    "body_dispatch": body_dispatch,
    "union_sources": union_sources,
}
