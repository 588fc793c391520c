"""Registered queries: whole ingest runs over all pages (registry and documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import browse as B
from gleaner.operators import crawl
from gleaner.operators.extract import Profile
from gleaner.operators.profiles import HeaderRule
from gleaner.plans.common import AS_OF, load
from gleaner.session import shared_path
from gleaner.sources.registry import RegistryStore

# Fixture profiles: three sites in rank order, their articles listed in the
# navigation, their bodies in the article element (another order); two show the
# first article above the list.
_NAV = dict(container_tag="nav", cand_tag="li", wrapped=True, link_tag="a", title_tag="a", date_tag=None, body_tag="article")
SITES = [
    Profile(source="com", base_url="example.com", rank=1, body_rank=3, **_NAV),
    Profile(source="net", base_url="example.net", rank=2, body_rank=1, **_NAV),
    Profile(source="org", base_url="example.org", rank=3, body_rank=2, **_NAV),
]
HEADERS = [
    HeaderRule(source="net", base_url="example.net", container_tag="nav", container_class=None, link_tag="a", link_class=None),
    HeaderRule(source="org", base_url="example.org", container_tag="nav", container_class=None, link_tag="a", link_class=None,
               href_mode="drop_first_char"),
]


def fetched_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages again as fetched articles: each under the address that its list shows first."""
    site = F.regexp_extract("url", r"(example\.(com|net|org))", 1)
    return load(spark, sf, "pages", ["page_id", "url", "html"], heavy=True).select(
        F.concat(site, F.regexp_extract("html", '<li><a href="([^"]*)"', 1)).alias("url"), "html", F.col("page_id").alias("page_pos"))


def two_runs(spark: SparkSession, sf: str) -> RegistryStore:
    """A first run over the plain-http pages, a second over all pages."""
    store = RegistryStore(spark, shared_path(spark, "ingest-registry", unique=True))
    pages = load(spark, sf, "pages", ["page_id", "url", "html"], heavy=True)
    listing = pages.select(F.col("page_id").alias("site_pos"), "url", "html")
    for batch in (listing.where(F.col("url").startswith("http://")), listing):
        crawl.run_ingest(store, batch, fetched_pages(spark, sf), profiles=SITES, rules=HEADERS, as_of=AS_OF)
    return store


def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    """The registry after two runs: flags, file paths, which route an article takes."""
    return two_runs(spark, sf).read().select("url", "article_file_path", "title", "source", "publish_date", "has_text",
                                             "is_new", B.route(F.col("has_text")).alias("route"))


def document_table(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the same two runs."""
    return two_runs(spark, sf).documents().select("path", "url", "kind", F.md5("body").alias("body_md5"),
                                                  F.length("body").cast("long").alias("n_chars"))


QUERIES = {"ingest_run": ingest_run, "document_table": document_table}
