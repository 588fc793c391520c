"""Shared helpers for the registered queries: table loading and fixture profiles."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import strings as S
from gleaner.operators.extract import Profile, extract_listing, with_profile
from gleaner.session import spread, table_path

AS_OF = "2025-01-31"


def load(spark: SparkSession, sf_dir: str, name: str, cols: Optional[Sequence[str]] = None,
         heavy: bool = False) -> DataFrame:
    """A driver table with only ``cols``.  ``heavy``: the caller does costly
    per-row work (HTML parsing, tokenizing), so an under-partitioned scan is
    spread over the cores first (see ``gleaner.session.spread``)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*cols) if cols else df
    return spread(df) if heavy else df


# Fixture binding of a listing page: the navigation list, one link per item.
NAV_PROFILE = Profile(source="page", base_url="", container_tag="nav",
                      cand_tag="li", cand_mode=None, wrapped=True,
                      link_tag="a", title_tag="a", date_tag=None, cap=None)


def host(url_col: str = "url"):
    return F.regexp_extract(F.col(url_col), r"://([^/?#]*)", 1)


def page_links(spark: SparkSession, sf_dir: str, profile: Profile = NAV_PROFILE,
               where=None) -> DataFrame:
    """Candidate rows of every page's navigation list: page_id, url, pos, href, title."""
    pages = spark.read.parquet(table_path(sf_dir, "pages")).select("page_id", "url", "html")
    if where is not None:
        pages = pages.where(where)            # pushed to the scan, before parsing
    return extract_listing(with_profile(spread(pages), profile), keep=("page_id", "url"))


def absolute_links(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """page_id, pos, url (absolute), title, source (host), page_url."""
    c = page_links(spark, sf_dir, where=where)
    return (c.where(F.col("href").isNotNull())
             .select("page_id", "pos",
                     S.absolutize(F.col("href"), S.url_origin("url")).alias("url"),
                     "title", host("url").alias("source"), F.col("url").alias("page_url")))


def known_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The already-registered articles of the fixtures: links found on plain-http pages.

    The page filter is applied before the Python stage (Catalyst cannot move
    it through ``mapInPandas``), so only those pages are parsed."""
    return absolute_links(spark, sf_dir, F.col("url").startswith("http://"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, title (whole, as in the markup) and source (its site) of every page."""
    pages = load(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
                        F.regexp_extract("url", r"://(?:[^/?#]*\.)?([a-z0-9-]+\.[a-z]+)(?:[/?#]|$)", 1).alias("source"))
