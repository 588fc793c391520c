"""One ingest run over crawled listing pages, end to end.

    listing pages (site_pos, url, html)
      -> dispatch (CASE chain on the URL)         no shuffle
      -> tagged rows of one tree per page         one Python stage, written once
      -> header rows (pos = -1) | list rows | paper nodes, paired by scans
      -> positional cap, link filter, absolute URL, publish date
      -> keep first per URL (site order, section, position)
      -> drop URLs already registered             shuffle on url, shared
      -> article pages joined by URL, body text   Python, only for new URLs
      -> registry rows (has_text, file path) and documents (path, body), one commit

Article pages for the body stage come as a table ``(url, html)`` of fetched
pages (fetching itself is outside Spark).
"""

from __future__ import annotations

from dataclasses import replace
from typing import Callable, Optional, Sequence, Union

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.operators import extract as E
from gleaner.operators import ingest as I
from gleaner.operators.papers import articles_of_nodes
from gleaner.operators.profiles import HEADER_RULES, SOURCE_PROFILES, HeaderRule
from gleaner.session import materialize
from gleaner.sources.documents import document_rows
from gleaner.sources.registry import RegistryStore

ORDER = ["site_pos", "section_pos", "pos"]
_PARSED = ("site_pos", "url", "pf_base_url", "pf_source")


def parsed(pages: DataFrame, profiles: Sequence[E.Profile], rules: Sequence[HeaderRule] = ()) -> DataFrame:
    """Everything the listing pages give, as tagged rows: one scan, one tree per page."""
    return E.parse_pages(E.dispatch(pages.select("site_pos", "url", "html"), profiles), _PARSED, rules)


def listing_rows(tagged: DataFrame, as_of) -> DataFrame:
    """Articles of the list part of parsed listing pages."""
    arts = I.listing_articles(tagged.where(F.col("kind") == "listing").drop("url"), as_of)
    return arts.select("site_pos", F.lit(0).alias("section_pos"), "pos", *I.ARTICLE_COLUMNS)


def header_articles(tagged: DataFrame, rules: Sequence[HeaderRule]) -> DataFrame:
    """The header article of parsed pages that have one, with ``pos = -1`` (it comes
    before the list and is outside the cap)."""
    def by_rule(value):
        """A column per rule, chosen by the row's rule number."""
        chain = F.lit(None).cast("string")
        for i, r in enumerate(rules):
            chain = F.when(F.col("node") == i, value(r)).otherwise(chain)
        return chain

    def link(r: HeaderRule):
        return F.concat(F.lit(r.base_url), F.substring("href", 2, 1 << 30)) if r.href_mode == "drop_first_char" else F.col("href")

    def day(r: HeaderRule):
        return (F.date_format(F.try_to_date(D.squash_ws(F.col("date_raw")), r.date_format), "yyyy-MM-dd")
                if r.date_format else F.lit(None).cast("string"))

    found = tagged.where((F.col("kind") == "header") & F.col("href").isNotNull())
    return found.select("site_pos", F.lit(0).alias("section_pos"), F.lit(-1).alias("pos"), "title",
                        by_rule(day).alias("publish_date"), by_rule(link).alias("url"),
                        by_rule(lambda r: F.lit(r.base_url)).alias("source_url"), by_rule(lambda r: F.lit(r.source)).alias("source"))


def paper_rows(tagged: DataFrame, cap: int, compat: bool) -> DataFrame:
    a = articles_of_nodes(tagged, cap, compat, page=("site_pos",))
    return a.select("site_pos", "section_pos", "pos", "title", "authors", "publish_date", "url", "source_url", "source", "pdf_url")


def listing_warnings(pages: DataFrame, profiles: Sequence[E.Profile] = SOURCE_PROFILES) -> DataFrame:
    """Per listing page: matched source, candidate count and a status --
    ``ok``, ``no_candidates``, ``no_container`` (the reference would crash) or
    ``no_profile`` (no listing rule matches the URL).  No shuffle."""
    rows = parsed(pages, [p for p in profiles if p.parser == "listing"]).where(F.col("kind") == "status")
    return rows.select("site_pos", "url", F.col("pf_source").alias("source"),
                       F.col("pos").cast("long").alias("n_candidates"), F.col("date_kind").alias("status"))


def header_rows(pages: DataFrame, rules: Sequence[HeaderRule] = HEADER_RULES) -> DataFrame:
    """The header articles of pages whose URL contains a rule's base."""
    rules = list(rules)
    bare = E.dispatch(pages.select("site_pos", "url", "html"), [])
    return header_articles(E.parse_pages(bare, _PARSED, rules, by_url=True), rules)


def ingest_articles(listing_pages: DataFrame, registry_urls: Union[DataFrame, Callable, None],
                    article_pages: Optional[DataFrame] = None,
                    profiles: Sequence[E.Profile] = SOURCE_PROFILES,
                    rules: Sequence[HeaderRule] = HEADER_RULES,
                    *, as_of, cap: int = 20, compat: bool = False, metrics: Optional[dict] = None) -> DataFrame:
    """The new articles of one run, one row per URL, with their body ``text``.

    Listing pages are parsed once: the tagged rows are written to the shared folder,
    as the listing, header and paper branches all read them.  ``registry_urls`` may be a
    function of the run's articles (url, ...) that gives them, written once, and
    the known URLs among them.  Of several fetched
    pages of one URL the first counts (``page_pos``, if the table has it)."""
    rules = list(rules)
    # paper profiles stay in the chain so that first-match dispatch is decided over all profiles
    capped = [replace(p, cap=cap) if p.parser == "listing" else p for p in profiles]
    tagged = materialize(parsed(listing_pages, capped, rules), "parsed-pages")
    parts = [header_articles(tagged, rules), listing_rows(tagged, as_of)]
    if any(p.parser == "paper" for p in profiles):
        parts.append(paper_rows(tagged, cap, compat))
    arts = I.union_sources(*parts)
    if metrics is not None:
        metrics["found"] = Observation("ingest_found")
        arts = arts.observe(metrics["found"], F.count(F.lit(1)).alias("n_found"))
    arts = arts.where(F.nullif(F.col("url"), F.lit("")).isNotNull())
    arts = I.dedup_first(arts, ORDER)
    if callable(registry_urls):
        arts, registry_urls = registry_urls(arts)
    if registry_urls is not None:
        arts = I.anti_known(arts, registry_urls)
    if article_pages is None:
        return arts.withColumn("text", F.lit(None).cast("string"))
    # body text only for the URLs that survived: the Python stage sees new articles only
    place = F.col("page_pos") if "page_pos" in article_pages.columns else F.lit(0)
    fetched = article_pages.select("url", "html", place.cast("long").alias("page_pos"))
    body = E.dispatch(fetched.join(arts.select("url"), "url", "left_semi"), profiles, order="body_rank")
    body = body.select("url", "page_pos", E.body_text(F.col("html"), F.col("pf_body_tag"), F.col("pf_body_class")).alias("text"))
    body = body.groupBy("url").agg(F.min_by(F.struct("text"), F.struct("page_pos", "text")).alias("b")).select("url", "b.text")
    return arts.join(body, "url", "left")


def run_ingest(store: RegistryStore, listing_pages: DataFrame, article_pages: Optional[DataFrame] = None,
               paged: Optional[DataFrame] = None, docs_dir: str = "docs", **options) -> int:
    """One whole run: the new articles' registry rows and documents, committed
    together.  ``paged``: texts of paged documents (pdf_url, body).  Returns the run."""
    def build(run: int) -> dict:
        # both tables are made of the same articles
        arts = materialize(ingest_articles(listing_pages, lambda batch: store.new_among(batch, run), article_pages, **options),
                           "new-articles")
        return {"data": I.registry_rows(arts, ORDER, docs_dir), "documents": document_rows(arts, paged, docs_dir)}

    return store.append(build)


def ingest_run(listing_pages: DataFrame, registry_urls: Optional[DataFrame],
               article_pages: Optional[DataFrame] = None,
               profiles: Sequence[E.Profile] = SOURCE_PROFILES,
               rules: Sequence[HeaderRule] = HEADER_RULES,
               *, as_of, cap: int = 20, compat: bool = False,
               docs_dir: str = "docs", metrics: Optional[dict] = None) -> DataFrame:
    """New registry rows of one run (``is_new`` rows to append).

    ``listing_pages``: (site_pos, url, html), site_pos = position in the site
    list.  ``registry_urls``: URLs already registered.  ``article_pages``:
    fetched article pages (url, html) for the body text.  ``metrics``: a dict
    that receives ``pyspark.sql.Observation`` objects ``found`` (n_found) and
    ``new`` (n_new, n_with_text); their values are filled by the run's own
    action (``metrics["new"].get`` after writing the rows), with no extra job.
    """
    arts = ingest_articles(listing_pages, registry_urls, article_pages, profiles, rules,
                           as_of=as_of, cap=cap, compat=compat, metrics=metrics)
    rows = I.registry_rows(arts, ORDER, docs_dir)
    if metrics is not None:
        metrics["new"] = Observation("ingest_new")
        rows = rows.observe(metrics["new"], F.count(F.lit(1)).alias("n_new"),
                            F.count_if(F.col("has_text")).alias("n_with_text"))
    return rows
