"""Paper listings: sections of entries (``dt``) with their details (``dd``).

A parsed page is a table of typed nodes (sections, entries, details, see
``parse_pages``); everything else is joins and ordered scans over it.  An entry's
detail is the next detail below the same parent, its place the number of entries before it
in its section, both found by two-level scans, so a page that holds a third
of all nodes is spread over tasks.  The cap is applied before titles and
author lists are joined to the entries.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.operators import scan
from gleaner.operators.extract import Profile, parse_pages, with_profile
from gleaner.operators.ingest import dedup_first

# The paper site base, the title prefix length cut from each
# title, and the source name of paper articles.
PAPER_BASE = "https://arxiv.org"
TITLE_PREFIX_LEN = 6
PAPER_SOURCE = "arxiv"
#: Nodes of a page that one task scans together.
NODE_BUCKET = 4096


def _abs(h):
    return F.when(h.isNull(), F.lit(None).cast("string")) \
            .when(h.startswith("https"), h).otherwise(F.concat(F.lit(PAPER_BASE), h))


def articles_of_nodes(nodes: DataFrame, cap: int = 20, compat: bool = False,
                      page: Sequence[str] = ("page_id",)) -> DataFrame:
    """Typed nodes -> paper articles.

    ``nodes``: the ``page`` columns, ``url`` (of the page), ``kind`` (section, entry,
    detail), ``node``, ``parent``, ``section_pos``, ``href``, ``pdf_href``, ``title``
    (a section's heading, a detail's title), ``names``.  An entry counts in its own
    section; with ``compat`` every section sees all entries of the page, of which
    keep-first leaves the first section's."""
    page = list(page)
    bucket = F.floor(F.col("node") / NODE_BUCKET)
    entry, detail = F.col("kind") == "entry", F.col("kind") == "detail"
    narrow = nodes.where(entry | detail).select(*page, "kind", "node", "parent", "section_pos")
    paired = scan.next_matching(narrow, [*page, "parent"], ["node"], detail, "node", bucket, out="detail")
    within = page if compat else [*page, "section_pos"]
    placed = scan.count_before(paired, within, ["node"], entry, bucket, out="pos").where(entry & (F.col("pos") < cap))
    sections = nodes.where(F.col("kind") == "section").select(*page, "section_pos", F.col("title").alias("head"))
    if compat:                     # the first section of the page is the one that keep-first leaves
        first = sections.groupBy(*page).agg(F.min_by(F.struct("section_pos", "head"), "section_pos").alias("s"))
        placed = placed.drop("section_pos").join(first, page).select(*page, "node", "detail", "pos", "s.*")
    else:
        placed = placed.join(sections, [*page, "section_pos"]).select(*page, "node", "detail", "pos", "section_pos", "head")
    links = nodes.where(entry).select(*page, "url", "node", "href", "pdf_href")
    details = nodes.where(detail).select(*page, F.col("node").alias("detail"), "title", "names")
    full = placed.join(links, [*page, "node"]).join(details, [*page, "detail"], "left")
    arts = full.select(
        *page, "section_pos", F.col("pos").cast("int").alias("pos"),
        _abs(F.col("href")).alias("article_url"),
        _abs(F.col("pdf_href")).alias("pdf_url"),
        F.substring("title", TITLE_PREFIX_LEN + 1, 1 << 30).alias("title"),
        F.coalesce("names", F.array().cast("array<string>")).alias("authors"),
        D.section_date("head").alias("publish_date"),
        F.col("url").alias("source_url"),
        F.lit(PAPER_SOURCE).alias("source"))
    return dedup_first(arts.withColumnRenamed("article_url", "url"), order=[*page, "section_pos", "pos"])


def paper_articles(pages: DataFrame, cap: int = 20, compat: bool = False) -> DataFrame:
    """Paper listing pages (page_id, url, html) -> paper articles.

    Columns: page_id, section_pos, pos, url, pdf_url, title, authors,
    publish_date, source_url, source.
    """
    from gleaner.session import materialize

    paper = Profile(source=PAPER_SOURCE, base_url=PAPER_BASE, parser="paper")
    # read several times by the scans: parsed once
    nodes = materialize(parse_pages(with_profile(pages.select("page_id", "url", "html"), paper), keep=("page_id", "url")))
    return articles_of_nodes(nodes, cap, compat)
