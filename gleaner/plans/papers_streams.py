"""Registered queries: paper listings, streaming ingest, streaming state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import strings as S
from gleaner.operators import papers as P
from gleaner.operators.extract import extract_listing, with_profile
from gleaner.plans.common import NAV_PROFILE, host, load
from gleaner.session import materialize, shared_path, spread
from gleaner.sources.registry import RegistryStore
from gleaner.streaming.ingest import run_stream_ingest
from gleaner.streaming.state import read_state, start_state_stream


def paper_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as the nodes of paper listings, a page each: turns 0-1 lie in the
    first section, later turns in the second; a user turn is an entry, an
    assistant turn a detail with the turn's whole text."""
    c = load(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    section = F.when(F.col("turn") < 2, F.lit(0)).otherwise(F.lit(1))
    page = [F.col("conv_id").alias("page_id"), F.concat(F.lit("https://arxiv.org/list/conv"), F.col("conv_id").cast("string")).alias("url")]
    ref = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    entry, detail = F.col("role") == "user", F.col("role") == "assistant"
    people = F.array(F.col("role"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")))
    turns = c.where(entry | detail).select(
        *page, F.when(entry, F.lit("entry")).otherwise(F.lit("detail")).alias("kind"),
        (2 * F.col("turn") + 1).cast("int").alias("node"), section.alias("parent"), section.alias("section_pos"),
        F.when(entry, F.concat(F.lit("/abs/"), ref)).alias("href"), F.when(entry, F.concat(F.lit("/pdf/"), ref)).alias("pdf_href"),
        F.when(detail, F.concat(F.lit("Title:"), F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("title"),
        F.when(detail, people).alias("names"))
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("conv_id") + section).cast("int"))
    none = F.lit(None).cast("string")
    heads = c.select(*page, F.lit("section").alias("kind"), (4 * section).alias("node"), F.lit(None).cast("int").alias("parent"),
                     section.alias("section_pos"), none.alias("href"), none.alias("pdf_href"),
                     F.date_format(day, "EEE, d MMM yyyy").alias("title"), F.lit(None).cast("array<string>").alias("names")).distinct()
    return turns.unionByName(heads)


def _papers(spark: SparkSession, sf: str, compat: bool) -> DataFrame:
    # read by several joins; as a stored table of nodes would be
    a = P.articles_of_nodes(materialize(paper_nodes(spark, sf), "paper-nodes"), cap=20, compat=compat)
    return a.select("page_id", F.col("section_pos").cast("int").alias("section_pos"),
                    F.col("pos").cast("int").alias("pos"), "url", "pdf_url", "title",
                    F.array_join("authors", "|").alias("authors"), "publish_date")


def paper_listing(spark: SparkSession, sf: str) -> DataFrame:
    return _papers(spark, sf, compat=False)


def paper_listing_compat(spark: SparkSession, sf: str) -> DataFrame:
    """Every section sees all entries of its page; the first one's date stays."""
    return _papers(spark, sf, compat=True)


def _nav_articles(batch: DataFrame) -> DataFrame:
    c = extract_listing(with_profile(spread(batch.select("page_id", "url", "html")), NAV_PROFILE),
                        keep=("page_id", "url"))
    return (c.where(F.col("href").isNotNull())
             .select(S.absolutize(F.col("href"), S.url_origin("url")).alias("url"),
                     "title", host("url").alias("source"), "page_id", "pos",
                     F.lit(None).cast("string").alias("publish_date"), F.col("title").alias("text")))


#: Arrivals of the streaming queries, each a micro-batch.
ARRIVALS = 4


def arrivals(spark: SparkSession, sf: str, table: str, key: str) -> Iterator[DataFrame]:
    """A table as a stream that arrives in ``ARRIVALS`` parts, its rows dealt by ``key``; every
    row arrives.  After each part the stream of all files so far: a run to its end with
    one checkpoint finds that part's files new and takes them as one micro-batch.

    A part is as many files as the table has tasks, so no task reads or writes a whole part."""
    rows = load(spark, sf, table)
    folder = shared_path(spark, "arrivals", unique=True)
    for k in range(ARRIVALS):
        rows.where(F.pmod(F.col(key), F.lit(ARRIVALS)) == k).write.parquet(f"{folder}/{k}")
        yield spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder)


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The registry after the pages arrived in several micro-batches, a run each."""
    store = RegistryStore(spark, shared_path(spark, "stream-registry", unique=True))
    ckpt = shared_path(spark, "checkpoints", "stream-ingest", unique=True)
    for pages in arrivals(spark, sf, "pages", "page_id"):
        run_stream_ingest(spark, pages, store, _nav_articles, ["page_id", "pos"], ckpt)
    return store.read().select("url", "article_file_path", "title", "source", "publish_date",
                               "has_text", "is_new", F.col("batch_id").cast("int").alias("run"))


def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state after the events arrived in several micro-batches, with a snapshot
    between them."""
    log = shared_path(spark, "state-log", unique=True)
    ckpt = shared_path(spark, "checkpoints", "stream-state", unique=True)
    for events in arrivals(spark, sf, "events", "event_id"):
        stream = events.select("user_id", "event_type", "value", "ts", "event_id")
        start_state_stream(stream, ["user_id", "event_type"], "value", ["ts", "event_id"], log, ckpt, compact_every=3)
    return read_state(spark, log, ["user_id", "event_type"])


QUERIES = {
    "paper_listing": paper_listing,
    "paper_listing_compat": paper_listing_compat,
    "stream_ingest": stream_ingest,
    "stream_state": stream_state,
}
