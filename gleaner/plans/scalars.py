"""Registered queries: date and string expressions, JSON paths, documents,
browse-and-select over the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import strings as S
from gleaner.operators import browse as B
from gleaner.operators import ingest as I
from gleaner.plans import links as L
from gleaner.plans.common import AS_OF, absolute_links, load, page_titles
from gleaner.sources import config as C
from gleaner.sources import documents as DOC


def date_attr(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    raw = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", raw.alias("raw"), D.attr_date(raw).alias("publish_date"))


def _rendered_dates(spark, sf):
    """Each order's date written the way its priority class writes dates
    (four listing formats, and free text for the lowest class)."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    k = F.col("o_orderpriority")
    raw = (F.when(k == "1-URGENT", F.date_format("o_orderdate", "MMMM d, yyyy"))
            .when(k == "2-HIGH", F.date_format("o_orderdate", "MMM d, yyyy"))
            .when(k == "3-MEDIUM", F.date_format("o_orderdate", "MM.dd.yyyy"))
            .when(k == "4-NOT SPECIFIED", F.date_format("o_orderdate", "dd/MM/yyyy"))
            .otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))))
    return o.select("o_orderkey", raw.alias("raw"))


def date_cascade(spark: SparkSession, sf: str) -> DataFrame:
    r = _rendered_dates(spark, sf)
    return r.select("o_orderkey", "raw", D.cascade_date("raw", AS_OF).alias("publish_date"))


def date_relative(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part", ["p_partkey", "p_size"])
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" giorni fa"))
    return p.select("p_partkey", raw.alias("raw"), D.cascade_date(raw, AS_OF).alias("publish_date"))


def section_date(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus"])
    d = F.date_format("o_orderdate", "EEE, d MMM yyyy")
    # pending orders get a heading that does not start with the date
    head = (F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("New submissions for "), d))
             .otherwise(F.concat(d, F.lit(" (showing first entries)"))))
    return o.select("o_orderkey", head.alias("section_head"), D.section_date(head).alias("publish_date"))


def safe_filename(spark: SparkSession, sf: str) -> DataFrame:
    """The file name of every page's article: whole title, site, no date."""
    p = page_titles(spark, sf)
    return p.select("page_id", S.article_file_name(F.col("title"), F.col("source"), F.lit(None)).alias("file_name"))


def camel_case(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events", ["event_type"])
    s = F.concat_ws("_", F.col("event_type"), F.col("event_type"), F.lit("log"))
    return e.select(s.alias("snake")).distinct().select("snake", S.camel_case("snake").alias("camel"))


def run_date(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored document stamped with the run date (the clock is ``as_of``)."""
    return load(spark, sf, "documents", ["doc_id"]).select("doc_id", D.run_date(AS_OF).alias("run_date"))


def doc_stem(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages", ["page_id", "url"]).select("page_id", S.path_stem("url").alias("stem"))


def json_path_get(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events", ["event_id", "props"])
    return e.select("event_id", C.json_path_get("props", "k").alias("k"),
                    C.json_path_get("props", "z", "default").alias("z"))


def doc_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one JSON text: a null title, and the whole text."""
    d = load(spark, sf, "documents", ["doc_id", "source", "lang", "text"])
    d = d.withColumn("title", F.lit(None).cast("string"))
    return d.select("doc_id", S.json_document(["title", "source", "lang", "text"]).alias("body"))


def _pdf_pages(spark, sf):
    p = load(spark, sf, "pages", ["page_id", "url"])
    pdf = F.when(F.col("url").endswith(".html"), F.regexp_replace("url", r"\.html$", ".pdf"))
    return p.select("page_id", "url", pdf.alias("pdf_url"))


def doc_kind(spark: SparkSession, sf: str) -> DataFrame:
    p = _pdf_pages(spark, sf)
    return p.select("page_id", "pdf_url", DOC.doc_kind(F.col("pdf_url")).alias("kind"))


def pending_downloads(spark: SparkSession, sf: str) -> DataFrame:
    p = _pdf_pages(spark, sf)
    fetched = p.where(F.col("url").startswith("https://blog.")).select("pdf_url")
    return DOC.pending_downloads(p.select("page_id", "pdf_url"), fetched)


def paged_concat(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations", ["conv_id", "turn", "text"])
    d = DOC.paged_concat(c, ["conv_id"], "turn")
    return d.select("conv_id", "n_pages", F.md5("body").alias("body_md5"),
                    F.length("body").cast("long").alias("n_chars"))


def day_part(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events", ["ts"])
    return e.groupBy(D.day_part("ts").alias("part")).agg(F.count(F.lit(1)).alias("n"))


def classify_commands(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events", ["event_id", "event_type", "props"])
    k = C.json_path_get("props", "k")
    cmd = (F.when(F.col("event_type") == "signup", F.lit(B.EXIT_COMMAND))
            .when(F.col("event_type").isin("view", "click"), k)
            .otherwise(F.col("event_type")))
    return e.select("event_id", cmd.alias("cmd")).select(
        "event_id", "cmd", B.classify_command(F.col("cmd"), 50).alias("kind"))


def flag_split(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents", ["doc_id", "source"])
    lab = load(spark, sf, "labels", ["doc_id", "quality"])
    j = d.join(lab, "doc_id", "left")
    out = B.flag_split(j, F.col("quality") == 1, ["source"], "doc_id")
    return out.select("source", F.coalesce("first_flagged", F.lit(-1)).alias("first_flagged"),
                      "n_flagged", "n_rest")


def _registry(spark, sf):
    return L.registry_upsert(spark, sf)


def route_articles(spark: SparkSession, sf: str) -> DataFrame:
    r = _registry(spark, sf)
    return r.select("url", B.route(F.col("has_text")).alias("route"))


def prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    return B.prompt_table(_registry(spark, sf))


def lookup_article(spark: SparkSession, sf: str) -> DataFrame:
    links = absolute_links(spark, sf).select("url", "title", "page_id", "pos")
    selected = links.where(F.col("pos") == 0)
    return B.lookup_first(links, selected, ["page_id", "pos"], ["title", "page_id"])


def new_or_all(spark: SparkSession, sf: str) -> DataFrame:
    with_new = I.new_or_all(_registry(spark, sf)).select(F.lit("with_new").alias("variant"), "url", "is_new")
    old = L._registry_old(spark, sf).withColumn("is_new", F.lit(False))
    no_new = I.new_or_all(old).select(F.lit("no_new").alias("variant"), "url", "is_new")
    return with_new.unionByName(no_new)


def article_listing(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    c = c.select("conv_id", "turn", F.col("text").alias("title"),
                 F.col("role").alias("source"), F.col("turn").cast("string").alias("publish_date"))
    out = B.article_listing(c, ["conv_id"], ["turn"])
    return out.select("conv_id", "n_lines", F.md5("listing").alias("listing_md5"))


def path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose article path (title, site) is shared with another page; the last
    writer in page_id order is the one a file store would keep."""
    p = page_titles(spark, sf)
    rows = p.select(F.col("page_id").cast("string").alias("url"), "page_id",
                    S.article_file_name(F.col("title"), F.col("source"), F.lit(None)).alias("article_file_path"))
    out = I.path_collisions(rows, ["page_id"])
    return out.select("article_file_path", "n_articles", F.col("stored_url").alias("stored_page"))


QUERIES = {
    "path_collisions": path_collisions,
    "date_attr": date_attr,
    "date_cascade": date_cascade,
    "date_relative": date_relative,
    "section_date": section_date,
    "safe_filename": safe_filename,
    "camel_case": camel_case,
    "run_date": run_date,
    "doc_stem": doc_stem,
    "json_path_get": json_path_get,
    "doc_json": doc_json,
    "doc_kind": doc_kind,
    "pending_downloads": pending_downloads,
    "paged_concat": paged_concat,
    "day_part": day_part,
    "classify_commands": classify_commands,
    "flag_split": flag_split,
    "route_articles": route_articles,
    "prompt_table": prompt_table,
    "lookup_article": lookup_article,
    "new_or_all": new_or_all,
    "article_listing": article_listing,
}
