"""Browse-and-select over the registry: listing text, lookup, routing, prompts,
command classification, flag splits."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import strings as S

# The per-article instruction chosen by whether text is stored.
ROUTE_BROWSE = ("browse the URL of the article to scrape and extract article information by "
                "handing off to BrowserAgent,")
ROUTE_RETRIEVE = ("retrieve the article and extract article information from the knowledge base "
                  "by handing off to RetrieverAgent,")
# Prompt header and the three task templates, in option order.
PROMPT_HEADER = "Given this article with the title '%s', published by %s on %s at the url '%s',"
PROMPT_TEMPLATES = [
    "%s %s then summarize it.",
    ("%s %s then create a detailed report about it, with specific insights on the conclusion "
     "and the findings of the article, plus explain if what is described in the article is a "
     "game changer and, if so how."),
    ("%s search on DuckDuckGo for more information about the content of the article by "
     "handing off to BrowserAgent."),
]
EXIT_COMMAND = "/bye"


def article_listing(df: DataFrame, group: Sequence[str], order: Sequence[str],
                    title: str = "title", source: str = "source", date: str = "publish_date",
                    bucket: Column = None) -> DataFrame:
    """Numbered list text per group: ``\\t{i}) {title} - {source}, {date}\\n`` lines
    with zero-based ``i`` in ``order``, concatenated in order.

    Numbering and concatenation are two-level (see ``gleaner.operators.scan``)
    over ``bucket`` (a coarse monotone function of the order; default: the
    first order column divided by 1024)."""
    from gleaner.operators.scan import count_before, ordered_concat

    if bucket is None:
        bucket = F.floor(F.col(order[0]) / 1024)
    numbered = count_before(df, group, order, F.lit(True), bucket, out="_i")
    lines = numbered.select(*group, *order, S.listing_line(F.col("_i").cast("int"), F.col(title),
                                                           F.col(source), F.col(date)).alias("_line"))
    out = ordered_concat(lines, group, order, "_line", bucket, out="listing")
    return out.select(*group, F.col("n").alias("n_lines"), "listing")


def route(has_text: Column) -> Column:
    return F.when(has_text, F.lit("retrieve")).otherwise(F.lit("browse"))


def route_text(has_text: Column) -> Column:
    return F.when(has_text, F.lit(ROUTE_RETRIEVE)).otherwise(F.lit(ROUTE_BROWSE))


def prompt_table(registry: DataFrame) -> DataFrame:
    """Every article x the three task prompts (a generator, no join)."""
    header = F.format_string(PROMPT_HEADER, S.none_text("title"), S.none_text("source"),
                             S.none_text("publish_date"), S.none_text("url"))
    rt = route_text(F.coalesce(F.col("has_text"), F.lit(False)))
    prompts = F.array(
        F.struct(F.lit(0).alias("option"), F.format_string(PROMPT_TEMPLATES[0], header, rt).alias("prompt")),
        F.struct(F.lit(1).alias("option"), F.format_string(PROMPT_TEMPLATES[1], header, rt).alias("prompt")),
        F.struct(F.lit(2).alias("option"), F.format_string(PROMPT_TEMPLATES[2], header).alias("prompt")),
    )
    return registry.select("url", F.inline(prompts))


def classify_command(cmd: Column, n_options: int) -> Column:
    """``option`` for an integer in [0, n), ``invalid`` for other integers,
    ``exit`` for ``/bye``, ``query`` for any other text."""
    integer = cmd.rlike(r"^\s*[+-]?[0-9]+\s*$")
    n = F.trim(cmd).try_cast("decimal(38,0)")          # null beyond 38 digits: out of range as well
    return (F.when(integer & (n >= 0) & (n < n_options), F.lit("option"))
             .when(integer, F.lit("invalid"))
             .when(cmd == EXIT_COMMAND, F.lit("exit"))
             .otherwise(F.lit("query")))


def lookup_first(registry: DataFrame, selected: DataFrame, seq: Sequence[str],
                 cols: Sequence[str], key: str = "url") -> DataFrame:
    """For each selected key, the first registry row (by ``seq``) with that key.

    The registry is reduced per key first (partial aggregation), then joined
    with the selection; no per-key list is built.
    """
    first = registry.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in seq])).alias("_r"))
    sel = selected.select(key).distinct()
    return first.join(sel, key, "inner").select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def flag_split(df: DataFrame, flag: Column, group: Sequence[str], order: str) -> DataFrame:
    """Per group: first flagged row (by ``order``), flagged count, unflagged count.
    A missing flag counts as false."""
    f = F.coalesce(flag, F.lit(False))
    return df.groupBy(*group).agg(
        F.min(F.when(f, F.col(order))).alias("first_flagged"),
        F.count_if(f).alias("n_flagged"),
        F.count_if(~f).alias("n_rest"))
