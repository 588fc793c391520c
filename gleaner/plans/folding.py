"""Registered queries: transcript folding, section pairing and next-row lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import ingest as I
from gleaner.operators import scan
from gleaner.operators import transcripts as TR
from gleaner.plans.common import load

ORDER = ["ts", "event_id"]


def _events(spark, sf, cols=("event_id", "ts", "user_id", "event_type", "value", "props")):
    return load(spark, sf, "events", list(cols))


def _day(c="ts"):
    """Scan bucket for event logs: the hour of the event (monotone in (ts, id))."""
    return F.date_trunc("hour", F.col(c))


def state_last_write(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf, ("event_id", "ts", "user_id", "event_type", "value"))
    return TR.last_write(e, ["user_id"], "event_type", "value", ORDER)


def speaker_change(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf, ("event_id", "ts", "user_id", "event_type"))
    d = TR.speaker_changes(e, ["user_id"], ORDER, "event_type", _day())
    return d.select("event_id", "user_id", "prev_speaker", "changed")


def last_output(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf, ("event_id", "ts", "user_id", "event_type", "props"))
    return TR.last_output(e, ["user_id"], ORDER, "event_type", "props", _day())


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    # state writes: a purchase writes the report, a signup writes the review
    name = (F.when(F.col("event_type") == "purchase", F.lit("report_content"))
             .when(F.col("event_type") == "signup", F.lit("review")))
    writes = e.select("user_id", "ts", "event_id", name.alias("name"),
                      F.format_string("%.2f", F.col("value")).alias("v"))
    state = TR.state_with_defaults(writes, ["user_id"], "name", "v", ORDER)
    out = TR.last_output(e.select("event_id", "ts", "user_id", "event_type", "props"),
                         ["user_id"], ORDER, "event_type", "props", _day())
    return state.join(out, "user_id", "full").select(
        "user_id", F.coalesce("last_output", F.lit("")).alias("response"),
        F.col("report_content").alias("report"), "review")


def call_budget(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf, ("event_id", "ts", "user_id", "event_type"))
    d = TR.call_budget(e, ["user_id"], ORDER, F.col("event_type") != "error", _day())
    return d.select("event_id", "user_id", "n_prior_ok", "rejected")


def next_sibling(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations", ["conv_id", "turn", "role"])
    d = scan.next_matching(c, ["conv_id"], ["turn"], F.col("role") == "assistant", "turn",
                           F.floor(F.col("turn") / 64))
    # -1: no later assistant turn (keeps the integer column free of nulls)
    return d.where(F.col("role") == "user").select(
        "conv_id", "turn", F.coalesce("next", F.lit(-1).cast("long")).alias("next_turn"))


def section_cross(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations", ["conv_id", "turn", "role"])
    sections = c.where(F.col("turn") < 2).select(
        "conv_id", F.col("turn").alias("s_turn"),
        F.concat_ws(":", "role", F.col("turn").cast("string")).alias("section"))
    entries = c.select("conv_id", "turn")
    return I.section_first(entries, sections, ["conv_id"], "s_turn", ["section"])


QUERIES = {
    "state_last_write": state_last_write,
    "speaker_change": speaker_change,
    "last_output": last_output,
    "run_summary": run_summary,
    "call_budget": call_budget,
    "next_sibling": next_sibling,
    "section_cross": section_cross,
}
