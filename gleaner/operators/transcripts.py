"""Folding event logs: keyed last-write state, speaker changes, last output,
call budgets, run summaries."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import scan

# The initial shared state of a run (key -> default text).
DEFAULT_STATE = {"report_content": "Not written yet.", "review": "Review required."}
# Fixed value: calls allowed before the budget rejects (successful calls only).
DEFAULT_CALL_BUDGET = 10


def _ord(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def last_write(events: DataFrame, key: Sequence[str], name: str, value: str,
               order: Sequence[str]) -> DataFrame:
    """Last written value per (key, name): ``max_by(value, order)``.

    An ordinary aggregate, so it is pre-aggregated map-side (one row per task
    and key reaches the shuffle however hot the key is)."""
    return events.groupBy(*key, name).agg(F.max_by(F.col(value), _ord(order)).alias("last_value"))


def state_with_defaults(events: DataFrame, key: Sequence[str], name: str, value: str,
                        order: Sequence[str], defaults: Mapping[str, str] = DEFAULT_STATE) -> DataFrame:
    """One row per key with one column per state name: the last write, or the
    default when the name was never written."""
    ordc = _ord(order)
    aggs = [F.coalesce(F.max_by(F.col(value), F.when(F.col(name) == k, ordc)), F.lit(d)).alias(k)
            for k, d in defaults.items()]
    return events.groupBy(*key).agg(*aggs)


def speaker_changes(events: DataFrame, key: Sequence[str], order: Sequence[str], speaker: str,
                    bucket: Column) -> DataFrame:
    """Add ``prev_speaker`` and ``changed`` (current speaker differs from the
    previous one, null-safe; the first event of a key is a change)."""
    d = scan.previous_value(events, key, order, speaker, bucket, out="prev_speaker")
    return d.withColumn("changed", ~F.col(speaker).eqNullSafe(F.col("prev_speaker")))


def last_output(events: DataFrame, key: Sequence[str], order: Sequence[str], speaker: str,
                output: str, bucket: Column) -> DataFrame:
    """Last non-empty output per key, skipping events that announce a new
    speaker (those only switch the speaker)."""
    d = speaker_changes(events, key, order, speaker, bucket)
    keep = (~F.col("changed")) & (F.coalesce(F.col(output), F.lit("")) != "")
    return d.groupBy(*key).agg(F.max_by(F.col(output), F.when(keep, _ord(order))).alias("last_output"))


def call_budget(calls: DataFrame, key: Sequence[str], order: Sequence[str], ok: Column,
                bucket: Column, limit: int = DEFAULT_CALL_BUDGET) -> DataFrame:
    """Add ``n_prior_ok`` (successful earlier calls) and ``rejected``
    (``n_prior_ok >= limit``).  Failed calls are not counted."""
    d = scan.count_before(calls, key, order, ok, bucket, out="n_prior_ok")
    return d.withColumn("rejected", F.col("n_prior_ok") >= F.lit(limit))
