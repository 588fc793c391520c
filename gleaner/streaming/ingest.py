"""Incremental ingest as a Structured Streaming job.

Crawled pages arrive as files; each micro-batch is one ingest run: extract
links, keep the first per URL, drop URLs registered by earlier runs, append
the new rows as the registry's next run and commit.  The commit marker names the
stream and its micro-batch: a micro-batch that is replayed after its commit finds
its run and does nothing; one that failed before it takes the next run id, and what
it had written stays unseen.  A micro-batch that another writer overtakes is
computed again against what that writer added.  Batch runs and streams, also
restarted with a fresh checkpoint, can share a registry.  Dedup against the registry happens in the batch (a join with the
table), not in streaming state, so state does not grow with the URL count.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.ingest import new_registry_rows
from gleaner.sources.registry import RegistryStore


def run_stream_ingest(spark: SparkSession, stream: DataFrame, store: RegistryStore,
                      to_articles: Callable[[DataFrame], DataFrame], order: list,
                      checkpoint: str, available_now: bool = True, stream_id: Optional[str] = None):
    """Start (and, with ``available_now``, finish) the ingest stream.

    ``stream_id`` names the stream in the registry's log; by default a name kept
    with the checkpoint's query id, so that a fresh checkpoint is another stream."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        articles = to_articles(batch)

        def build(run: int) -> dict:
            # only the registry's buckets that the batch falls into are read
            rows, known = store.new_among(articles, run)
            return {"data": new_registry_rows(rows, known, order)}

        name = stream_id or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if store.run_of(name, batch_id) is None:
            store.append(build, name, batch_id)

    w = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
