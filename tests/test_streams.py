"""Structured Streaming: ingest runs per micro-batch, restart safety, keyed state."""

from pyspark.sql import functions as F

from gleaner.plans.papers_streams import _nav_articles
from gleaner.session import shared_path
from gleaner.sources.registry import RegistryStore
from gleaner.streaming.ingest import run_stream_ingest
from gleaner.streaming.state import read_state, start_state_stream

from conftest import SF_SMALL


def test_stream_ingest_batches_and_restart(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    src = shared_path(spark, "test-stream-src", unique=True)
    # two arrivals: the http pages first, the rest later
    pages.where(F.col("url").startswith("http://")).coalesce(1).write.parquet(f"{src}/a")
    pages.where(~F.col("url").startswith("http://")).coalesce(1).write.parquet(f"{src}/b")
    schema = pages.schema
    store = RegistryStore(spark, shared_path(spark, "test-stream-reg", unique=True))
    ckpt = shared_path(spark, "test-stream-ckpt", unique=True)

    def stream():
        return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                .option("recursiveFileLookup", True).parquet(src))

    run_stream_ingest(spark, stream(), store, _nav_articles, ["page_id", "pos"], ckpt)
    reg = store.read()
    rows = reg.collect()
    assert store.current_batch() == 1
    assert len({r.url for r in rows}) == len(rows)               # no URL twice across runs
    assert {r.is_new for r in rows if r.batch_id == 1} == {True}
    assert {r.is_new for r in rows if r.batch_id == 0} == {False}
    all_links = _nav_articles(pages).select("url").distinct().count()
    assert len(rows) == all_links
    # restart on the same checkpoint: nothing new to read, registry unchanged
    run_stream_ingest(spark, stream(), store, _nav_articles, ["page_id", "pos"], ckpt)
    assert store.current_batch() == 1 and store.read().count() == len(rows)


def test_fresh_checkpoint_on_a_filled_registry(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    src = shared_path(spark, "test-stream-src", unique=True)
    for k in range(3):
        pages.where(F.col("page_id") % 3 == k).coalesce(1).write.parquet(f"{src}/p{k}")
    store = RegistryStore(spark, shared_path(spark, "test-stream-reg", unique=True))
    old = spark.createDataFrame([("u1", "a", "s", None, "t", 0)],
                                "url string, title string, source string, publish_date string, text string, pos int")
    from gleaner.operators.ingest import new_registry_rows
    store.commit(new_registry_rows(old, None, ["pos"]), 0)

    def run(ckpt):
        stream = (spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", True).parquet(src))
        run_stream_ingest(spark, stream, store, _nav_articles, ["page_id", "pos"], ckpt)

    run(shared_path(spark, "test-stream-ckpt", unique=True))
    rows = store.read().collect()
    assert store.current_batch() == 3 and "u1" in {r.url for r in rows}
    assert len(rows) == len({r.url for r in rows}) == _nav_articles(pages).select("url").distinct().count() + 1
    # the same files through another checkpoint: three more runs, no row twice or lost
    run(shared_path(spark, "test-stream-ckpt", unique=True))
    assert store.current_batch() == 6 and store.read().count() == len(rows)


def test_stream_state_equals_batch(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = shared_path(spark, "test-state-src", unique=True)
    # arrivals out of time order: clicks and views first, the rest later
    ev.where(F.col("event_type").isin("click", "view")).coalesce(1).write.parquet(f"{src}/a")
    ev.where(~F.col("event_type").isin("click", "view")).coalesce(1).write.parquet(f"{src}/b")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    log = shared_path(spark, "test-state-log", unique=True)
    start_state_stream(stream, ["user_id", "event_type"], "value", ["ts", "event_id"], log,
                       shared_path(spark, "test-state-ckpt", unique=True))
    got = sorted(tuple(r) for r in read_state(spark, log, ["user_id", "event_type"]).collect())
    want = sorted(tuple(r) for r in ev.groupBy("user_id", "event_type").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("last_value")).collect())
    assert got == want


def test_stream_state_with_retention_equals_batch(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = shared_path(spark, "test-state-src", unique=True)
    ev.where(F.col("event_type").isin("click", "view")).coalesce(1).write.parquet(f"{src}/a")
    ev.where(~F.col("event_type").isin("click", "view")).coalesce(1).write.parquet(f"{src}/b")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    log = shared_path(spark, "test-state-log", unique=True)
    start_state_stream(stream, ["user_id", "event_type"], "value", ["ts", "event_id"], log,
                       shared_path(spark, "test-state-ckpt", unique=True),
                       event_time="ts", watermark="3650 days", state_window="6 hours")
    got = sorted(tuple(r) for r in read_state(spark, log, ["user_id", "event_type"]).collect())
    want = sorted(tuple(r) for r in ev.groupBy("user_id", "event_type").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("last_value")).collect())
    assert got == want


def test_snapshots_bound_what_a_reader_folds(spark):
    from gleaner.streaming import state as S

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = shared_path(spark, "test-state-src", unique=True)
    for k in range(5):
        ev.where(F.col("event_id") % 5 == k).coalesce(1).write.parquet(f"{src}/{k}")
    log = shared_path(spark, "test-state-log", unique=True)
    ckpt = shared_path(spark, "test-state-ckpt", unique=True)
    key = ["user_id", "event_type"]

    def run():
        stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", True).parquet(src))
        start_state_stream(stream, key, "value", ["ts", "event_id"], log, ckpt, compact_every=2)

    run()
    upto, path = S.last_snapshot(spark, log)
    assert upto == 3                                            # batches 0 to 4, snapshots after 1 and 3
    state = read_state(spark, log, key)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert any("batch_id" in x[:200] and "> 3)" in x[:200] for x in plan.split("PartitionFilters")[1:])
    got = sorted(tuple(r) for r in state.collect())
    want = sorted(tuple(r) for r in ev.groupBy(*key).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value")).collect())
    assert got == want
    # a snapshot that exists isn't written again; a half-written one isn't seen
    assert not S.compact(spark, log, key, 3)
    spark.range(1).write.parquet(f"{log}-snapshots/upto-9-lost")
    assert S.last_snapshot(spark, log) == (upto, path)


def test_an_arrival_is_many_files_and_one_micro_batch(spark, monkeypatch):
    from gleaner.plans import papers_streams as P

    sf = shared_path(spark, "test-arrivals", unique=True)
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    pages.repartition(6).write.parquet(f"{sf}/pages.parquet")
    paths = {}

    def kept(session, *parts, unique=False):
        paths[parts[-1]] = shared_path(session, *parts, unique=unique)
        return paths[parts[-1]]

    monkeypatch.setattr(P, "shared_path", kept)
    runs = {r.url: r.run for r in P.stream_ingest(spark, sf).collect()}
    parts = [spark.read.parquet(f"{paths['arrivals']}/{k}") for k in range(P.ARRIVALS)]
    assert all(len(p.inputFiles()) > 1 for p in parts)            # no task has a whole arrival
    assert sum(p.count() for p in parts) == pages.count()
    links = _nav_articles(pages).select("url", (F.col("page_id") % P.ARRIVALS).alias("run"))
    assert runs == {r.url: r.run for r in links.groupBy("url").agg(F.min("run").alias("run")).collect()}
    markers = RegistryStore(spark, paths["stream-registry"]).log.markers().orderBy("batch_id").collect()
    assert [(m.batch_id, m.stream_batch) for m in markers] == [(k, k) for k in range(P.ARRIVALS)]
    assert len({m.stream for m in markers}) == 1
