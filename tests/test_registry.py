"""Registry upsert semantics, the append-only store, and one end-to-end ingest run."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import crawl
from gleaner.operators import ingest as I
from gleaner.session import shared_path
from gleaner.sources.commits import RunTaken
from gleaner.sources.registry import RegistryStore, read_registry_csv, write_registry_csv

ORDER = ["pos"]
BATCH_SCHEMA = "url string, title string, source string, publish_date string, text string, pos int"


def _batch(spark, rows):
    return spark.createDataFrame(rows, BATCH_SCHEMA)


def test_upsert_cases(spark):
    b = _batch(spark, [("u1", "a", "s", None, "body", 0), ("u1", "dup", "s", None, "x", 1),
                       (None, "n", "s", None, "x", 2), ("", "e", "s", None, "x", 3),
                       ("u2", "b", "s", None, "", 4)])
    rows = I.new_registry_rows(b, None, ORDER).orderBy("url").collect()
    assert [(r.url, r.title, r.has_text) for r in rows] == [("u1", "a", True), ("u2", "b", False)]


def test_store_runs_flags_and_replay(spark):
    store = RegistryStore(spark, shared_path(spark, "test-registry", unique=True))
    assert store.read().count() == 0
    b = _batch(spark, [("u1", "a", "s", None, "t", 0), ("u2", "b", "s", None, "t", 1)])
    run = store.next_batch_id()
    store.commit(I.new_registry_rows(b, store.known_urls(run), ORDER), run)
    assert sorted((r.url, r.is_new) for r in store.read().collect()) == [("u1", True), ("u2", True)]
    # same batch again: nothing inserted, every flag cleared
    run = store.next_batch_id()
    new = I.new_registry_rows(b, store.known_urls(run), ORDER)
    assert new.count() == 0
    store.commit(new, run)
    assert sorted((r.url, r.is_new) for r in store.read().collect()) == [("u1", False), ("u2", False)]
    # a run that is committed stays as it is
    b3 = _batch(spark, [("u3", "c", "s", None, "t", 0)])
    run = store.next_batch_id()
    store.commit(I.new_registry_rows(b3, store.known_urls(run), ORDER), run)
    with pytest.raises(RunTaken):
        store.commit(I.new_registry_rows(b3, store.known_urls(run), ORDER), run)
    got = sorted((r.url, r.is_new) for r in store.read().collect())
    assert got == [("u1", False), ("u2", False), ("u3", True)]


def test_a_failed_attempt_is_never_read(spark):
    store = RegistryStore(spark, shared_path(spark, "test-registry", unique=True))
    b = _batch(spark, [("u1", "a", "s", None, "t", 0)])
    store.commit(I.new_registry_rows(b, None, ORDER), 0)
    # run 1 writes its rows and dies before its marker; the retry has nothing new
    ghost = _batch(spark, [("ghost", "g", "s", None, "t", 0)])
    store.write_attempt(I.new_registry_rows(ghost, None, ORDER))
    assert [r.url for r in store.read().collect()] == ["u1"]
    store.commit(I.new_registry_rows(b, store.known_urls(1), ORDER), 1)
    assert [(r.url, r.is_new) for r in store.read().collect()] == [("u1", False)]
    assert [r.url for r in store.known_urls(2).collect()] == ["u1"]


def test_two_writers_take_runs_of_their_own(spark):
    """Both ask for the next run before either commits: neither loses a row, and a
    URL that both found is registered once."""
    root = shared_path(spark, "test-registry", unique=True)
    one, two = RegistryStore(spark, root), RegistryStore(spark, root)
    mine = _batch(spark, [("u1", "a", "s", None, "t", 0), ("both", "a", "s", None, "t", 1)])
    other = _batch(spark, [("u2", "b", "s", None, "t", 0), ("both", "b", "s", None, "t", 1)])
    built = []

    def build(run):
        built.append(run)
        rows = I.new_registry_rows(mine, one.known_urls(run), ORDER)
        if len(built) == 1:                     # the other writer commits between our read and our commit
            two.append(lambda r: {"data": I.new_registry_rows(other, two.known_urls(r), ORDER)})
        return {"data": rows}

    assert one.append(build) == 1 and built == [0, 1]
    assert sorted((r.url, r.title, r.batch_id) for r in one.read().collect()) == [("both", "b", 0), ("u1", "a", 1), ("u2", "b", 0)]


def test_registry_and_documents_appear_together(spark):
    store = RegistryStore(spark, shared_path(spark, "test-registry", unique=True))
    rows = I.new_registry_rows(_batch(spark, [("u1", "a", "s", None, "t", 0)]), None, ORDER)
    docs = spark.createDataFrame([("docs/a", "u1", "json", "{}")], "path string, url string, kind string, body string")
    broken = docs.withColumn("body", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.append(lambda run: {"data": rows, "documents": broken})      # fails between the two writes
    assert store.read().count() == 0 and store.documents().count() == 0 and store.current_batch() is None
    assert store.append(lambda run: {"data": rows, "documents": docs}) == 0
    assert [r.url for r in store.read().collect()] == [r.url for r in store.documents().collect()] == ["u1"]


def test_only_the_buckets_of_the_batch_are_read(spark):
    store = RegistryStore(spark, shared_path(spark, "test-registry", unique=True), n_buckets=32)
    old = _batch(spark, [(f"u{i}", "t", "s", None, "x", i) for i in range(300)])
    store.append(lambda run: {"data": I.new_registry_rows(old, None, ORDER)})
    new = _batch(spark, [("u7", "t", "s", None, "x", 0), ("fresh", "t", "s", None, "x", 1)])
    rows, known = store.new_among(new, 1)
    buckets = {r[0] for r in new.select(store.bucket()).collect()}
    assert len(buckets) <= 2
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:300]
    assert {r.url for r in known.collect()} >= {"u7"} and known.count() < 60
    assert [r.url for r in I.new_registry_rows(rows, known, ORDER).collect()] == ["fresh"]


def test_a_registry_without_rows(spark):
    store = RegistryStore(spark, shared_path(spark, "test-registry", unique=True))
    b = _batch(spark, [])
    for run in range(2):
        store.commit(I.new_registry_rows(b, store.known_urls(run), ORDER), run)
    assert store.read().count() == 0 and store.next_batch_id() == 2


def test_registry_csv_roundtrip(spark):
    store = RegistryStore(spark, shared_path(spark, "test-registry", unique=True))
    b = _batch(spark, [("u1", "a", "s", None, "t", 0)])
    store.commit(I.new_registry_rows(b, None, ORDER), 0)
    path = shared_path(spark, "test-csv", unique=True)
    write_registry_csv(store.read(), path)
    (r,) = read_registry_csv(spark, path).collect()
    assert (r.url, r.has_text, r.is_new, r.publish_date) == ("u1", True, True, None)


def test_anti_and_semi_partition_the_input(spark):
    df = spark.range(100).select((F.col("id") % 17).cast("string").alias("url"), "id")
    known = spark.range(0, 17, 3).select(F.col("id").cast("string").alias("url"))
    a, s = I.anti_known(df, known), I.semi_known(df, known)
    assert a.count() + s.count() == 100
    assert a.join(s, "id").count() == 0


def test_keep_first_independent_of_partitions(spark):
    rows = [(f"u{i % 7}", i, f"t{i}") for i in range(200)]
    base = spark.createDataFrame(rows, "url string, pos int, title string")
    want = sorted(tuple(r) for r in I.dedup_first(base, ["pos"]).collect())
    for n in (1, 4, 13):
        got = sorted(tuple(r) for r in I.dedup_first(base.repartition(n), ["pos"]).collect())
        assert got == want
    assert [r[2] for r in want] == [f"t{i}" for i in range(7)]


LISTING = """<html><body>
<div class="_amc_"><a class="_amcw _amd2" href="https://ai.meta.com/blog/head/">Head</a>
  <div class="_amun">March 3, 2025</div></div>
<div class="_amd6">
 <div class="_amdc"><a class="_amcw _amdf" href="/blog/one/">One</a><div class="_amdj">x</div><div class="_amdj">January 5, 2025</div></div>
 <div class="_amdc"><a class="_amcw _amdf" href="/blog/two/">Two</a></div>
 <div class="_amdc"><span>no link</span></div>
</div></body></html>"""

BODY = '<html><body><div class="_7h8s"><p>Body&nbsp;text</p>\n<p>more</p></div></body></html>'


def test_ingest_run_end_to_end(spark):
    pages = spark.createDataFrame([(0, "https://ai.meta.com/blog/", LISTING),
                                   (1, "https://unknown.example/", "<a href='/x'>x</a>")],
                                  "site_pos int, url string, html string")
    known = spark.createDataFrame([("https://ai.meta.com/blog/two/",)], "url string")
    art = spark.createDataFrame([("https://ai.meta.com/blog/one/", BODY)], "url string, html string")
    rows = crawl.ingest_run(pages, known, art, as_of="2025-01-31").orderBy("pos").collect()
    got = [(r.url, r.title, r.publish_date, r.has_text) for r in rows]
    assert got == [("https://ai.meta.com/blog/head/", "Head", "2025-03-03", False),
                   ("https://ai.meta.com/blog/one/", "One", "2025-01-05", True)]
    assert rows[1].article_file_path == "docs/one_meta_ai_2025_01_05.txt"


def test_plan_body_stage_after_anti_join(spark):
    pages = spark.createDataFrame([(0, "https://ai.meta.com/blog/", LISTING)], "site_pos int, url string, html string")
    known = spark.createDataFrame([("https://ai.meta.com/blog/two/",)], "url string")
    art = spark.createDataFrame([("https://ai.meta.com/blog/one/", BODY)], "url string, html string")
    plan = crawl.ingest_run(pages, known, art, as_of="2025-01-31")._jdf.queryExecution().executedPlan().toString()
    # the body stage (ArrowEvalPython over the article pages) reads only URLs that
    # survived keep-first and the registry anti-join
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_anti_join_has_no_forced_broadcast(spark):
    df = spark.range(1000).select((F.col("id") % 300).cast("string").alias("url"), "id")
    known = spark.range(0, 300, 7).select(F.col("id").cast("string").alias("url"))
    got = I.anti_known(df, known)
    assert "strategy=broadcast" not in got._jdf.queryExecution().logical().toString()
    assert sorted(r.id for r in got.collect()) == [i for i in range(1000) if i % 300 % 7]


def test_cap_then_link_filter_then_known(spark):
    """25 candidates: the first 10 have no link, cap 20 keeps 10 linked ones,
    5 of which are known -> 5 new rows."""
    from gleaner.operators import extract as E

    items = "".join("<li><span>none</span></li>" for _ in range(10))
    items += "".join(f'<li><a href="/a{i}">a{i}</a></li>' for i in range(15))
    pages = spark.createDataFrame([(0, "https://s.example/list", f"<ul>{items}</ul>")],
                                  "page_id long, url string, html string")
    prof = E.Profile(source="s", base_url="https://s.example", cand_tag="li", wrapped=True,
                     link_tag="a", title_tag="a", date_tag=None, cap=20)
    cands = E.extract_listing(E.with_profile(pages, prof), keep=("page_id", "pf_base_url", "pf_source"))
    arts = I.listing_articles(cands, "2025-01-31")
    known = spark.createDataFrame([(f"https://s.example/a{i}",) for i in range(5)], "url string")
    new = I.anti_known(I.dedup_first(arts.select("url", "pos"), ["pos"]), known)
    assert sorted(r.url for r in new.collect()) == [f"https://s.example/a{i}" for i in range(5, 10)]


def test_listing_warnings(spark):
    pages = spark.createDataFrame([
        (0, "https://ai.meta.com/blog/", LISTING),
        (1, "https://mistral.ai/news", "<div>no news section here</div>"),
        (2, "https://unknown.example/", "<a href='/x'>x</a>"),
        (3, "https://techcrunch.com/ai/", "<div>no cards</div>")], "site_pos int, url string, html string")
    got = sorted((r.site_pos, r.source, r.n_candidates, r.status) for r in crawl.listing_warnings(pages).collect())
    assert got == [(0, "meta_ai", 3, "ok"), (1, "mistral", 0, "no_container"),
                   (2, None, 0, "no_profile"), (3, "techcrunch", 0, "no_candidates")]


def test_ingest_run_metrics(spark):
    pages = spark.createDataFrame([(0, "https://ai.meta.com/blog/", LISTING)], "site_pos int, url string, html string")
    known = spark.createDataFrame([("https://ai.meta.com/blog/two/",)], "url string")
    art = spark.createDataFrame([("https://ai.meta.com/blog/one/", BODY)], "url string, html string")
    m = {}
    rows = crawl.ingest_run(pages, known, art, as_of="2025-01-31", metrics=m)
    rows.write.format("noop").mode("overwrite").save()
    assert m["found"].get == {"n_found": 3}               # header + two linked list items
    assert m["new"].get == {"n_new": 2, "n_with_text": 1}


def test_path_collisions(spark):
    b = _batch(spark, [("u1", "Same", "s", "2025-01-01", "t", 0), ("u2", "Same", "s", "2025-01-01", "t", 1),
                       ("u3", "Other", "s", "2025-01-01", "t", 2)])
    rows = I.new_registry_rows(b, None, ORDER)
    assert rows.count() == 3                                  # every article kept
    (c,) = I.path_collisions(rows, ORDER).collect()
    assert (c.article_file_path, c.n_articles, c.stored_url) == ("docs/same_s_2025_01_01.txt", 2, "u2")


def test_a_worker_holds_a_step_of_pages(spark, monkeypatch):
    """One Arrow batch of 40 MB of pages: a worker has few of them as Python objects."""
    import tracemalloc

    import pyarrow as pa

    from gleaner.operators import extract as E

    page = "<ul>" + "".join(f'<li><a href="/a{i}">a{i}</a></li>' for i in range(3)) + "</ul>" + "x" * 100_000
    pages = spark.createDataFrame([(7, "https://s.example/list", page)], "page_id long, url string, html string")
    prof = E.Profile(source="s", base_url="https://s.example", cand_tag="li", wrapped=True, title_tag="a", date_tag=None)
    src = E.with_profile(pages, prof)
    batch = pa.concat_tables([src.toArrow()] * 400).combine_chunks().to_batches()[0]
    with monkeypatch.context() as m:
        m.setattr(type(src), "mapInArrow", lambda self, fn, schema: fn)
        run = E.extract_listing(src, keep=("page_id", "url"))
    tracemalloc.start()
    rows = ids = 0
    for out in run(iter([batch])):
        rows += out.num_rows
        ids += sum(out.column(0).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows, ids) == (1200, 7 * 1200)
    assert peak < 15e6                                        # a step is 1 MB of pages, and its trees


def test_parse_pages_in_steps(spark):
    from gleaner.operators import extract as E

    pages = spark.createDataFrame([(i, "https://s.example/list", f'<li><a href="/a{i}">a</a></li>' + "x" * 300_000) for i in range(8)]
                                  + [(8, "https://s.example/list", None)], "page_id long, url string, html string")
    prof = E.Profile(source="s", base_url="https://s.example", cand_tag="li", wrapped=True, title_tag="a", date_tag=None)
    got = E.parse_pages(E.with_profile(pages.coalesce(1), prof), keep=("page_id",)).collect()
    assert sorted(r.page_id for r in got if r.kind == "status") == list(range(9))
    assert {(r.page_id, r.href) for r in got if r.kind == "listing"} == {(i, f"/a{i}") for i in range(8)}
