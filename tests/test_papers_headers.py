"""Paper listings through Spark (own sections vs compat) and header rules."""

from pyspark.sql import functions as F

from gleaner.operators import crawl
from gleaner.operators.papers import paper_articles
from gleaner.operators.profiles import HeaderRule

from test_html import PAPER


def _pages(spark, html):
    return spark.createDataFrame([(0, "https://arxiv.org/list/cs.AI/recent", html)],
                                 "page_id long, url string, html string")


def test_paper_articles_own_sections(spark):
    rows = {r.url: r for r in paper_articles(_pages(spark, PAPER)).collect()}
    a1 = rows["https://arxiv.org/abs/1"]
    assert (a1.title, a1.authors, a1.pdf_url, a1.publish_date) == ("First", ["A", "B"],
                                                                   "https://arxiv.org/pdf/1", "2025-02-03")
    assert rows["https://arxiv.org/abs/2"].title == "Shared"            # shares the next detail
    assert rows["https://arxiv.org/abs/3"].pdf_url == "https://x/pdf/3"  # already absolute
    assert rows["https://arxiv.org/abs/5"].publish_date == "2025-02-04"
    assert rows[None].pdf_url == "https://arxiv.org/pdf/4"              # entry without abstract link


def test_paper_articles_compat_first_section_wins(spark):
    rows = {r.url: r for r in paper_articles(_pages(spark, PAPER), compat=True).collect()}
    assert rows["https://arxiv.org/abs/5"].publish_date == "2025-02-03"
    assert len(rows) == 5


def test_paper_cap_counts_entries_per_section(spark):
    rows = paper_articles(_pages(spark, PAPER), cap=1).collect()
    assert sorted(r.pos for r in rows) == [0, 0]


def test_header_rules(spark):
    html = ('<div class="hc"><a class="t" href="/news/x">Head</a><div class="d">Jan 5, 2025</div></div>'
            '<div class="hd"><a class="t" href="./y">Y</a><div class="d">May  3, 2025</div></div>')
    pages = spark.createDataFrame([(0, "https://site.example/hub", html)], "site_pos int, url string, html string")
    rules = [HeaderRule(source="s1", base_url="https://site.example", container_tag="div",
                        container_class="hc", link_tag="a", link_class="t", href_mode="drop_first_char",
                        date_tag="div", date_class="d", date_format="MMMM d, yyyy"),
             HeaderRule(source="s2", base_url="https://site.example", container_tag="div",
                        container_class="hd", link_tag="a", link_class="t", href_mode="raw",
                        date_tag="div", date_class="d", date_format="MMMM d, yyyy")]
    got = sorted((r.source, r.url, r.title, r.publish_date, r.pos) for r in crawl.header_rows(pages, rules).collect())
    # "Jan" does not parse with the full month name: null, not an error
    assert got == [("s1", "https://site.examplenews/x", "Head", None, -1),
                   ("s2", "./y", "Y", "2025-05-03", -1)]


def test_ingest_run_routes_paper_pages(spark):
    pages = spark.createDataFrame([(0, "https://arxiv.org/list/cs.AI/recent", PAPER),
                                   (1, "https://ai.meta.com/blog/", "<div>nothing</div>")],
                                  "site_pos int, url string, html string")
    rows = {r.url: r for r in crawl.ingest_run(pages, None, as_of="2025-01-31").collect()}
    assert set(rows) == {"https://arxiv.org/abs/1", "https://arxiv.org/abs/2", "https://arxiv.org/abs/3",
                         "https://arxiv.org/abs/5"}                 # the entry without a link is dropped
    r1 = rows["https://arxiv.org/abs/1"]
    assert (r1.source, r1.title, r1.publish_date) == ("arxiv", "First", "2025-02-03")
    assert r1.article_file_path == "docs/first_arxiv_2025_02_03.txt"    # paged document: .txt after cleaning
    assert rows["https://arxiv.org/abs/5"].article_file_path == "docs/none_arxiv_2025_02_04.txt"


def test_pages_are_parsed_once(spark, tmp_path):
    from gleaner.operators import extract as E
    from gleaner.plans.ingest_runs import HEADERS, SITES

    path = str(tmp_path / "pages")
    spark.createDataFrame([(0, "https://a.example.net/x", "<nav><li><a href='/a'>A</a></li></nav>")],
                          "site_pos int, url string, html string").write.parquet(path)
    tagged = crawl.parsed(spark.read.parquet(path), SITES, HEADERS)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("MapInPandas") == 1 and "Exchange" not in plan
    assert sorted((r.kind, r.pos, r.href) for r in tagged.collect()) == [("header", -1, "/a"), ("listing", 0, "/a"), ("status", 1, None)]
    assert E.TAGGED_FIELDS.count(",") == 10


def test_a_header_rule_needs_its_own_profile_first(spark):
    """Two profiles match the address; only the first one's header rule applies."""
    from gleaner.operators.extract import Profile

    html = '<div class="h"><a href="/top">Top</a></div><ul><li><a href="/a">A</a></li></ul>'
    pages = spark.createDataFrame([(0, "https://one.two.example/x", html)], "site_pos int, url string, html string")
    profiles = [Profile(source=s, base_url=b, rank=i, cand_tag="li", wrapped=True, title_tag="a", date_tag=None)
                for i, (s, b) in enumerate([("one", "https://one."), ("two", "two.example")])]
    rules = [HeaderRule(source=s, base_url=b, container_tag="div", container_class="h", link_tag="a", link_class=None)
             for s, b in [("two", "two.example"), ("one", "https://one.")]]
    rows = crawl.ingest_run(pages, None, profiles=profiles, rules=rules, as_of="2025-01-31").collect()
    assert sorted((r.url, r.source) for r in rows) == [("/top", "one"), ("https://one./a", "one")]


def test_one_page_with_most_entries(spark):
    """Pairing and places over buckets of nodes equal the plain order."""
    from gleaner.operators import papers

    old, papers.NODE_BUCKET = papers.NODE_BUCKET, 7
    try:
        rows = [(0, "u", "section", 0, None, 0, None, None, "Mon, 3 Feb 2025", None)]
        for i in range(60):
            rows.append((0, "u", "entry", 1 + 2 * i, 0, 0, f"/abs/{i}", None, None, None))
            if i % 5 == 4:
                rows.append((0, "u", "detail", 2 + 2 * i, 0, 0, None, None, f"Title:t{i}", [f"n{i}"]))
        nodes = spark.createDataFrame(rows, "page_id long, url string, kind string, node int, parent int, section_pos int, "
                                            "href string, pdf_href string, title string, names array<string>")
        got = {r.pos: (r.url, r.title, r.authors) for r in papers.articles_of_nodes(nodes, cap=33).collect()}
    finally:
        papers.NODE_BUCKET = old
    assert got == {i: (f"https://arxiv.org/abs/{i}", f"t{i // 5 * 5 + 4}", [f"n{i // 5 * 5 + 4}"]) for i in range(33)}


def test_documents_of_a_run(spark):
    from gleaner.session import shared_path
    from gleaner.sources.registry import RegistryStore

    listing = '<div class="_amd6"><div class="_amdc"><a class="_amcw _amdf" href="/one/">One</a></div></div>'
    pages = spark.createDataFrame([(0, "https://ai.meta.com/blog/", listing), (1, "https://arxiv.org/list/cs.AI/recent", PAPER)],
                                  "site_pos int, url string, html string")
    art = spark.createDataFrame([("https://ai.meta.com/one/", "<div class='_7h8s'>first fetch</div>", 0),
                                 ("https://ai.meta.com/one/", "<div class='_7h8s'>second fetch</div>", 1)],
                                "url string, html string, page_pos int")
    paged = spark.createDataFrame([("https://arxiv.org/pdf/1", "page one page two")], "pdf_url string, body string")
    store = RegistryStore(spark, shared_path(spark, "test-run", unique=True))
    assert crawl.run_ingest(store, pages, art, paged, as_of="2025-01-31") == 0
    docs = {r.url: r for r in store.documents().collect()}
    one = docs["https://ai.meta.com/one/"]
    assert one.kind == "json" and '"text": "first fetch"' in one.body
    paper = docs["https://arxiv.org/abs/1"]
    assert (paper.kind, paper.body) == ("pdf", "page one page two")
    assert docs["https://arxiv.org/abs/2"].kind == "json" and '"authors": ["C"]' in docs["https://arxiv.org/abs/2"].body
    reg = store.read().collect()
    assert {r.url: r.article_file_path for r in reg} == {u: r.path for u, r in docs.items()}
    assert {r.has_text for r in reg} == {True, False} and all(r.is_new for r in reg)
    # nothing new: a run without rows, flags cleared
    assert crawl.run_ingest(store, pages, art, paged, as_of="2025-02-01") == 1
    assert not any(r.is_new for r in store.read().collect()) and store.documents().count() == len(docs)
