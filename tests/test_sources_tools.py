"""Folder scans (suffix filter, stems) and named tools."""

import pandas as pd
from pyspark.sql import functions as F

from gleaner.operators import retrieval as R
from gleaner.sources import documents as DOC


def test_scan_documents_suffix_filter(spark, tmp_path):
    (tmp_path / "Alpha_Report.TXT").write_text("upper suffix is not .txt")
    (tmp_path / "beta.txt").write_text("beta text")
    (tmp_path / "gamma.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "notes.md").write_text("skip")
    rows = DOC.scan_documents(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in rows) == ["beta", "gamma"]
    txt = DOC.read_text_documents(spark, str(tmp_path)).collect()
    assert [(r.name, r.text) for r in txt] == [("beta", "beta text")]


def test_register_tool_callable_from_sql(spark):
    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper()

    cat = R.register_tool(spark, "shout_tool", "Upper-cases text", shout)
    assert [tuple(r) for r in cat.collect()] == [("shout_tool", "Upper-cases text")]
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r[0] for r in df.select(F.expr("shout_tool(t)")).collect()] == ["A", "B"]


def test_paged_concat_order(spark):
    pages = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "z")],
                                  "doc long, page long, text string")
    got = {r.doc: r.body for r in DOC.paged_concat(pages, ["doc"], "page").collect()}
    assert got == {1: "abc", 2: "z"}


def test_document_rows(spark):
    arts = spark.createDataFrame(
        [("T1", None, "https://a/1", "https://a", "src", None, "body one"),
         ("P: 2", "2025-01-02", "https://x/abs/2", "https://x", "arxiv", "https://x/pdf/2", None)],
        "title string, publish_date string, url string, source_url string, source string, "
        "pdf_url string, text string")
    paged = spark.createDataFrame([("https://x/pdf/2", "page1page2")], "pdf_url string, body string")
    rows = {r.url: r for r in DOC.document_rows(arts, paged).collect()}
    a, p = rows["https://a/1"], rows["https://x/abs/2"]
    assert (a.kind, a.path) == ("json", "docs/t1_src_none.txt")
    assert a.body == ('{"title": "T1", "publish_date": null, "url": "https://a/1", '
                      '"source_url": "https://a", "source": "src", "text": "body one"}')
    assert (p.kind, p.path, p.body) == ("pdf", "docs/p_2_arxiv_2025_01_02.txt", "page1page2")
