"""Column expressions on hand-made rows (FIXTURES.md §4)."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dates as D
from gleaner.functions import strings as S
from gleaner.operators import browse as B
from gleaner.sources import config as C

AS_OF = "2025-01-31"


def _one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_date_cascade(spark):
    vals = ["January 5, 2025", "Jan 5, 2025", "jan 05, 2025", "1.5.2025", "05/01/2025",
            "February 30, 2025", "May  3, 2025", "Sept 3, 2025", "3 giorni fa",
            "Jan 5, 2025 extra", "", None]
    got = _one_col(spark, vals, lambda c: D.cascade_date(c, AS_OF))
    assert got == ["2025-01-05", "2025-01-05", "2025-01-05", "2025-01-05", "2025-01-05",
                   None, "2025-05-03", None, "2025-01-28", None, None, None]


def test_date_attr(spark):
    got = _one_col(spark, ["2025-03-04T10:00:00Z", "2025-03-04", "Tue 4"], D.attr_date)
    assert got == ["2025-03-04", "2025-03-04", ""]


def test_section_date(spark):
    got = _one_col(spark, ["Mon, 3 Feb 2025 (showing 3)", "Xyz, 3 Feb 2025", "New: Mon, 3 Feb 2025",
                           "Tue, 31 Feb 2025"], D.section_date)
    assert got == ["2025-02-03", None, None, None]


def test_day_part(spark):
    ts = [dt.datetime(2025, 1, 1, h) for h in (4, 5, 11, 12, 17, 18, 0)]
    got = _one_col(spark, ts, D.day_part, "timestamp")
    assert got == ["evening", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]


def test_absolutize(spark):
    hrefs = ["https://a/x", "http://a/x", "/x", "./x", "../x", "x", ""]
    got = _one_col(spark, hrefs, lambda c: S.absolutize(c, F.lit("https://b.com")))
    assert got == ["https://a/x", "https://b.com/http://a/x", "https://b.com/x", "https://b.com/x",
                   "https://b.com./x", "https://b.com/x", "https://b.com/"]
    strict = _one_col(spark, hrefs[:2], lambda c: S.absolutize(c, F.lit("https://b.com"), strict=True))
    assert strict == ["https://a/x", "http://a/x"]


def test_safe_filename(spark):
    cases = {
        'a<b>c:d"e/f\\g|h?i*j': "abcdefghij",     # reserved characters removed
        "Crème brûlée": "Crme_brle",               # non-ASCII dropped, space -> _
        "tab\there": "tab\there",                 # tab is printable, kept
        "CON": "CON_",                             # reserved name without extension
        "con.txt": "con_.txt",                     # reserved stem: _ before the extension
        "...": "unnamed_file",                     # only dots: nothing left
        " . x . ": "_._x_._",                      # spaces became _ before the strip
        "a-b c": "a_b_c",
        "COM1.tar.gz": "COM1.tar.gz",              # stem is COM1.tar, not reserved
        "LPT9.": "LPT9_",                          # _ before the empty extension, then "." stripped
        "x..y": "x..y",
        ".hidden": "hidden",                       # leading dot stripped at the end
    }
    got = dict(zip(cases, _one_col(spark, list(cases), S.safe_filename)))
    assert got == cases


def test_file_name_null_title(spark):
    df = spark.createDataFrame([(None, "src", None)], "t string, s string, d string")
    (r,) = df.select(S.article_file_name("t", "s", "d")).collect()
    assert r[0] == "none_src_none.txt"


def test_camel_and_stem(spark):
    names = ["root_agent", "write_agent", "x", "agent2go_v1", "o'neil_x", "ÉCOLE_été", "", "a__b"]
    assert _one_col(spark, names, S.camel_case) == ["".join(p.title() for p in n.split("_")) for n in names]
    paths = ["/d/Foo.TXT", "/d/a.b.c", "/d/.hidden", "/d/x.", "/d/..a", "https://h/en/474.html",
             "https://h/en/853/", "https://h/en/825?page=2&ref=x"]
    got = _one_col(spark, paths, S.path_stem)
    assert got == [pathlib.PurePosixPath(p).stem.lower() for p in paths]


def test_json_path_get(spark):
    js = ['{"a": {"b": "x"}}', '{"a": {"b": null}}', '{"a": {}}', '{"a": 5}', "not json"]
    got = _one_col(spark, js, lambda c: C.json_path_get(c, "a.b", "dflt"))
    assert got == ["x", None, "dflt", "dflt", "dflt"]


def test_site_list(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"search": {"web": {"sites": ["https://a", "https://b"]}}}')
    rows = C.site_list(C.read_config(spark, str(p))).collect()
    assert [(r.site_pos, r.site_url) for r in rows] == [(0, "https://a"), (1, "https://b")]
    e = tmp_path / "e.json"
    e.write_text('{"search": {"web": {"sites": []}}}')
    with pytest.raises(ValueError):
        C.site_list(C.read_config(spark, str(e)))


def test_classify_commands(spark):
    cmds = ["0", "2", "3", "-1", " 1 ", "/bye", "text", "", "1_0", "99999999999", "9" * 50, "+1"]
    got = _one_col(spark, cmds, lambda c: B.classify_command(c, 3))
    # "1_0": an integer to Python, text to Spark (documented divergence)
    assert got == ["option", "option", "invalid", "invalid", "option", "exit", "query", "query", "query",
                   "invalid", "invalid", "option"]


def test_listing_line(spark):
    df = spark.createDataFrame([(0, "T", "s", None)], "i int, t string, s string, d string")
    (r,) = df.select(S.listing_line(F.col("i"), F.col("t"), F.col("s"), F.col("d"))).collect()
    assert r[0] == "\t0) T - s, None\n"


def test_json_document_arrays(spark):
    df = spark.createDataFrame([(["a", 'b"c'],), (None,), ([],)], "authors array<string>")
    got = [r[0] for r in df.select(S.json_document(["authors"], ["authors"])).collect()]
    assert got == ['{"authors": ["a", "b\\"c"]}', '{"authors": null}', '{"authors": []}']


def test_json_document(spark):
    df = spark.createDataFrame([("t\"x", None, "é")], "title string, publish_date string, source string")
    (r,) = df.select(S.json_document(["title", "publish_date", "source"])).collect()
    assert r[0] == '{"title": "t\\"x", "publish_date": null, "source": "é"}'


def test_agent_config(spark, tmp_path):
    p = tmp_path / "agents.json"
    p.write_text('{"agents": [{"name": "a", "can_handoff_to": ["b", "c"]},'
                 ' {"name": "root", "manager": true, "timeout": 120, "can_handoff_to": ["a"]},'
                 ' {"name": "b", "manager": false}]}')
    agents = C.agent_table(C.read_config(spark, str(p)))
    assert [(r.agent_pos, r.name, r.manager) for r in agents.orderBy("agent_pos").collect()] == \
        [(0, "a", None), (1, "root", True), (2, "b", False)]
    assert [r.name for r in C.manager_agent(agents).collect()] == ["root"]
    assert sorted(tuple(r) for r in C.handoff_edges(agents).collect()) == [("a", "b"), ("a", "c"), ("root", "a")]
    q = tmp_path / "none.json"
    q.write_text('{"agents": [{"name": "a"}]}')
    with pytest.raises(ValueError):
        C.manager_agent(C.agent_table(C.read_config(spark, str(q))))
