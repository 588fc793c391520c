"""The parse pass (pure Python, no Spark)."""

from gleaner.functions import extract as X
from gleaner.functions.html import class_matches, parse


def test_nesting_unclosed_and_void():
    root = parse("<p><b>one<br><p>two</p><p>three</p></article>x")
    ps = root.find_all("p")
    assert [p.text(strip=True) for p in ps] == ["onetwothreex", "two", "three"]
    assert root.find("br").children == []


def test_script_style_comment_are_not_text():
    root = parse('<div>a<script>var t="</p>";</script><!-- c --><style>p{}</style>b</div>')
    assert root.find("div").text(" ", strip=True) == "a b"


def test_unmatched_end_tag_ignored():
    root = parse("<div>a</span>b</div>")
    assert root.find("div").text() == "ab"


def test_class_modes():
    # two-token class string matches the exact attribute, single token matches a class
    assert class_matches(["glue-card", "card"], "glue-card card", "glue-card card", "one")
    assert class_matches(["glue-card", "card"], "glue-card card", "card", "one")
    assert not class_matches([], None, "card", "one")
    # list: hit on the second class only
    assert class_matches(["b"], "b", ["a", "b"], "any")
    # all tokens must be classes; "flex-col" alone is not enough
    assert not class_matches(["flex-col"], "flex-col", ["flex", "flex-col"], "all")
    assert class_matches(["x", "flex", "flex-col"], "x flex flex-col", ["flex", "flex-col"], "all")


def test_body_text_nbsp_newline_missing():
    html = "<div class='c'><p>a b</p>\n<p>c\nd</p></div>"
    assert X.body_text(html, "div", "c") == "a b c d"
    assert X.body_text(html, "section", None) is None


def test_listing_cap_before_link_filter():
    items = "".join("<li><span>no link</span></li>" for _ in range(10))
    items += "".join(f'<li><a href="/k{i}">k{i}</a></li>' for i in range(15))
    p = {"cand_tag": "li", "wrapped": True, "link_tag": "a", "title_tag": "a", "cap": 20}
    rows = X.listing_candidates(f"<ul>{items}</ul>", p)
    assert len(rows) == 20
    assert sum(1 for r in rows if r[1] is not None) == 10


def test_link_list_order_first_class_wins():
    html = '<div class="w"><a class="b" href="/b">B</a><a class="a" href="/a">A</a></div>'
    p = {"cand_tag": "div", "cand_classes": ["w"], "cand_mode": "one", "wrapped": True,
         "link_tag": "a", "link_classes": ["a", "b"], "title_tag": "a", "title_classes": ["a", "b"]}
    (pos, href, title, _, _), = X.listing_candidates(html, p)
    assert (href, title) == ("/a", "A")


def test_date_index_and_attr():
    base = {"cand_tag": "div", "cand_classes": ["c"], "cand_mode": "one", "title_tag": "h3"}
    one = '<div class="c"><h3>t</h3><span>Jan 1, 2025</span></div>'
    two = '<div class="c"><h3>t</h3><span>x</span><span>Jan 2, 2025</span></div>'
    p = dict(base, date_tag="span", date_index=1)
    assert X.listing_candidates(one, p)[0][3:] == (None, None)
    assert X.listing_candidates(two, p)[0][3:] == ("Jan 2, 2025", "text")
    t = '<div class="c"><time datetime="2025-03-04T10:00:00Z">x</time></div>'
    pa = dict(base, date_tag="time", date_attr="datetime")
    assert X.listing_candidates(t, pa)[0][3:] == ("2025-03-04T10:00:00Z", "attr")
    # attribute missing -> no date
    assert X.listing_candidates('<div class="c"><time>x</time></div>', pa)[0][3:] == (None, None)
    # with a class, the text is used even at index 0
    pc = dict(base, date_tag="time", date_class="d", date_attr="datetime")
    tc = '<div class="c"><time class="d" datetime="2025-01-01">Jan 5, 2025</time></div>'
    assert X.listing_candidates(tc, pc)[0][3:] == ("Jan 5, 2025", "text")


def test_missing_container_gives_no_rows():
    p = {"container_tag": "div", "container_class": "missing", "cand_tag": "a"}
    assert X.listing_candidates('<a href="/x">x</a>', p) == []


PAPER = """<html><body>
<dl id="articles"><h3>Mon, 3 Feb 2025 (showing 3 of 3 entries)</h3>
<dt><a title="Abstract" href="/abs/1">a</a><a title="Download PDF" href="/pdf/1">p</a></dt>
<dd><div class="list-title"><span>Title:</span> First</div><div class="list-authors"><a>A</a>, <a>B</a></div></dd>
<dt><a title="Abstract" href="/abs/2">a</a></dt>
<dt><a title="Abstract" href="/abs/3">a</a><a title="Download PDF" href="https://x/pdf/3">p</a></dt>
<dd><div class="list-title"><span>Title:</span> Shared</div><div class="list-authors"><a>C</a></div></dd>
</dl>
<dl id="articles"><h3>Tue, 4 Feb 2025</h3>
<dt><a title="Download PDF" href="/pdf/4">p</a></dt>
<dt><a title="Abstract" href="/abs/5">a</a></dt>
</dl></body></html>"""


def test_paper_nodes():
    nodes = X.paper_nodes(X.parse(PAPER))
    assert [n[0] for n in nodes] == ["section", "entry", "detail", "entry", "entry", "detail", "section", "entry", "entry"]
    assert [n[3] for n in nodes] == [0] * 6 + [1] * 3
    assert nodes[0][6] == "Mon, 3 Feb 2025 (showing 3 of 3 entries)"
    assert nodes[1][4:6] == ("/abs/1", "/pdf/1") and nodes[7][4:6] == (None, "/pdf/4")
    assert nodes[2][6:] == ("Title:First", ["A", "B"])
    assert [n[1] for n in nodes] == sorted(n[1] for n in nodes)          # document order
    assert len({n[2] for n in nodes[1:6]}) == 1                          # siblings
    # an entry outside any section, a detail without parts
    loose = X.paper_nodes(X.parse("<dt><a title='Abstract' href='/x'>x</a></dt><dd>text</dd>"))
    assert [(n[0], n[3], n[6], n[7]) for n in loose] == [("entry", None, None, None), ("detail", None, None, [])]
