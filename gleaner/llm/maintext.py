"""Operator 1: main text of a page by its maximum-scoring subsequence of tokens.

A page is a sequence of words and tags.  Words score mostly positive and tags
negative, with weights that are log-odds learnt from labelled pages; one linear
scan finds the contiguous region with the highest sum.  Elements that are no
article text (scripts, forms, navigation, adverts, notices, reader comments, ...)
are left out of the sequence, so they neither count for a region nor cut it.
Inside the region references are decoded, white space in a block becomes one
space, and blocks are joined by one line feed.

An element is left out for its tag (``ASIDE``), for a word of its class, id or role
that says so (``HINTS``, or a word whose learnt log-odds are under ``OUTSIDE``), or if it is
hidden; but never the page's root, its first article or main element, a heading, what
holds that first article (or the first h1), or a wrapper with ``MOST`` of the words.

Labels: a page whose markup says where its article is (``LABEL_TAGS``) is a
labelled page; its tokens inside that element are content.  About
``LABELLED_PAGES`` of them (a share by hash of the id; a documented parameter)
are learnt from.  A page without such markup is cut by the same weights.

Defined cases: a null or empty html has the empty text; unclosed and stray tags,
cut-off markup and references are read leniently; very long pages are one linear
scan; repeated rows give repeated rows; an empty table gives an empty result;
without labelled pages prior weights serve; extra columns are ignored.  A stray or
unclosed quote in a tag is no string: the next ">" ends the tag.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import map_batches

LABELLED_PAGES = 2_000
LABEL_TAGS = ("article", "main")
#: Elements whose content is never text.
RAW = ("script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "title")
#: Elements that are no part of an article's text wherever they stand.
ASIDE = ("nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "head", "label", "fieldset")
#: Words of a class, id or role that mark such a part.
HINTS = ("ad", "ads", "advert", "advertisement", "banner", "sidebar", "nav", "navbar", "menu", "footer", "comment",
         "comments", "disqus", "cookie", "consent", "notice", "promo", "sponsor", "sponsored", "share", "social",
         "related", "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "popup", "modal", "widget", "toolbar",
         "navigation", "contentinfo", "complementary", "search", "respond", "reply", "replies", "login", "masthead")
#: Of these, what may hold most of a page's words and still be none of its text.
TALK = ("comment", "comments", "disqus", "respond", "reply", "replies")
#: A class word is a mark below these log-odds, seen outside at least so often; a wrapper
#: with this share of a page's words is none.
OUTSIDE, SEEN, MOST = -3.0, 200, 0.8
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A paragraph ends where one of these starts.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                   "pre section table ul".split())

#: Attributes as HTML cuts them: a quote opens a string only right after the "=" of a
#: name; any other quote, and one that is never closed, is an ordinary character.
_ATTRS = (r"(?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
          r"(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\r\f>]++)?)?)*+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HINT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


def tokens(page: str):
    """("text", raw text), ("open", name, class words, hidden) and ("close", name) of a
    page; comments, declarations and the content of raw elements are left out."""
    at, low = 0, None
    for_raw = None
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            yield "text", page[at:m.start()], (), False
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            yield "close", name, (), False
            continue
        words = [w.lower() for x in _ATTR.findall(m[3]) for w in _HINT.split(x[1] or x[2] or x[3]) if w] if m[3] else ()
        yield "open", name, words, "hidden" in (m[3] or "").lower().split()
        if name in RAW and not m[0].endswith("/>"):
            if low is None:
                low = page.lower()
            for_raw = low.find(f"</{name}", at)
            at = len(page) if for_raw < 0 else for_raw
    if at < len(page):
        yield "text", page[at:], (), False


class Tree:
    """The elements of a page in the order they open: name, parent, class words,
    hidden, words below, and whether the first article (or first h1) is below."""

    def __init__(self):
        self.name, self.parent, self.classes, self.hidden, self.words, self.holds = [""], [0], [()], [False], [0], [False]

    def open(self, name: str, parent: int, classes, hidden: bool) -> int:
        for column, value in zip((self.name, self.parent, self.classes, self.hidden, self.words, self.holds),
                                 (name, parent, classes, hidden, 0, False)):
            column.append(value)
        return len(self.name) - 1

    def depths(self, odds: dict[str, float]) -> list[int]:
        """For every element the number of marked ones that it is in, itself included."""
        first = next((i for i, n in enumerate(self.name) if n in LABEL_TAGS), None)
        if first is None:
            first = next((i for i, n in enumerate(self.name) if n == "h1"), 0)
        for i in range(len(self.name) - 1, 0, -1):
            self.words[self.parent[i]] += self.words[i]
            self.holds[i] |= i == first
            self.holds[self.parent[i]] |= self.holds[i]
        out = [0] * len(self.name)
        for i in range(1, len(self.name)):
            out[i] = out[self.parent[i]] + self.marked(i, odds)
        return out

    def marked(self, i: int, odds: dict[str, float]) -> bool:
        name, words = self.name[i], self.classes[i]
        if name in ("html", "body"):
            return False
        if name in ASIDE and name not in ("form", "fieldset"):
            return True
        if self.holds[i]:
            return False
        heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        said = not heading and any(w in HINTS or odds.get("c:" + w, 0.0) < OUTSIDE for w in words)
        if not (name in ASIDE or said or self.hidden[i]):
            return False
        return self.words[i] < MOST * self.words[0] or any(w in TALK for w in words)


def scan(page: str, odds: dict[str, float] | None = None) -> tuple[list[tuple], Tree]:
    """Tokens with their context: (kind, text or name, feature, words, depth, element), where
    depth counts the marked elements around, and the page's elements.

    The feature of words is the block they stand in; of a tag, its name."""
    out, stack, tree = [], [], Tree()              # stack of (name, element)
    block = ["html"]

    def pop_to(k: int) -> None:
        while len(stack) > k:
            name, _ = stack.pop()
            if name not in INLINE:
                block.pop()

    def inner() -> int:
        return stack[-1][1] if stack else 0

    for kind, x, classes, hidden in tokens(page):
        if kind == "text":
            n = len(x.split())
            tree.words[inner()] += n
            link = any(s[0] == "a" for s in stack[-3:])
            out.append(("text", x, "w:" + block[-1] + ("/a" if link else ""), n, inner()))
            continue
        if kind == "open":
            if x in ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if x in ("li", "dt", "dd", "tr", "td", "th", "option"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == x:
                        pop_to(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            element = tree.open(x, inner(), classes, hidden)
            out.append(("open", x, "<" + x, 0, element))
            if x not in VOID:
                stack.append((x, element))
                if x not in INLINE:
                    block.append(x)
        else:
            element = inner()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == x:
                    element = stack[k][1]
                    pop_to(k)
                    break
            out.append(("close", x, "</" + x, 0, element))
    depth = tree.depths(odds or {})
    return [(*t[:4], depth[t[4]], t[4]) for t in out], tree


# --- weights --------------------------------------------------------------------

def label(tokens_: list[tuple]) -> tuple[int, int] | None:
    """Token range inside the first labelling element, if the page has one."""
    for tag in LABEL_TAGS:
        start = next((i for i, t in enumerate(tokens_) if t[0] == "open" and t[1] == tag), None)
        if start is not None:
            depth, end = 0, len(tokens_)
            for i in range(start, len(tokens_)):
                if tokens_[i][1] == tag and tokens_[i][0] in ("open", "close"):
                    depth += 1 if tokens_[i][0] == "open" else -1
                    if depth == 0:
                        end = i
                        break
            return start + 1, end
    return None


def count_features(pages: list) -> list[tuple[str, int, int]]:
    """(feature, inside, outside) counts of labelled pages over what isn't marked; words
    count as words.  A class word counts the words below the elements that have it."""
    inside, outside = Counter(), Counter()
    for page in pages:
        toks, tree = scan(page or "")
        span = label(toks)
        if span is None:
            continue
        for i, (kind, _, feature, n, depth, element) in enumerate(toks):
            to = inside if span[0] <= i < span[1] else outside
            if kind == "open" and not tree.holds[element]:
                for w in set(tree.classes[element]):
                    to["c:" + w] += tree.words[element]
            if not depth:
                to[feature] += n if kind == "text" else 1
    return [(f, inside[f], outside[f]) for f in sorted(inside.keys() | outside.keys())]


def weights_of(counts: list[tuple[str, int, int]]) -> dict[str, float]:
    """Log-odds of each feature: words within +-1, tags from -5.1 to -0.1, so that an
    advert inside a long article doesn't cut it in two; class words as they are,
    if seen often enough."""
    out = {}
    for f, a, b in counts:
        odds = math.log((a + 0.5) / (b + 0.5))
        if f.startswith("c:"):
            if b >= SEEN:
                out[f] = odds
        elif f.startswith("w:"):
            out[f] = max(-1.0, min(1.0, odds / 2))
        else:
            out[f] = max(-5.0, min(0.0, odds)) - 0.1
    return out


def prior(feature: str) -> float:
    """Weight of a feature that no labelled page has."""
    if feature.startswith("w:"):
        return -1.0 if feature.endswith("/a") else \
            0.5 if feature in ("w:html", "w:body", "w:div", "w:section", "w:td") else 1.0
    if feature.lstrip("</") in ASIDE + ("body", "html", "article", "main", "header"):
        return -3.0
    return -0.5


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the maximum-scoring contiguous subsequence, by one scan;
    the first, and the longest of equals that start together."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    toks, _ = scan(page or "", weights)
    toks = [t for t in toks if not t[4]]
    scores = []
    for kind, _, feature, n, _, _ in toks:
        w = weights.get(feature)
        if w is None:
            w = prior(feature)
        scores.append(w * n if kind == "text" else w)
    start, end = best_region(scores)
    blocks, now = [], []

    def flush():
        if now:
            text = _SPACE.sub(" ", html.unescape("".join(now))).strip(" ")
            now.clear()
            if text:
                blocks.append(text)

    for kind, x, _, _, _, element in toks[start:end]:
        if kind == "text":
            now.append(x)
        elif x not in INLINE:
            flush()
    flush()
    return "\n".join(blocks)


# --- jobs --------------------------------------------------------------------------

def learn(pages: DataFrame, rows: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from about ``rows`` labelled pages; only counts of their features (tags,
    blocks and class words) reach the driver."""
    labelled = pages.where(F.lower("html").rlike("<(" + "|".join(LABEL_TAGS) + r")[\s>]")).select("page_id", "html")
    share = min(1.0, rows / max(labelled.count(), 1))
    picked = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = map_batches(picked.select("html"),
                         lambda c: dict(zip(("f", "a", "b"), map(list, zip(*count_features(c["html"]))))) or {"f": [], "a": [], "b": []},
                         "f string, a long, b long")
    got = counts.groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return weights_of(sorted(tuple(r) for r in got.collect()))


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def fn(cols):
        text = [extract(h, weights) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), fn,
                       "page_id long, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(table_path(sf_dir, "pages"))
    return main_text(pages, learn(pages))
