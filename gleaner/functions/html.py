"""The one Python stage of extraction: a small element tree over stdlib ``html.parser``.

Spark has no HTML reader that survives real pages (``xpath`` needs well formed
XML), so each page is parsed once inside ``mapInPandas`` and flattened to rows;
everything after that (caps, URL rules, date parsing, dedup, joins) is done with
built-in column expressions.

Tree rules (the forgiving ones a lenient HTML parser uses):
- void elements (``br``, ``img``, ...) never take children;
- an end tag closes the nearest open element of that name and everything opened
  after it; an end tag with no open element of that name is ignored;
- nothing is closed implicitly (``<p>a<p>b`` nests), unclosed elements end with
  their parent;
- ``script``/``style`` content and comments are kept out of text.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Iterator, Optional

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
NON_TEXT_TAGS = frozenset(("script", "style", "template"))


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Optional["Element"]):
        self.tag = tag
        self.attrs = attrs
        self.children: list = []
        self.parent = parent

    # -- attributes -----------------------------------------------------
    @property
    def classes(self) -> list:
        v = self.attrs.get("class")
        return v.split() if v else []

    def get(self, name: str, default=None):
        return self.attrs.get(name, default)

    # -- traversal ------------------------------------------------------
    def iter_elements(self) -> Iterator["Element"]:
        """Descendant elements in document (pre-)order, self excluded."""
        stack = list(reversed([c for c in self.children if isinstance(c, Element)]))
        while stack:
            el = stack.pop()
            yield el
            stack.extend(reversed([c for c in el.children if isinstance(c, Element)]))

    def find_all(self, tag: Optional[str] = None, cls=None, mode: str = "one",
                 attr: Optional[tuple] = None) -> list:
        return [e for e in self.iter_elements() if matches(e, tag, cls, mode, attr)]

    def find(self, tag: Optional[str] = None, cls=None, mode: str = "one",
             attr: Optional[tuple] = None) -> Optional["Element"]:
        for e in self.iter_elements():
            if matches(e, tag, cls, mode, attr):
                return e
        return None

    def next_sibling_element(self, tag: str) -> Optional["Element"]:
        if self.parent is None:
            return None
        sibs = self.parent.children
        idx = next(i for i, c in enumerate(sibs) if c is self)
        for c in sibs[idx + 1:]:
            if isinstance(c, Element) and c.tag == tag:
                return c
        return None

    def strings(self) -> Iterator[str]:
        """Text nodes below this element, script/style/comment excluded."""
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Element):
                if c.tag not in NON_TEXT_TAGS:
                    stack.extend(reversed(c.children))
            elif isinstance(c, str):
                yield c

    def text(self, sep: str = "", strip: bool = False) -> str:
        parts = self.strings()
        if strip:
            parts = (s.strip() for s in parts)
            parts = (s for s in parts if s)
        return sep.join(parts)


class _Comment(tuple):
    """Marker for comments (kept in the tree, never in text)."""


def class_matches(classes: list, raw: Optional[str], cls, mode: str) -> bool:
    """Class tests of the extraction profiles.

    mode ``one``: ``cls`` is one string; it matches a single class token or the
    whole class attribute (so two-token strings like ``"a b"`` match exactly).
    mode ``any``: ``cls`` is a list; any token of the list is a class.
    mode ``all``: ``cls`` is a list; every token of the list is a class.
    """
    if cls is None:
        return True
    if mode == "one":
        if isinstance(cls, (list, tuple)):
            cls = cls[0] if len(cls) else None
            if cls is None:
                return True
        if not raw:
            return False
        return cls in classes or " ".join(raw.split()) == " ".join(cls.split())
    toks = list(cls)
    if not toks:
        return True
    if mode == "any":
        return any(t in classes for t in toks)
    if mode == "all":
        return all(t in classes for t in toks)
    raise ValueError(f"unknown class mode {mode!r}")


def matches(e: Element, tag: Optional[str], cls, mode: str = "one",
            attr: Optional[tuple] = None) -> bool:
    if tag is not None and e.tag != tag:
        return False
    if attr is not None and e.attrs.get(attr[0]) != attr[1]:
        return False
    return class_matches(e.classes, e.attrs.get("class"), cls, mode)


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("[document]", {}, None)
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        parent = self.stack[-1]
        el = Element(tag, {k: (v if v is not None else "") for k, v in attrs}, parent)
        parent.children.append(el)
        if tag not in VOID_TAGS:
            self.stack.append(el)

    def handle_startendtag(self, tag, attrs):
        parent = self.stack[-1]
        parent.children.append(
            Element(tag, {k: (v if v is not None else "") for k, v in attrs}, parent))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
        # unmatched end tag: ignored

    def handle_data(self, data):
        if data:
            self.stack[-1].children.append(data)

    def handle_comment(self, data):
        self.stack[-1].children.append(_Comment((data,)))


def parse(html: Optional[str]) -> Element:
    b = _TreeBuilder()
    if html:
        b.feed(html)
        b.close()
    return b.root


def as_list(v) -> Optional[list]:
    """Arrow hands array<string> to pandas as numpy arrays; normalise."""
    if v is None:
        return None
    try:
        import numpy as np  # noqa: F401
        if hasattr(v, "tolist"):
            v = v.tolist()
    except ImportError:  # pragma: no cover
        pass
    if isinstance(v, float):  # NaN from pandas for a null array
        return None
    return list(v)


def opt(v):
    """Null from pandas (None / NaN) to None."""
    if v is None:
        return None
    if isinstance(v, float) and v != v:
        return None
    return v
