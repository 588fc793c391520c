"""Spark wrappers around the per-page extraction functions.

Only the HTML pass runs in Python (Arrow batches via ``mapInArrow`` /
``mapInPandas`` / ``pandas_udf``).  Callers select the needed columns first: column pruning does
not reach through a Python stage.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Iterable, Optional, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import extract as X
from gleaner.functions.batches import release, slices

PF = "pf_"

#: Bytes of pages that a worker turns into Python objects at a time.
STEP_BYTES = 1e6


@dataclass(frozen=True)
class Profile:
    """One extraction profile (a row of user data, see ``SOURCE_PROFILES``)."""

    source: str
    base_url: str
    rank: Optional[int] = None
    cand_tag: Optional[str] = "a"
    cand_classes: Sequence[str] = ()
    cand_mode: Optional[str] = None
    wrapped: bool = False
    link_tag: Optional[str] = "a"
    link_classes: Sequence[str] = ()
    title_tag: Optional[str] = "p"
    title_classes: Sequence[str] = ()
    date_tag: Optional[str] = "time"
    date_class: Optional[str] = None
    date_attr: Optional[str] = None
    date_index: int = 0
    cap: Optional[int] = 20
    container_tag: Optional[str] = None
    container_class: Optional[str] = None
    container_id: Optional[str] = None
    body_rank: Optional[int] = None
    body_tag: Optional[str] = None
    body_class: Optional[str] = None
    parser: str = "listing"          # listing | paper

    def values(self) -> dict:
        d = asdict(self)
        return {k: d[k] for k, _ in X.PROFILE_COLUMNS}


def _lit(v, dtype: str) -> Column:
    if dtype.startswith("array"):
        return F.array(*[F.lit(x) for x in v]).cast("array<string>") if v else F.lit(None).cast("array<string>")
    return F.lit(v).cast(dtype)


def profile_struct(p: Profile) -> Column:
    vals = p.values()
    return F.struct(*[_lit(vals[k], t).alias(k) for k, t in X.PROFILE_COLUMNS])


def dispatch(df: DataFrame, profiles: Iterable[Profile], url_col: str = "url",
             order: str = "rank") -> DataFrame:
    """Attach the first profile whose ``base_url`` is a substring of the URL.

    ``order`` is ``rank`` (listing dispatch) or ``body_rank`` (body dispatch,
    its own order; profiles without a body rule are skipped).  Unmatched rows
    get null profile columns.  The result is a pure projection: a ``CASE``
    chain evaluated row by row, first match wins.  The chain is as long as the
    profile list, which is configuration and does not grow with the data.
    """
    profs = [p for p in profiles if getattr(p, order) is not None]
    profs.sort(key=lambda p: getattr(p, order))
    url = F.col(url_col)
    chain = None
    for p in profs:
        cond = url.contains(p.base_url)
        chain = F.when(cond, profile_struct(p)) if chain is None else chain.when(cond, profile_struct(p))
    if chain is None:
        chain = F.lit(None).cast(_profile_type())
    out = df.withColumn("_pf", chain)
    return out.select("*", *[F.col(f"_pf.{k}").alias(PF + k) for k, _ in X.PROFILE_COLUMNS]).drop("_pf")


def _profile_type() -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(t)) for k, t in X.PROFILE_COLUMNS])


def with_profile(df: DataFrame, p: Profile) -> DataFrame:
    """Attach one fixed profile to every row (no dispatch)."""
    vals = p.values()
    return df.select("*", *[_lit(vals[k], t).alias(PF + k) for k, t in X.PROFILE_COLUMNS])


def map_pages(src: DataFrame, keep: Sequence[str], fields: str, rows_of) -> DataFrame:
    """``rows_of(page)``, rows of ``fields``, for every page of ``src`` (a dict of its columns),
    with the page's ``keep`` columns.

    A batch is taken in steps of ``STEP_BYTES``: only a step's pages are Python objects
    at a time, whatever the session's batch size, and ``keep`` columns never are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = list(keep)
    kinds = to_arrow_schema(T._parse_datatype_string(fields))
    schema = T.StructType([src.schema[c] for c in keep] + T._parse_datatype_string(fields).fields)

    def run(batches):
        for step in slices(batches, STEP_BYTES):
            at, out = [], []
            for i, page in enumerate(step.to_pylist()):
                found = rows_of(page)
                at += [i] * len(found)
                out += found
            columns = list(zip(*out)) or [()] * len(kinds)
            taken = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [step.column(c).take(taken) for c in keep] + [pa.array(v, type=f.type) for v, f in zip(columns, kinds)],
                names=[*keep, *kinds.names])

    return src.mapInArrow(run, schema)


LISTING_FIELDS = "pos int, href string, title string, date_raw string, date_kind string"


def extract_listing(df: DataFrame, keep: Sequence[str] = ("page_id",),
                    diagnostics: bool = False) -> DataFrame:
    """Candidates of each listing page -> one row per candidate.

    ``df`` holds ``html`` and the ``pf_*`` profile columns; ``keep`` columns are
    carried through.  Rows: keep + (pos, href, title, date_raw, date_kind).
    With ``diagnostics`` a page whose container is missing yields one row with
    ``pos = -1``, null link and ``date_kind = 'no_container'`` (the same parse
    pass; it never becomes an article because it has no link).
    """
    pf_cols = [PF + k for k, _ in X.PROFILE_COLUMNS]
    src = df.select(*keep, "html", *[c for c in pf_cols if c not in keep])
    names = [k for k, _ in X.PROFILE_COLUMNS]

    def rows_of(page: dict) -> list:
        prof = {k: page[PF + k] for k in names}
        if prof["source"] is None:
            return []
        cands = X.listing_candidates(page["html"], prof)
        if not cands and diagnostics and X.scoped_root(X.parse(page["html"]), prof) is None:
            return [(-1, None, None, None, "no_container")]
        return cands

    return map_pages(src, keep, LISTING_FIELDS, rows_of)


@F.pandas_udf(T.StringType())
def body_text_udf(html: pd.Series, tag: pd.Series, cls: pd.Series) -> pd.Series:
    return pd.Series([X.body_text(h, t, c if isinstance(c, str) else None)
                      for h, t, c in zip(html, tag, cls)], dtype=object)


def body_text(html: Column, tag: Column, cls: Column) -> Column:
    """Body text of the first ``tag(.cls)`` element (null when absent)."""
    return body_text_udf(html, tag, cls)


def nth_node_text(html: Column, tag: str, cls: Optional[str], index: int,
                  scope_tag: Optional[str] = None) -> Column:
    """Stripped text of the index-th ``tag(.cls)`` (under ``scope_tag``), null if too few."""

    @F.pandas_udf("string")
    def _nth(h: pd.Series) -> pd.Series:
        return pd.Series([X.nth_node_text(x, scope_tag, tag, cls, index) for x in h], dtype=object)

    return _nth(html)


HEADER_TYPE = "struct<href string, title string, date_text string>"


def header_item(html: Column, container_tag: str, container_class: Optional[str],
                link_tag: str, link_class: Optional[str],
                date_tag: Optional[str] = None, date_class: Optional[str] = None) -> Column:
    """The header article of a listing page as a struct (null when absent)."""

    @F.pandas_udf(HEADER_TYPE)
    def _hdr(h: pd.Series) -> pd.DataFrame:
        rows = [X.header_item(x, container_tag, container_class, link_tag, link_class,
                              date_tag, date_class) for x in h]
        return pd.DataFrame([r if r is not None else (None, None, None) for r in rows],
                            columns=["href", "title", "date_text"])

    # all-null structs mean "no header": turn them into a null struct
    s = _hdr(html)
    return F.when(s.title.isNotNull() | s.href.isNotNull(), s)


TAGGED_FIELDS = ("kind string, node int, parent int, section_pos int, pos int, href string, pdf_href string, "
                 "title string, names array<string>, date_raw string, date_kind string")


def page_rows(html: Optional[str], profile: dict, rules: Sequence) -> list:
    """All rows of one page, from one tree, in the order of ``TAGGED_FIELDS``:

    - ``header``: one per rule, ``node`` its number, ``date_raw`` its date text, ``pos`` -1;
    - ``listing``: the candidates of a listing page;
    - ``section``, ``entry``, ``detail``: the nodes of a paper listing;
    - ``status``: ``date_kind`` is ok, no_candidates, no_container or no_profile,
      ``pos`` the number of candidates."""
    def row(kind, node=None, parent=None, section=None, pos=None, href=None, pdf=None, title=None, names=None, raw=None, date_kind=None):
        return [kind, node, parent, section, pos, href, pdf, title, names, raw, date_kind]

    if profile["source"] is None and not rules:
        return [row("status", pos=0, date_kind="no_profile")]
    root, out = X.parse(html), []
    for number, r in rules:
        h = X.header_in(root, r.container_tag, r.container_class, r.link_tag, r.link_class, r.date_tag, r.date_class)
        if h is not None:
            out.append(row("header", number, pos=-1, href=h[0], title=h[1], raw=h[2]))
    if profile["source"] is None:
        return [*out, row("status", pos=0, date_kind="no_profile")]
    if profile["parser"] == "paper":
        return out + [row(kind, node, parent, section, None, href, pdf, text, names)
                      for kind, node, parent, section, href, pdf, text, names in X.paper_nodes(root)]
    scope = X.scoped_root(root, profile)
    found = X.candidates_in(scope, profile)
    out += [row("listing", pos=pos, href=href, title=title, raw=raw, date_kind=kind) for pos, href, title, raw, kind in found]
    state = "no_container" if scope is None else "ok" if found else "no_candidates"
    return [*out, row("status", pos=len(found), date_kind=state)]


def parse_pages(df: DataFrame, keep: Sequence[str] = ("page_id",), rules: Sequence = (), by_url: bool = False) -> DataFrame:
    """Every row that a page gives, tagged by ``kind`` (see ``page_rows``): one Python
    stage, one tree per page.

    ``df`` holds ``html`` and the ``pf_*`` columns of the page's first matching profile,
    which decides what is extracted; a header rule applies to the pages
    of the profile with its source (``by_url``: to URLs that contain its base)."""
    names = [k for k, _ in X.PROFILE_COLUMNS]
    keep = list(keep)
    src = df.select(*keep, *(c for c in ("html", "url", *(PF + k for k in names)) if c not in keep))
    keep_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)
    rules = list(enumerate(rules))
    columns = keep + [f.split()[0] for f in TAGGED_FIELDS.split(", ")]

    def run(batches):
        for pdf in batches:
            step = max(1, int(len(pdf) * STEP_BYTES / max(1, pdf["html"].str.len().sum())))
            for at in range(0, len(pdf), step):        # only a step's pages as records and trees
                out = []
                for rec in pdf.iloc[at:at + step].to_dict("records"):
                    mine = [(i, r) for i, r in rules
                            if (r.base_url in (rec["url"] or "") if by_url else r.source == rec[PF + "source"])]
                    base = [rec[k] for k in keep]
                    out += [base + x for x in page_rows(rec["html"], {k: X.opt(rec[PF + k]) if k.endswith("source") else rec[PF + k]
                                                                      for k in names}, mine)]
                yield pd.DataFrame(out, columns=columns).astype({c: "Int32" for c in ("node", "parent", "section_pos", "pos")})
            release()

    return src.mapInPandas(run, f"{keep_schema}, {TAGGED_FIELDS}")
