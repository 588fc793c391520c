"""Date column expressions (all built-in, JVM side).

Dates stay strings ``yyyy-MM-dd`` at the article boundary, as extracted; a
parsed ``date`` is derived where needed.  The clock is a parameter (``as_of``),
never ``now()``, so reruns are reproducible.
"""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

# The listing date formats, tried in this order (first that
# parses wins), written in Spark pattern letters.
LISTING_DATE_FORMATS = ["MMMM d, yyyy", "MMM d, yyyy", "M.d.yyyy", "d/M/yyyy"]
# Fixed value: relative-date phrase "<n> giorni fa" (n days ago).
RELATIVE_DAYS_PATTERN = r"(\d+) giorni fa"
# Fixed value: paper section heading, weekday first, e.g. "Mon, 3 Feb 2025".
SECTION_DATE_PATTERN = r"^(\w{3}), (\d{1,2} \w{3} \d{4})"
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def _col(c: Union[str, Column]) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _date_lit(as_of) -> Column:
    return F.to_date(F.lit(str(as_of)))


def squash_ws(s: Column) -> Column:
    """Any run of white space -> one space (a space in a strptime format
    matches any white space run; Spark patterns need the exact text)."""
    return F.regexp_replace(s, r"\s+", " ")


def attr_date(s: Union[str, Column]) -> Column:
    """Date taken from an attribute: the text before the first ``T``, unchecked."""
    return F.substring_index(_col(s), "T", 1)


def _days_ago(s: Union[str, Column], as_of) -> Column:
    n = F.regexp_extract(_col(s), RELATIVE_DAYS_PATTERN, 1)
    return F.when(n != "", F.date_sub(_date_lit(as_of), n.try_cast("int")))


def relative_date(s: Union[str, Column], as_of) -> Column:
    """``<n> giorni fa`` anywhere in the text -> as_of - n days, as ``yyyy-MM-dd``."""
    return F.date_format(_days_ago(s, as_of), "yyyy-MM-dd")


def cascade_date(s: Union[str, Column], as_of) -> Column:
    """Text date: first listing format that parses, else the relative phrase, else null.

    The relative phrase is consulted after the first format fails, so it wins
    over the later formats; no text matching the phrase parses under them, so
    trying it last is equivalent.
    """
    c = squash_ws(F.trim(_col(s)))
    parsed = F.coalesce(*[F.try_to_date(c, fmt) for fmt in LISTING_DATE_FORMATS])
    return F.date_format(F.coalesce(parsed, _days_ago(s, as_of)), "yyyy-MM-dd")


def publish_date(raw: Union[str, Column], kind: Union[str, Column], as_of) -> Column:
    """Listing publish date from the extracted date node (attribute or text)."""
    k = _col(kind)
    return (F.when(k == "attr", attr_date(raw))
             .when(k == "text", cascade_date(raw, as_of)))


def section_date(s: Union[str, Column]) -> Column:
    """Paper section heading -> ``yyyy-MM-dd`` or null.

    The heading must start with ``Www, d Mmm yyyy`` and the weekday must be a
    weekday abbreviation (it is not checked against the date).
    """
    c = _col(s)
    wd = F.lower(F.regexp_extract(c, SECTION_DATE_PATTERN, 1))
    body = F.regexp_extract(c, SECTION_DATE_PATTERN, 2)
    d = F.try_to_date(body, "d MMM yyyy")
    return F.when(wd.isin(WEEKDAYS), F.date_format(d, "yyyy-MM-dd"))


def run_date(as_of) -> Column:
    return F.date_format(_date_lit(as_of), "yyyy-MM-dd")


def day_part(ts: Union[str, Column]) -> Column:
    """5-11 morning, 12-17 afternoon, otherwise evening."""
    h = F.hour(_col(ts))
    return (F.when(h.between(5, 11), "morning")
             .when(h.between(12, 17), "afternoon")
             .otherwise("evening"))
