"""String column expressions (built-in functions only)."""

from __future__ import annotations

from typing import Sequence, Union

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from file names, in this order.
FILENAME_REMOVED_CHARS = '<>:"/\\|?*'
# Reserved device names (compared upper-cased).
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL",
                  "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
                  "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
# Fixed value: name used when cleaning leaves nothing.
EMPTY_FILENAME = "unnamed_file"


def _col(c: Union[str, Column]) -> Column:
    return F.col(c) if isinstance(c, str) else c


def absolutize(href: Union[str, Column], base: Union[str, Column], strict: bool = False) -> Column:
    """Make a listing link absolute against the site base.

    Only ``https`` counts as absolute (``strict`` also accepts ``http://``).
    Otherwise one leading ``.`` is dropped, or a ``/`` is added when missing,
    and the base is put in front.
    """
    h = _col(href)
    b = _col(base) if not isinstance(base, str) or not base.startswith("http") else F.lit(base)
    absolute = h.startswith("https") if not strict else h.rlike("^https?://")
    rel = (F.when(h.startswith("."), F.substring(h, 2, 1 << 30))
            .when(h.startswith("/"), h)
            .otherwise(F.concat(F.lit("/"), h)))
    return F.when(absolute, h).otherwise(F.concat(b, rel))


def url_origin(url: Union[str, Column]) -> Column:
    """``scheme://host`` of a URL (empty when the URL has no scheme)."""
    return F.regexp_extract(_col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def safe_filename(name: Union[str, Column]) -> Column:
    """File-system safe name (not lower-cased; callers lower the result).

    Remove the reserved characters, keep printable ASCII only (tab, newline,
    carriage return, vertical tab and form feed count as printable), spaces and
    hyphens become underscores, a reserved device name gets ``_`` before its
    extension, leading/trailing spaces and dots go, and an empty result
    becomes ``unnamed_file``.

    A linear chain of replacements (each step reads the previous one once), so
    the expression stays small however long the chain.  The reserved-name
    step matches the whole name as ``NAME`` or ``NAME.ext`` with a single
    extension, i.e. exactly the names whose stem before the last dot is
    reserved.
    """
    reserved = "(?i)^(" + "|".join(RESERVED_NAMES) + r")(\.[^.]*)?$"
    s = F.translate(_col(name), FILENAME_REMOVED_CHARS, "")
    s = F.regexp_replace(s, r"[^\x09-\x0d\x20-\x7e]", "")
    s = F.translate(s, " -", "__")
    s = F.regexp_replace(s, reserved, "$1_$2")
    s = F.regexp_replace(s, r"^[ .]+|[ .]+$", "")
    return F.regexp_replace(s, "^$", EMPTY_FILENAME)


def none_text(c: Union[str, Column]) -> Column:
    """Null rendered as the text ``None`` (how a missing value prints in a name)."""
    return F.coalesce(_col(c).cast("string"), F.lit("None"))


def article_file_name(title, source, publish_date, is_pdf: Union[bool, Column] = False) -> Column:
    """``lower(safe(title_source_date.txt))``; paged documents add ``.txt`` after cleaning."""
    stem = F.concat_ws("_", none_text(title), none_text(source), none_text(publish_date))
    json_name = F.lower(safe_filename(F.concat(stem, F.lit(".txt"))))
    pdf_name = F.concat(F.lower(safe_filename(stem)), F.lit(".txt"))
    if isinstance(is_pdf, bool):
        return pdf_name if is_pdf else json_name
    return F.when(is_pdf, pdf_name).otherwise(json_name)


def _cased(c: Column) -> Column:
    return F.lower(c) != F.upper(c)


def title_case(s: Union[str, Column]) -> Column:
    """Title case: a cased character right after a non-cased one (or at the
    start) is upper-cased, every other character lower-cased -- so letters
    after digits or apostrophes are capitalised too."""
    chars = F.split(_col(s), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(
        (i == 0) | ~_cased(F.element_at(chars, i)), F.upper(c)).otherwise(F.lower(c))), "")


def camel_case(s: Union[str, Column]) -> Column:
    """snake_case -> CamelCase: split on ``_``, title-case each part, join."""
    return F.array_join(F.transform(F.split(_col(s), "_"), title_case), "")


def path_stem(path: Union[str, Column]) -> Column:
    """Lower-cased stem of the last path component (last suffix removed)."""
    name = F.regexp_extract(F.regexp_replace(_col(path), "/+$", ""), r"([^/]*)$", 1)
    has_suffix = name.rlike(r"^.+\.[^.]+$") & ~name.rlike(r"^\.[^.]*$")
    stem = F.when(has_suffix, F.regexp_extract(name, r"^(.*)\.[^.]+$", 1)).otherwise(name)
    return F.lower(stem)


def listing_line(i: Column, title: Column, source: Column, date: Column) -> Column:
    """One line of the article list: ``\\t{i}) {title} - {source}, {date}\\n``."""
    return F.format_string("\t%d) %s - %s, %s\n", i, none_text(title), none_text(source),
                           none_text(date))


def json_value(c: Union[str, Column]) -> Column:
    """A JSON literal for a scalar or array column (``null`` kept)."""
    col = _col(c)
    arr = F.to_json(F.array(col))
    return F.regexp_replace(arr, r"^\[|\]$", "")


def json_array(c: Union[str, Column]) -> Column:
    """A JSON array of scalars with ``", "`` between elements (``null`` kept)."""
    col = _col(c)
    items = F.concat_ws(", ", F.transform(col, json_value))
    return F.when(col.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), items, F.lit("]")))


def json_document(fields: Sequence[str], arrays: Sequence[str] = ()) -> Column:
    """A record as one JSON text in key order, ``", "``/``": "`` separators,
    nulls kept and non-ASCII left as is (the article document format);
    ``arrays`` names the fields that hold arrays of scalars."""
    pairs = [F.concat(F.lit(f'"{f}": '), json_array(f) if f in arrays else json_value(f)) for f in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
