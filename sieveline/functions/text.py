"""Column helpers for text rules that were written with Unicode-aware, newline-only regular expressions in mind.

``rx`` puts the flags in front that make Java patterns behave so: d (only \\n ends a line), U (Unicode classes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Python's str methods and patterns: Unicode's, and the four separators \x1c to \x1f.
WS = r"[\s\x1C-\x1F]"
#: The same, one by one.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Line ends but \n.
ODD_END = r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def rx(pattern: str, flags: str = "") -> str:
    return f"(?dU{flags}){pattern}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(_col(c), F.lit(WHITE))


def lines(c: Column | str) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    parts = F.split(_col(c), LINE_END, -1)
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), rx(f"{WS}+")), lambda w: w != "")


def matches(c: Column | str, pattern: str, flags: str = "") -> Column:
    return F.rlike(_col(c), F.lit(rx(pattern, flags)))


def first_match(c: Column | str, pattern: str, group: int = 0, flags: str = "") -> Column:
    """The first match, or null. An empty match counts as none."""
    return F.nullif(F.regexp_extract(_col(c), rx(pattern, flags), group), F.lit(""))


def nonblank(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def starts_with_any(c: Column, heads: list[str]) -> Column:
    out = F.lit(False)
    for head in heads:
        out = out | c.startswith(head)
    return out


def normal_doi(c: Column | str) -> Column:
    """Without resolver address, slashes and spaces around; null if nothing is left. Case is kept."""
    bare = F.regexp_replace(strip(c), rx(r"^https?://(dx\.)?doi\.org/", "iu"), "")
    return F.nullif(F.btrim(bare, F.lit("/ ")), F.lit(""))


def html_escaped(c: Column | str) -> Column:
    out = F.coalesce(_col(c), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
