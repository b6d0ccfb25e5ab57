"""Text columns: stripping, lines, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space (any Unicode kind) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def lines(c: Column) -> Column:
    """The lines of a text; an end of line at the very end starts no further one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])\z", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"))


def spaced(c: Column) -> Column:
    """White-space runs as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def folded(c: Column) -> Column:
    """Lower case, umlauts and sharp s spelled out, white-space runs as one space."""
    out = F.lower(F.coalesce(c, F.lit("")))
    for a, b in (("ü", "ue"), ("ä", "ae"), ("ö", "oe"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return spaced(out)


def preview(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)
