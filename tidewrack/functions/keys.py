"""Keys: how ids compare, and the ids and topic keys derived from contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = " \t\r\n\f\v "


def trimmed(c: Column) -> Column:
    """``c`` without surrounding blanks; null stays null."""
    return F.btrim(c, F.lit(_BLANK))


def blank(c: Column) -> Column:
    """True for null, empty and only-blank values."""
    return c.isNull() | (F.length(trimmed(c)) == 0)


def norm_key(c: Column) -> Column:
    """Keys compare without surrounding blanks and without regard to case; null, empty and blank become null."""
    t = F.lower(trimmed(c))
    return F.when(F.length(t) > 0, t)
