"""Whitespace handling shared by the text and array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_all(c: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and whitespace-only text; never NULL."""
    return F.coalesce(trim_all(c) == "", F.lit(True))
