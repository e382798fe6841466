"""String expressions shared by the jobs. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space when stripping.
_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space at both ends; looks at the ends only, however long the text."""
    return F.btrim(text, F.lit(_SPACE))


def title_key(title: Column) -> Column:
    """Case- and edge-space-insensitive key used to recognise a repeated title."""
    return F.lower(strip(F.coalesce(title, F.lit(""))))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def empty(text: Column) -> Column:
    """Null or zero-length; white space counts as content."""
    return F.coalesce(text, F.lit("")) == ""


def nullif_empty(text: Column) -> Column:
    return F.when(text != "", text)


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, so ``r2_d2`` becomes ``R2 D2``."""
    words = F.regexp_extract_all(F.replace(text, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, F.initcap), "")


def form_encode(text: Column) -> Column:
    """Form encoding with ``~`` left alone and ``*`` escaped."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

