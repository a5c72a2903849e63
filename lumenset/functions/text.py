"""Normalising expressions shared by all operators. Blank text counts as NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the token pattern of the public WordPunct tokenizer, with the Unicode classes of Python's re
#: spelled out for java.util.regex (letters, numbers and "_" are word characters).
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
TOKEN_PATTERN = rf"[{_WORD}]+|[^{_WORD}{_SPACE}]+"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def folded(c: Column) -> Column:
    """Lower case without blanks at the ends; blank gives NULL."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def folded_source(c: Column) -> Column:
    """As ``folded``, also without one trailing slash."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "/$", ""), F.lit(""))


def token_count(c: Column) -> Column:
    """Tokens of a text; NULL has none."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("int")


def valid_phash(c: Column) -> Column:
    """The 64-bit value of a 16-digit hexadecimal hash, as a signed long; anything else gives NULL."""
    t = F.lower(F.trim(c))
    return F.when(t.rlike("^[0-9a-f]{16}$"), F.conv(t, 16, -10).cast("long"))


def finite_score(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)
