"""Lenient conversions with R's coercion rules (values that fail become NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limnos.functions.util import as_col

# A decimal number as R's as.numeric() reads it: optional sign, digits with an
# optional fraction, optional exponent, surrounding blanks allowed, or Inf.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?Inf\s*$"

WHOLE_PATTERN = r"^[+-]?\d+$"


def as_numeric(c) -> Column:
    """``as.numeric``: text to double, NULL when not a number.

    Spark alone would accept '1d' or '1f' and would keep NaN; R turns the
    first into NA and treats NaN as missing, so a pattern guards the cast and
    NaN is mapped to NULL.
    """
    c = as_col(c)
    s = F.trim(c.cast("string"))
    # Spark's own cast already reads "Inf"; the pattern only rejects what R
    # would not accept (e.g. '1d', hex, 'NaN')
    return F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))


def as_integer(c) -> Column:
    """``as.integer``: truncates toward zero ('12.7' -> 12), NULL on overflow."""
    return as_numeric(c).try_cast("int")


def as_long(c) -> Column:
    """Like ``as_integer`` but 64-bit, for identifiers that outgrow int.

    Whole numbers in plain digits are read exactly: a double would merge ids above
    2^53.  Fractions and exponents go through double, as in ``as_integer``.
    """
    s = F.trim(as_col(c).cast("string"))
    return F.when(s.rlike(WHOLE_PATTERN), s.try_cast("bigint")).otherwise(as_numeric(c).try_cast("bigint"))


def na_tokens(c, tokens=("", "NA")) -> Column:
    """``read_csv``'s NA handling: trimmed text, NULL for the NA tokens."""
    t = F.trim(as_col(c).cast("string"))
    return F.when(~t.isin(*tokens), t)
