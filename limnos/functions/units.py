"""Temperature units, range checks and R-compatible rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limnos.functions.util import as_col

# Plausible water temperature per unit, inclusive.
TEMP_RANGE = {"F": (23.0, 86.0), "C": (-5.0, 30.0)}


def r_round(c, digits: int = 2) -> Column:
    """R's ``round(x, digits)`` (R >= 4): pick the nearer of the two decimal
    neighbours computed in double arithmetic; exact ties go to the even one.

    Unlike ``bround`` (which rounds the shortest decimal text) this agrees
    with R on values such as 2.675 -> 2.67.
    """
    x = as_col(c)
    p = float(10 ** digits)
    ax = F.abs(x)
    i10 = F.floor(ax * p)
    lo = i10 / p
    hi = F.ceil(ax * p) / p
    dd = ax - lo
    du = hi - ax
    pick_hi = (du < dd) | ((du == dd) & (F.pmod(i10, F.lit(2)) == 1))
    r = F.when(pick_hi, hi).otherwise(lo)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.signum(x) * r)


def c_to_f(c) -> Column:
    return as_col(c) * 1.8 + 32


def f_to_c(c) -> Column:
    return (as_col(c) - 32) * 5 / 9.0


def temp_check(temp, unit) -> Column:
    """True when the reading lies in the plausible range for its unit."""
    t, u = as_col(temp), as_col(unit)
    (flo, fhi), (clo, chi) = TEMP_RANGE["F"], TEMP_RANGE["C"]
    return F.when(u == "F", t.between(flo, fhi)).otherwise(t.between(clo, chi))


def both_units(temp, unit) -> dict[str, Column]:
    """temp_f / temp_c: the reading in its own unit, the other rounded to 2."""
    t, u = as_col(temp), as_col(unit)
    return {"temp_f": F.when(u == "F", t).otherwise(r_round(c_to_f(t), 2)),
            "temp_c": F.when(u == "C", t).otherwise(r_round(f_to_c(t), 2))}


def unit_label(value, unit: str) -> Column:
    """Empty text when the value is missing, else the unit."""
    return F.when(as_col(value).isNull(), F.lit("")).otherwise(F.lit(unit))
