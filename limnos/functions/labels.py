"""Display labels and formatted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limnos.functions.units import r_round
from limnos.functions.util import as_col


def percent(c, accuracy_digits: int = 1) -> Column:
    """``scales::percent(x, .1)``: "12.3%"; -0.0 prints as 0.0."""
    v = r_round(as_col(c) * 100, accuracy_digits)
    v = F.when(v == 0, F.lit(0.0)).otherwise(v)
    return F.format_string(f"%.{accuracy_digits}f%%", v)


def signed_percent(c, accuracy_digits: int = 1) -> Column:
    """Percent label with an explicit '+' unless it starts with '-'."""
    p = percent(c, accuracy_digits)
    return F.when(F.left(p, F.lit(1)) == "-", p).otherwise(F.concat(F.lit("+"), p))


def station_label(station_id, station_name) -> Column:
    """"[id] name"."""
    return F.concat(F.lit("["), as_col(station_id).cast("string"), F.lit("] "),
                    as_col(station_name))
