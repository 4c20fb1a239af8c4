"""Column-level functions (everything stays inside Catalyst / codegen)."""

from limnos.functions.casts import as_integer, as_long, as_numeric, na_tokens
from limnos.functions.datetimes import (calendar_columns, format_datetime, month_name, noon,
                                        parse_exact, parse_flexible)
from limnos.functions.labels import percent, signed_percent, station_label
from limnos.functions.text import (clean_names, clean_station_name, sentence_case, squish,
                                   strip_line_breaks, strip_non_alnum_punct, title_case)
from limnos.functions.units import both_units, c_to_f, f_to_c, r_round, temp_check, unit_label

__all__ = [
    "as_integer", "as_long", "as_numeric", "na_tokens", "calendar_columns", "format_datetime",
    "month_name", "noon", "parse_exact", "parse_flexible", "percent", "signed_percent",
    "station_label", "clean_names", "clean_station_name", "sentence_case", "squish",
    "strip_line_breaks", "strip_non_alnum_punct", "title_case", "both_units", "c_to_f",
    "f_to_c", "r_round", "temp_check", "unit_label",
]
