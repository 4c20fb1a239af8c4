"""Date/time parsing and calendar columns (session time zone pinned to UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limnos.functions.util import as_col

# The logger export formats, tried in this order, first match
# wins (strptime spelling -> Spark pattern).
LOGGER_FORMATS = [
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:mm:ss"),
    ("%m-%d-%Y %H:%M:%S", "M-d-yyyy H:mm:ss"),
    ("%m-%d-%y %H:%M:%S", "M-d-yy H:mm:ss"),
    ("%m/%d/%y %I:%M:%S %p", "M/d/yy h:mm:ss a"),
    ("%m/%d/%y %H:%M:%S", "M/d/yy H:mm:ss"),
    ("%m/%d/%Y %H:%M", "M/d/yyyy H:mm"),
    ("%m/%d/%Y %H:%M:%S", "M/d/yyyy H:mm:ss"),
]

# The text shape each Spark pattern can accept.  A pattern is only tried on
# text of its shape: a failed parse costs a thrown exception, and with seven
# formats most rows would otherwise fail several times.
_D12, _D2, _D4 = r"\d{1,2}", r"\d{2}", r"\d{4}"
_SHAPES = {
    "yyyy-M-d H:mm:ss": rf"^{_D4}-{_D12}-{_D12} {_D12}:{_D2}:{_D2}$",
    "M-d-yyyy H:mm:ss": rf"^{_D12}-{_D12}-{_D4} {_D12}:{_D2}:{_D2}$",
    "M-d-yy H:mm:ss": rf"^{_D12}-{_D12}-{_D2} {_D12}:{_D2}:{_D2}$",
    "M/d/yy h:mm:ss a": rf"^{_D12}/{_D12}/{_D2} {_D12}:{_D2}:{_D2} [AaPp][Mm]$",
    "M/d/yy H:mm:ss": rf"^{_D12}/{_D12}/{_D2} {_D12}:{_D2}:{_D2}$",
    "M/d/yyyy H:mm": rf"^{_D12}/{_D12}/{_D4} {_D12}:{_D2}$",
    "M/d/yyyy H:mm:ss": rf"^{_D12}/{_D12}/{_D4} {_D12}:{_D2}:{_D2}$",
    "y M d h m a": r"^\d+ \d{1,2} \d{1,2} \d{1,2} \d{1,2} [AaPp][Mm]$",
    "y M d H m": r"^\d+ \d{1,2} \d{1,2} \d{1,2} \d{1,2}$",
    "M d y h m s a": r"^\d{1,2} \d{1,2} \d+ \d{1,2} \d{1,2} \d{1,2} [AaPp][Mm]$",
    "M d y H m s": r"^\d{1,2} \d{1,2} \d+ \d{1,2} \d{1,2} \d{1,2}$",
}

# Orders accepted by the flexible parser, after separators are normalised to
# single spaces.  "ymdHMp": year month day hour minute AM/PM (24-hour clock
# when no marker); "mdyHMSp": month day year hour minute second AM/PM.
FLEX_ORDERS = {
    "ymdHMp": ["y M d h m a", "y M d H m"],
    "mdyHMSp": ["M d y h m s a", "M d y H m s"],
}


def _try_shapes(s: Column, fmts: list[str]) -> Column:
    """First pattern whose shape matches and which parses (``s`` should be a
    cheap expression: it is referenced once per pattern)."""
    return F.coalesce(*[F.when(s.rlike(_SHAPES[f]),
                               F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz"))
                        for f in fmts])


def parse_exact(c, formats=LOGGER_FORMATS) -> Column:
    """First of the exact formats that parses; NULL when none does."""
    return _try_shapes(F.trim(as_col(c).cast("string")), [f for _, f in formats])


def normalize_datetime_text(c) -> Column:
    """Runs of non-alphanumerics -> one space (the flexible parser's input)."""
    return F.trim(F.regexp_replace(as_col(c).cast("string"), r"[^0-9A-Za-z]+", " "))


def parse_normalized(c, order: str = "ymdHMp") -> Column:
    """``parse_flexible`` on text already passed through
    ``normalize_datetime_text`` (stage it as its own column so the regex
    runs once per row)."""
    return _try_shapes(as_col(c), FLEX_ORDERS[order])


def parse_flexible(c, order: str = "ymdHMp") -> Column:
    """``parse_date_time(x, order)``: any run of non-alphanumerics separates."""
    return parse_normalized(normalize_datetime_text(c), order)


def with_flexible_datetime(df, src: str, dst: str, order: str = "ymdHMp", filtered: bool = False):
    """DataFrame form of ``parse_flexible``: normalises in one projection and
    parses in the next.  Catalyst does not merge the two (the normalised
    text is used several times and is not cheap), so the regex runs once.

    A filter on the result would be pushed below both and parse every text once
    more, with the regex per mention; with ``filtered`` the parsed value comes
    from a one-element generator, which filters on it are not pushed through."""
    tmp = f"__{dst}_text"
    out = df.withColumn(tmp, normalize_datetime_text(src))
    parsed = parse_normalized(tmp, order)
    if not filtered:
        return out.withColumn(dst, parsed).drop(tmp)
    value = f"__{dst}_value"
    out = out.select("*", F.explode(F.array(parsed)).alias(value))
    return out.select(*[F.col(value).alias(dst) if c == dst else F.col(c) for c in df.columns],
                      *[F.col(value).alias(dst)] * (dst not in df.columns))


def noon(date_col) -> Column:
    """The date at 12:00 (daily values aligned to noon)."""
    return as_col(date_col).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))


def month_name(date_col) -> Column:
    return F.date_format(as_col(date_col), "MMMM")


def calendar_columns(date_col: str = "date") -> dict[str, Column]:
    d = F.col(date_col)
    return {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
            "yday": F.dayofyear(d)}


def format_datetime(c) -> Column:
    """``format(x, "%Y-%m-%d %H:%M:%S")``."""
    return F.date_format(as_col(c), "yyyy-MM-dd HH:mm:ss")
