"""DuckDB spellings of the column functions, used only to write oracles.

Each helper returns SQL text for an expression over ``x``.  They restate the
rule in DuckDB terms (RE2 has no look-around, so boundaries are marked with
chr(1) and split), independent of the Spark code paths.
"""

from __future__ import annotations

from limnos.functions.casts import NUMERIC_PATTERN
from limnos.functions.datetimes import FLEX_ORDERS, LOGGER_FORMATS

WS = r"[\t\n\f\r\p{Z}]"
MARK = "chr(1)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squish(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def strip_non_alnum_punct(x: str) -> str:
    return f"regexp_replace({x}, {q(r'[^\p{L}\p{Nl}\p{Nd}\p{P} ]')}, '', 'g')"


def clean_station_name(x: str) -> str:
    return squish(strip_non_alnum_punct(x))


def _cap_first(p: str) -> str:
    return (f"(CASE WHEN NOT regexp_matches({p}, {q(r'[\p{L}\p{N}]')}) THEN {p} ELSE "
            f"regexp_extract({p}, {q(r'^([^\p{L}\p{N}]*)')}, 1) || "
            f"upper(regexp_extract({p}, {q(r'(?s)^[^\p{L}\p{N}]*(.)')}, 1)) || "
            f"regexp_extract({p}, {q(r'(?s)^[^\p{L}\p{N}]*.(.*)$')}, 1) END)")


def sentence_case(x: str) -> str:
    marked = f"regexp_replace({x}, {q('([.!?])(' + WS + ')')}, '\\1' || {MARK} || '\\2', 'g')"
    # a full stop followed by a lower-case word does not end a sentence
    unmarked = (f"regexp_replace({marked}, '\\.' || {MARK} || {q('(' + WS + r'+[^\p{L}.!?]*\p{Ll})')}, "
                f"'.\\1', 'g')")
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform("
            f"string_split({unmarked}, {MARK}), lambda p: {_cap_first('lower(p)')}), '') END")


def title_case(x: str) -> str:
    marked = f"regexp_replace(lower({x}), {q(r'([^\p{L}\p{M}\p{N}' + chr(39) + '’.])')}, '\\1' || {MARK}, 'g')"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform("
            f"string_split({marked}, {MARK}), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), '') END")


def as_numeric(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    v = f"TRY_CAST({t} AS DOUBLE)"
    return f"(CASE WHEN regexp_matches({t}, {q(NUMERIC_PATTERN)}) THEN {v} END)"


def as_integer(x: str) -> str:
    return f"TRY_CAST(trunc({as_numeric(x)}) AS INTEGER)"


def as_long(x: str) -> str:
    t = f"trim(CAST({x} AS VARCHAR))"
    return (f"(CASE WHEN regexp_matches({t}, '^[+-]?[0-9]+$') THEN TRY_CAST({t} AS BIGINT) "
            f"ELSE TRY_CAST(trunc({as_numeric(x)}) AS BIGINT) END)")


def r_round(x: str, digits: int = 2) -> str:
    p = f"{float(10 ** digits)}"
    ax = f"abs({x})"
    lo = f"(floor({ax} * {p}) / {p})"
    hi = f"(ceil({ax} * {p}) / {p})"
    du, dd = f"({hi} - {ax})", f"({ax} - {lo})"
    pick = f"({du} < {dd} OR ({du} = {dd} AND floor({ax} * {p}) % 2 = 1))"
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} "
            f"ELSE sign({x}) * (CASE WHEN {pick} THEN {hi} ELSE {lo} END) END)")


_STRPTIME = {"y": "%Y", "M": "%m", "d": "%d", "h": "%I", "H": "%H", "m": "%M", "s": "%S", "a": "%p"}


def parse_flexible(x: str, order: str = "ymdHMp") -> str:
    s = f"trim(regexp_replace(CAST({x} AS VARCHAR), '[^0-9A-Za-z]+', ' ', 'g'))"
    fmts = [" ".join(_STRPTIME[t] for t in f.split(" ")) for f in FLEX_ORDERS[order]]
    return "coalesce(" + ", ".join(f"try_strptime({s}, {q(f)})" for f in fmts) + ")"


_GUARD = {
    "%Y-%m-%d %H:%M:%S": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$",
    "%m-%d-%Y %H:%M:%S": r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}:\d{2}$",
    "%m-%d-%y %H:%M:%S": r"^\d{1,2}-\d{1,2}-\d{2} \d{1,2}:\d{2}:\d{2}$",
    "%m/%d/%y %I:%M:%S %p": r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$",
    "%m/%d/%y %H:%M:%S": r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2}:\d{2}$",
    "%m/%d/%Y %H:%M": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$",
    "%m/%d/%Y %H:%M:%S": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$",
}


def parse_exact(x: str) -> str:
    s = f"trim({x})"
    parts = [f"CASE WHEN regexp_matches({s}, {q(_GUARD[f])}) THEN try_strptime({s}, {q(f)}) END"
             for f, _ in LOGGER_FORMATS]
    return "coalesce(" + ", ".join(parts) + ")"


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def date_text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def order_by(cols: list[str]) -> str:
    return ", ".join(f"{c} ASC NULLS LAST" for c in cols)
