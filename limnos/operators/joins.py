"""Joins with R's NA-matching semantics.

dplyr joins match NA to NA; SQL ``=`` never does.  Every key comparison here
is ``<=>`` (``eqNullSafe``), which Catalyst still plans as an equi-join (hash
or sort-merge), never as a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, dict):
        return list(on.items())
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on]


def join_ns(left: DataFrame, right: DataFrame, on, how: str = "left",
            null_safe: bool = True, suffix: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on named keys (``on``: name, list of names or {left: right}).

    The left key columns are kept, right key columns dropped (dplyr style);
    other shared names get suffixes.
    """
    pairs = _pairs(on)
    rkeys = {r for _, r in pairs}
    tmp = [f"__rk{i}" for i in range(len(pairs))]
    lkeys = {lk for lk, _ in pairs}
    clash = [c for c in right.columns if c not in rkeys and c in left.columns]
    if clash:
        left = left.withColumnsRenamed({c: c + suffix[0] for c in clash if c not in lkeys})
    r = right.select(*[F.col(rk).alias(t) for (_, rk), t in zip(pairs, tmp)],
                     *[F.col(c).alias(c + suffix[1] if c in clash else c)
                       for c in right.columns if c not in rkeys])

    def eq(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b) if null_safe else a == b

    cond = reduce(lambda a, b: a & b, [eq(left[lk], r[t]) for (lk, _), t in zip(pairs, tmp)])
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out
    return out.drop(*tmp)


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_join(x, y)`` without ``by``: all shared columns, NA matches NA."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("natural join: no shared columns")
    return join_ns(left, right, keys, "left")


def semi_join_ns(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` whose key is in ``right`` (two-valued ``%in%``)."""
    return join_ns(left, right.select(*{r for _, r in _pairs(on)}), on, "left_semi")


def anti_join_ns(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right`` (``!(x %in% y)``).

    Unlike ``NOT IN``, a NULL in ``right`` does not empty the result, and a
    NULL key in ``left`` is excluded only if ``right`` holds a NULL.
    """
    return join_ns(left, right.select(*{r for _, r in _pairs(on)}), on, "left_anti")


def flag_join(left: DataFrame, right: DataFrame, on, flag: str = "have_data") -> DataFrame:
    """Left join of a TRUE flag from ``right``'s distinct keys; missing -> FALSE."""
    rcols = [r for _, r in _pairs(on)]
    flags = right.select(*rcols).distinct().withColumn(flag, F.lit(True))
    return join_ns(left, flags, on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def left_join_fill(left: DataFrame, right: DataFrame, on, fill: dict) -> DataFrame:
    """Left join, then ``replace_na`` on the named columns."""
    out = join_ns(left, right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def lookup(df: DataFrame, table: DataFrame, on) -> DataFrame:
    """Join a fixed, small lookup table (class colours, unit tables...).

    Only for tables whose size does not grow with the data, so the broadcast
    is bounded by construction.
    """
    return join_ns(df, F.broadcast(table), on, "left")
