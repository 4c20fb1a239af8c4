"""Unions and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.operators.groups import keep_first

_NUMERIC_RANK = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5}


def _common_type(name: str, types: list[str]) -> str:
    uniq = sorted(set(types))
    if len(uniq) == 1:
        return uniq[0]
    if all(t in _NUMERIC_RANK for t in uniq):
        return max(uniq, key=_NUMERIC_RANK.get)
    raise TypeError(f"bind_rows: column '{name}' has incompatible types {uniq}")


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """``bind_rows``: union by name, missing columns filled with NULL.

    Types are checked first: numeric columns widen, anything else must
    agree (Spark would otherwise coerce bigint + string silently and fail at
    run time).
    """
    dfs = [d for d in dfs if d is not None]
    types: dict[str, list[str]] = {}
    order: list[str] = []
    for d in dfs:
        for c, t in d.dtypes:
            if c not in types:
                order.append(c)
            types.setdefault(c, []).append(t)
    target = {c: _common_type(c, ts) for c, ts in types.items()}
    aligned = [d.select(*[F.col(c).cast(target[c]) if t != target[c] else F.col(c)
                          for c, t in d.dtypes]) for d in dfs]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    return out.select(*order)


def prioritized_union(dfs: list[DataFrame], keys: list[str], order: list = (),
                      rank_col: str = "__source_rank") -> DataFrame:
    """Stack sources; per key keep the row of the earliest source (then
    ``order``), like ``bind_rows(a, b, c) %>% distinct(key, .keep_all=TRUE)``."""
    ranked = [d.withColumn(rank_col, F.lit(i)) for i, d in enumerate(dfs)]
    out = keep_first(bind_rows(*ranked), keys, order=[rank_col, *order])
    return out.drop(rank_col)


def union_distinct(dfs: list[DataFrame], col: str) -> DataFrame:
    """``sort(unique(c(a$x, b$x, ...))) %>% na.omit()`` as a one-column table."""
    vals = reduce(lambda a, b: a.unionByName(b), [d.select(col) for d in dfs])
    return vals.where(F.col(col).isNotNull()).distinct()


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "name",
            value: str = "value") -> DataFrame:
    """``pivot_longer``: one row per (id, measure); NULL values are kept."""
    return df.unpivot(ids, values, name, value)


def pivot_counts(df: DataFrame, key: list[str], names_from: str, values: list[str],
                 count_col: str = "n") -> DataFrame:
    """``count(key, source) %>% pivot_wider(names_from = source, values_from = n)``
    with the value list given, so Spark does not scan for it."""
    return (df.groupBy(*key).pivot(names_from, values)
              .agg(F.count(F.lit(1)))
              .select(*key, *[F.when(F.col(v) > 0, F.col(v)).alias(v) for v in values]))
