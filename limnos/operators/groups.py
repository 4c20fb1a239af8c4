"""Per-group operators written as aggregates, not whole-partition windows.

A window over ``partitionBy(keys)`` sends every row of a key to one task; if
one key holds a third of the data, that task does a third of the work.  The
operators here aggregate first (partial aggregation shrinks a hot key to one
row per map task) and, where rows must keep their group value, join the
small per-group result back with a null-safe equi-join that AQE can split
when it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.aggregates import order_key
from limnos.operators.joins import join_ns
from limnos.session import materialize

_ORDERABLE_SKIP = ("map<", "variant")


def group_values(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Add per-group aggregates to every row (``mutate(.by = keys)``)."""
    g = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_ns(df, g, keys, "inner")


def any_in_group(df: DataFrame, flag: str, keys: list[str], name: str) -> DataFrame:
    """``mutate(name = any(flag), .by = keys)``."""
    return group_values(df, keys, {name: F.bool_or(F.col(flag))})


def count_in_group(df: DataFrame, col: str | None, keys: list[str], name: str) -> DataFrame:
    """Non-missing count of ``col`` (or rows, when None) on every row."""
    c = F.count(F.col(col)) if col else F.count(F.lit(1))
    return group_values(df, keys, {name: c})


def duplicated(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows whose key occurs more than once (``filter(n() > 1, .by = keys)``)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
    return join_ns(df, g, keys, "inner")


def singletons(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs exactly once (``filter(n() == 1, .by = keys)``)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == 1)
    return join_ns(df, g.drop("__n"), keys, "left_semi")


def keep_first(df: DataFrame, keys: list[str], order: list = (), desc: tuple = (), columns: list | None = None) -> DataFrame:
    """``distinct(keys, .keep_all = TRUE)`` after ``arrange(order)``.

    One row per key: the first in the declared order, then every other
    column as tie-break, so the choice is deterministic.  A sort aggregate of
    ``min(struct)`` (``min_by`` for computed, descending or unordered columns), with
    partial aggregation before the shuffle.

    ``columns``: those wanted besides the keys.  Columns compared only after all of them
    cannot change their values on the first row, so these are neither read nor returned.
    """
    kinds = dict(df.dtypes)
    computed = any(not isinstance(c, str) for c in order)   # may read any column
    if columns is not None and not computed and not any(kinds[c].startswith(_ORDERABLE_SKIP) for c in columns if c in kinds):
        named = [c for c in order if isinstance(c, str)]
        placed = list(dict.fromkeys([*named, *(c for c in df.columns if c not in keys)]))
        last = max((placed.index(c) for c in [*named, *columns] if c in placed), default=-1)
        df = df.select(*[c for c in df.columns if c in keys or c in placed[:last + 1]])
        kinds = dict(df.dtypes)
        if set(df.columns) == set(keys):
            return df.distinct()
    ties = [c for c in df.columns if c not in keys and not kinds[c].startswith(_ORDERABLE_SKIP)]
    plain = [c for c in dict.fromkeys([*order, *ties]) if isinstance(c, str) and c in kinds and c not in desc]
    if len(plain) < len(dict.fromkeys([*order, *ties])) or len(ties) + len(keys) < len(df.columns):
        # computed or descending keys, or columns that cannot be compared
        ok = order_key(*order, *ties, desc=desc)
        row = F.struct(*[F.col(c) for c in df.columns])
        return (df.groupBy(*keys).agg(F.min_by(row, ok).alias("__row"))
                  .select(*[F.col("__row")[c].alias(c) for c in df.columns]))
    # the row itself, its columns in order of comparison, holds each value once
    row = F.struct(*[x for c in plain for x in (F.col(c).isNull().alias(f"na_{c}"), F.col(c))])
    first = df.groupBy(*keys).agg(F.min(row).alias("__row"))
    return first.select(*[F.col(c) if c in keys and c not in plain else F.col("__row")[c].alias(c) for c in df.columns])


def top_n_with_ties(df: DataFrame, col: str, n: int) -> DataFrame:
    """``slice_max(col, n = n)``: every row at or above the n-th largest value.

    The n-th value comes from a per-partition top-n merged on the driver side
    of a scalar subquery (n values, not the data); the filter is then local.
    """
    nth = (df.where(F.col(col).isNotNull()).select(col).orderBy(F.desc(col)).limit(n)
             .agg(F.min(col)))
    return df.where(F.col(col) >= nth.scalar())


def dense_group_id(df: DataFrame, keys: list[str], name: str = "group_id",
                   partitions: int | None = None) -> DataFrame:
    """``cur_group_id()``: 1-based rank of each key in sorted order (NA last).

    Distinct keys are range-partitioned; each range is numbered locally and
    shifted by the sizes of the ranges before it.  No task ever holds more
    than one range, unlike ``dense_rank()`` over an unpartitioned window.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(k).asc_nulls_last() for k in keys]
    # written once: range bounds are sampled per execution, so both uses below
    # must read one and the same assignment of keys to ranges
    k = materialize(df.select(*keys).distinct().repartitionByRange(n, *sort_cols)
                    .withColumn("__p", F.spark_partition_id()))
    sizes = k.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    offsets = sizes.select(
        "__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__off"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*sort_cols))
    ids = (k.withColumn("__r", local).join(F.broadcast(offsets), "__p")
            .select(*keys, (F.col("__r") + F.col("__off")).alias(name)))
    return join_ns(df, ids, keys, "inner")
