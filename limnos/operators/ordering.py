"""Sorting (NA last, as R's ``arrange``), natural file order, repeatable picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.session import materialize


def arrange(df: DataFrame, *cols, desc: tuple = ()) -> DataFrame:
    """``arrange(a, desc(b))``: NA last in both directions.  Use at sinks only."""
    return df.orderBy(*_keys(cols, desc))


def natural_path_order(path) -> Column:
    """``files[order(nchar(files), files)]``: shorter names first, then text."""
    p = F.col(path) if isinstance(path, str) else path
    return F.struct(F.length(p).alias("len"), p.alias("path"))


def numbered(df: DataFrame, *cols, desc: tuple = (), name: str = "row", partitions: int | None = None) -> DataFrame:
    """The rows with their 1-based number in ``arrange`` order, without one task
    that holds them all.

    Rows are range-partitioned by the sort keys (every other comparable column
    breaks ties, so equal keys spread too), numbered within their range and
    shifted by the sizes of the ranges before.  The offset table has a row a range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)
    ties = [c for c in df.columns if c not in cols and not kinds[c].startswith(("map<", "variant"))]
    keys = _keys([*cols, *ties], desc)
    # written once: range bounds are sampled per execution
    ranged = materialize(df.repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    offsets = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__off"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    placed = ranged.withColumn("__r", local).join(F.broadcast(offsets), "__p")
    return placed.select(*df.columns, (F.col("__r") + F.col("__off")).alias(name))


def _keys(cols, desc: tuple = ()) -> list[Column]:
    return [F.col(c).desc_nulls_last() if c in desc else F.col(c).asc_nulls_last() for c in cols]


def nth_largest(df: DataFrame, col: str, n: int) -> int:
    """The n-th largest value of a column of non-negative integers (n from 1 on; the smallest, if there are fewer).

    Selection by digits of 16 bits, from the highest: four counts of at most
    65,536 rows each, whatever n and the table's size.
    """
    prefix, left = 0, n
    for shift in (48, 32, 16, 0):
        part = df.where(F.shiftright(col, shift + 16) == prefix) if shift < 48 else df
        digits = part.where(F.col(col).isNotNull()).groupBy(F.shiftright(col, shift).alias("d")).count().collect()
        for d, count in sorted(((r["d"], r["count"]) for r in digits), reverse=True):
            prefix = d
            if count >= left:
                break
            left -= count
    return prefix


def pick_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``sample(keys, n)`` made repeatable: the n keys with the smallest
    seeded SHA-256 (of the seed and the key's text, so any engine picks the same).
    The top-n runs per partition before merging n rows."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return (keys.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256))
                .orderBy("__h", key).limit(n).drop("__h"))
