"""Loading the given tables and evaluating stand-in SQL in either engine.

Stand-in SQL maps the given tables to the shapes the jobs read (station
lists, visit exports, logger files, polygon layers, land-cover cells).  It is
written in the common subset of Spark SQL and DuckDB, with ``{table}``
placeholders, so the Spark query and its DuckDB oracle start from identical
inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  The setting ``spark.limnos.scanPartitions``, unset by
    default, deals every scan over that many tasks; local runs and the bench
    set it, since their tables are single files that do not split."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get("spark.limnos.scanPartitions", "")
    return df.repartition(int(parts)) if parts else df


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Evaluate stand-in SQL on Spark over the parquet tables it names."""
    names = sorted(set(_PLACEHOLDER.findall(sql)))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck_sql(sql: str) -> str:
    """The same stand-in SQL for DuckDB (tables are registered views)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), sql)
