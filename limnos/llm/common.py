"""Shared pieces of the corpus operators: inputs, the shared scratch folder, word and span columns."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.session import intermediate_path

# White space of the word rule `[^\x20\x09-\x0D]+`, as a Java character class.
WS = "[ \\t\\n\\x0B\\f\\r]"

BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Prepare a session: send the package to the executors' Python workers
    (once per context), so that a cluster needs no copy of it."""
    # Arrow batches are bounded by rows only; texts may be very long
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_limnos_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="limnos-zip-"), "limnos.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._limnos_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (spark.checkpoint.dir), on record for
    ``limnos.session.release``."""
    return intermediate_path(spark, f"llm-{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet to the shared folder and continue from the table:
    cuts the lineage, and every later read sees the same rows even when an
    executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def marked(docs: DataFrame, rows: DataFrame, key: Column, how: str, **values: str) -> DataFrame:
    """``docs`` joined to ``rows`` (doc_id, th and the columns named in ``values``)
    on doc_id and the key (hash of the text).  All columns of docs travel in
    one struct, ``row``, so none can clash with another, whatever its name."""
    left = docs.select(F.col("doc_id").alias("i"), key.alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    right = rows.select(F.col("doc_id").alias("j"), F.col("th").alias("g"), *[F.col(c).alias(n) for n, c in values.items()])
    return left.join(right, F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("g")), how)
