"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) for every id in edges (a, b).

    Each round takes the smallest label among neighbours, hooks whole labels
    onto it and jumps one pointer; rounds grow with the logarithm of the
    longest path.  Every round is a written table, and no group is collected:
    the per-id minimum is an aggregate, joined back.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .where(F.col("a") != F.col("b")).distinct(), "edges")
    label = both.groupBy("a").agg(F.min("b").alias("m")) \
        .select(F.col("a").alias("id"), F.least("a", "m").alias("comp"))
    label = stored(label, "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b") \
            .groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        seen = label.join(near, "id").select("id", "comp", F.least("comp", "m").alias("new"))
        hook = seen.groupBy("comp").agg(F.min("new").alias("root"))
        hooked = seen.join(hook, "comp").select("id", F.col("comp").alias("old"), F.col("root").alias("comp"))
        hooked = stored(hooked, "labels")
        jump = hooked.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        label = stored(hooked.join(jump, "comp", "left").select(
            "id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        if label.where(F.col("old") != F.col("comp")).limit(1).count() == 0:
            return label.select("id", "comp")
        label = label.select("id", "comp")
