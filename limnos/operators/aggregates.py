"""Aggregates with R's NA rules; all are declarative Spark aggregates, so
they run as partial (map-side) + final hash aggregation and a hot group key
is pre-reduced on every map task before the shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.util import as_col


def strict(fn, c) -> Column:
    """``fn(x)`` without ``na.rm``: NULL as soon as one input is NULL."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), fn(c))


def strict_min(c) -> Column:
    return strict(F.min, c)


def strict_max(c) -> Column:
    return strict(F.max, c)


def strict_mean(c) -> Column:
    return strict(F.avg, c)


def strict_sum(c) -> Column:
    return strict(F.sum, c)


def n_distinct_na(c) -> Column:
    """``n_distinct``: NA counts as one more value."""
    c = as_col(c)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def order_key(*cols, desc: tuple = ()) -> Column:
    """A struct that sorts like R's ``arrange``: NA last in each key.

    ``desc`` names numeric keys to sort descending (negated).
    """
    fields = []
    for i, c in enumerate(cols):
        name = c if isinstance(c, str) else None
        c = as_col(c)
        if name is not None and name in desc:
            c = -c
        fields += [c.isNull().alias(f"n{i}"), c.alias(f"v{i}")]
    return F.struct(*fields)


def first_by(c, *order, desc: tuple = ()) -> Column:
    """``first(x)`` after ``arrange(order)``: the value on the first row, NA
    payloads included."""
    return F.min_by(as_col(c), order_key(*order, desc=desc))


def any_present(*cols) -> Column:
    """``sum(!is.na(value)) > 0`` over several measure columns at once."""
    present = [as_col(c).isNotNull() for c in cols]
    return F.bool_or(present[0] if len(present) == 1 else F.greatest(*present))


def count_of_counts(df: DataFrame, inner: list[str], outer: list[str]) -> DataFrame:
    """``count(a, b) %>% count(b)``."""
    return df.groupBy(*inner).count().groupBy(*outer).count()


def histogram(df: DataFrame, c: str, width: float, origin: float = 0.0,
              sqrt_scale: bool = False, name: str = "bin") -> DataFrame:
    """Fixed-width bins (optionally on sqrt(x)); one row per non-empty bin."""
    x = F.sqrt(F.col(c)) if sqrt_scale else F.col(c)
    b = F.floor((x - origin) / width)
    return (df.where(F.col(c).isNotNull())
              .groupBy(b.alias(name)).agg(F.count(F.lit(1)).alias("n"))
              .withColumns({"bin_lo": F.col(name) * width + origin,
                            "bin_hi": (F.col(name) + 1) * width + origin}))


def pretty_breaks(lo: float, hi: float, n: int) -> list[float]:
    """About n round intervals that cover [lo, hi], as R's ``pretty``: the step is
    1, 2, 5 or 10 times a power of ten, the largest whose predecessor is too
    small for (hi - lo) / n by R's default bias."""
    span = hi - lo
    cell = span / n if span > 0 else max(abs(hi), 1e-300) / 10
    base = 10.0 ** math.floor(math.log10(cell))
    # The points where the default bias takes the next larger step
    step = base * next((s for s, top in ((1, 1.4), (2, 2.8), (5, 7.0)) if cell <= top * base * (1 + 1e-10)), 10)
    first, last = math.floor(lo / step + 1e-10), math.ceil(hi / step - 1e-10)
    if first == last:
        last += 1
    return [k * step for k in range(int(first), int(last) + 1)]


def auto_histogram(df: DataFrame, c: str, name: str = "bin") -> DataFrame:
    """A15 as ``hist(x)`` draws it: Sturges' number of classes, pretty breaks, bins
    closed on the right (the first on both sides); a row per bin, empty ones too.

    One aggregate gives the count and range; the bins are a short list, so their
    counts come back by one group-by on the bin number.
    """
    spark = df.sparkSession
    x = F.col(c).cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x))
    total, lo, hi = known.agg(F.count("*"), F.min(x), F.max(x)).first()
    fields = f"{name} long, bin_lo double, bin_hi double"
    if not total:
        return spark.createDataFrame([], fields + ", n long")
    breaks = pretty_breaks(lo, hi, math.ceil(math.log2(total) + 1))
    step = breaks[1] - breaks[0]
    # R's fuzz: a value that rounding puts a hair above a break belongs to it
    above = sum((F.when(x > b + 1e-7 * step, 1).otherwise(0) for b in breaks[1:-1]), F.lit(0))
    counts = known.groupBy(above.cast("long").alias(name)).agg(F.count("*").alias("n"))
    bins = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(breaks, breaks[1:]))], fields)
    return bins.join(F.broadcast(counts), name, "left").na.fill(0, ["n"])
