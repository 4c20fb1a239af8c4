"""Quality-control reports (tallies, missing stations, duplicates)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.aggregates import count_of_counts
from limnos.operators.groups import dense_group_id, duplicated, singletons
from limnos.operators.joins import anti_join_ns, semi_join_ns
from limnos.operators.sets import bind_rows, pivot_counts
from limnos.plans.nutrient import tp_value
from limnos.plans.stations import STATION_COLS


def loggers_per_year(hobo_data: DataFrame) -> DataFrame:
    """``count(logger_sn, year) %>% count(year)``."""
    return count_of_counts(hobo_data, ["logger_sn", "year"], ["year"])


def station_tally(data: DataFrame) -> DataFrame:
    """Visits per station attribute set (``count(across(any_of(...)))``)."""
    keys = [c for c in STATION_COLS if c in data.columns]
    return data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def visits_per_year(data: DataFrame) -> DataFrame:
    """Visits per station and year."""
    return data.groupBy("station_id", "year").agg(F.count(F.lit(1)).alias("n"))


def missing_from_list(stations: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Station ids of the data tables that the station list lacks:
    (station_id, source, n rows)."""
    counts = [df.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
              .select("station_id", F.lit(name).alias("source"), "n") for name, df in tables.items()]
    return anti_join_ns(reduce(DataFrame.unionByName, counts), stations, ["station_id"])


def duplicate_coordinates(lists: dict[str, DataFrame]) -> DataFrame:
    """Stations sharing exact coordinates (NA pairs group together), per list."""
    cols = ["station_id", "station_name", "latitude", "longitude"]
    parts = [duplicated(df, ["latitude", "longitude"], name="n_at_site")
             .select(F.lit(name).alias("list"), *cols, "n_at_site") for name, df in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def data_at_duplicates(data: DataFrame, stations: DataFrame) -> DataFrame:
    """The data rows of stations that share their coordinates with another station
    of the list (which holds every station's attribute rows)."""
    twins = duplicated(stations, ["latitude", "longitude"]).select("station_id").distinct()
    return semi_join_ns(data, twins, ["station_id"])


def samples_of_year(samples: DataFrame, year: int, col: str = "start_date_time") -> DataFrame:
    """Samples taken in one calendar year (a missing time is in none)."""
    return samples.where(F.year(col) == year)


def combined_samples(*sources: DataFrame, value: str = "result_value_no") -> DataFrame:
    """Stack sample exports; "ND" -> 0, missing results -> 0."""
    df = bind_rows(*sources)
    return df.withColumn(value, F.coalesce(tp_value(value), F.lit(0.0)))


def duplicate_samples(samples: DataFrame, keys: list[str], id_col: str = "dupe_id") -> DataFrame:
    """Samples whose key repeats, numbered by key group (``cur_group_id``)."""
    dups = duplicated(samples, keys, name="__n").drop("__n")
    return dense_group_id(dups, keys, id_col)


def unique_samples(samples: DataFrame, keys: list[str], source_col: str = "source",
                   source: str | None = None) -> DataFrame:
    out = singletons(samples, keys)
    return out if source is None else out.where(F.col(source_col) == source)


def samples_by_source(samples: DataFrame, keys: list[str], source_col: str,
                      sources: list[str]) -> DataFrame:
    """Counts per key and source, one column per source."""
    return pivot_counts(samples, keys, source_col, sources)
