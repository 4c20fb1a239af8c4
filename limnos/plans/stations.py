"""Station lists (T1 master list, T9 final list with watershed attributes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import clean_station_name
from limnos.operators.joins import semi_join_ns
from limnos.operators.sets import prioritized_union, union_distinct

# The station attribute columns, in output order.
STATION_COLS = ["station_id", "station_name", "latitude", "longitude", "wbic", "waterbody",
                "station_type_code"]


def station_master(master: DataFrame, extra: DataFrame | None = None,
                   order: list = ()) -> DataFrame:
    """Master list plus extra stations; clean names; first row per id
    (master before extra, then ``order``); then drop stations without id or
    coordinates.  Dedup comes first, as in the reference, so a first row
    without coordinates removes the station."""
    sources = [_clean(master)] + ([_clean(extra)] if extra is not None else [])
    first = prioritized_union(sources, ["station_id"], order=order)
    return first.na.drop(subset=["station_id", "latitude", "longitude"]).select(*STATION_COLS)


def _clean(df: DataFrame) -> DataFrame:
    cols = [c for c in STATION_COLS if c in df.columns]
    return df.select(*cols).withColumn("station_name", clean_station_name("station_name"))


def station_attributes(df: DataFrame) -> DataFrame:
    """Distinct station attribute rows present in a data table."""
    return df.select(*[c for c in STATION_COLS if c in df.columns]).distinct()


def station_list(master: DataFrame, *sources: DataFrame) -> DataFrame:
    """T9 first half: prioritised union (master, then each data source's
    station attributes); rows lacking id or coordinates are dropped first."""
    parts = [d.select(*[c for c in STATION_COLS if c in d.columns]) for d in (master, *sources)]
    parts = [p.na.drop(subset=["station_id", "latitude", "longitude"]) for p in parts]
    out = prioritized_union(parts, ["station_id"])
    return out.withColumn("station_name", clean_station_name("station_name")).select(*STATION_COLS)


def stations_in_use(stations: DataFrame, *data: DataFrame) -> DataFrame:
    """Keep stations whose id occurs in any data table (``%in%`` over the
    union of ids, NA removed)."""
    keep = union_distinct(list(data), "station_id")
    return semi_join_ns(stations, keep, ["station_id"])
