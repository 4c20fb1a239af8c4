"""Baseline field visits joined with streamflow, validity by station-year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import (as_long, as_numeric, calendar_columns,
                              sentence_case, squish, unit_label)
from limnos.functions.datetimes import with_flexible_datetime
from limnos.operators.aggregates import any_present
from limnos.operators.groups import keep_first
from limnos.operators.joins import anti_join_ns, natural_left_join, semi_join_ns

# Export column -> job column, in output order.
OBS_COLUMNS = {
    "fieldwork_seq_no": "fsn", "start_datetime": "datetime", "station_id": "station_id",
    "primary_station_name": "station_name", "latitude": "latitude", "longitude": "longitude",
    "wbic": "wbic", "official_waterbody_name": "waterbody",
    "station_type_code": "station_type_code", "ambient_air_temp": "air_temp",
    "ambient_air_temp_units": "air_temp_units", "water_temp": "water_temp",
    "water_temp_units": "water_temp_units", "do_mg": "d_o", "do_pct": "d_o_percent_saturation",
    "ph": "ph", "specific_cond": "specific_cond", "transparency_avg": "transparency",
    "transparency_tube_length": "transparency_tube_length",
    "weather_conditions": "weather_conditions", "weather_last_2_days": "weather_last_2_days",
    "current_stream_condition": "current_stream_condition", "group_desc": "group_desc",
    "fieldwork_comment": "fieldwork_comments", "additional_comments": "additional_comments",
}
FLOW_COLUMNS = {
    "fieldwork_seq_no": "fsn", "start_datetime": "datetime", "station_id": "station_id",
    "primary_station_name": "station_name", "latitude": "latitude", "longitude": "longitude",
    "wbic": "wbic", "official_waterbody_name": "waterbody",
    "station_type_code": "station_type_code", "stream_width": "stream_width",
    "average_stream_depth": "average_stream_depth",
    "average_surface_velocity": "average_surface_velocity",
    "stream_flow_cfs": "entered_streamflow", "calculated_streamflow_cfs": "calculated_streamflow",
    "calculated_corrected_streamflow_cfs": "corrected_streamflow",
    "flow_method_used": "flow_method_used",
}
# Measures, text and key columns of the visit exports, their units
# and the first day taken.
OBS_MEASURES = ["air_temp", "water_temp", "d_o", "d_o_percent_saturation", "ph", "specific_cond",
                "transparency", "transparency_tube_length"]
FLOW_MEASURES = ["stream_width", "average_stream_depth", "average_surface_velocity",
                 "entered_streamflow", "calculated_streamflow", "corrected_streamflow"]
TEXT_FIELDS = ["weather_last_2_days", "additional_comments", "fieldwork_comments"]
ID_FIELDS = ["fsn", "station_id", "wbic"]
KEY_VARS = ["air_temp", "water_temp", "d_o", "ph", "specific_cond", "transparency", "streamflow"]
UNITS = [("d_o", "mg/L"), ("transparency", "cm"), ("stream_width", "ft"),
         ("average_stream_depth", "ft"), ("average_surface_velocity", "ft/s"),
         ("streamflow", "cfs")]
START = "2015-01-01 00:00:00"
# What both exports hold: the keys of their join
SHARED = [c for c in [*OBS_COLUMNS.values(), "date"] if c in [*FLOW_COLUMNS.values(), "date"]]


def _coords(df: DataFrame) -> DataFrame:
    return df.withColumns({"latitude": as_numeric("latitude"), "longitude": as_numeric("longitude")})


def _with_date(df: DataFrame) -> DataFrame:
    cols = df.columns
    i = cols.index("datetime") + 1
    return df.withColumn("date", F.to_date("datetime")).select(*cols[:i], "date", *cols[i:])


def _shared_and(columns: list | None) -> list | None:
    return None if columns is None else [*SHARED, *columns]


def baseline_obs(raw: DataFrame, columns: list | None = None) -> DataFrame:
    """Typed, cleaned visits from the all-text export; first visit per
    (fsn, station, date) in time order.  ``columns``: those wanted, when not all
    (``keep_first``); those shared with the flow visits always stay."""
    df = raw.select(*[F.col(src).alias(dst) for src, dst in OBS_COLUMNS.items()])
    # the time first: rows before the first day need no cleaning
    df = with_flexible_datetime(df, "datetime", "datetime", "ymdHMp", filtered=True)
    df = df.where(F.col("datetime") >= F.lit(START).cast("timestamp_ntz"))
    df = df.withColumns({
        **{c: as_numeric(c) for c in OBS_MEASURES},
        **{c: squish(c) for c in TEXT_FIELDS},
        "weather_conditions": F.regexp_replace("weather_conditions", "_", " "),
        **{c: as_long(c) for c in ID_FIELDS},
    })
    # sentence case reads its input several times: give it a staged column
    df = df.withColumns({c: sentence_case(c) for c in [*TEXT_FIELDS, "weather_conditions"]})
    df = _with_date(_coords(df))
    return keep_first(df, ["fsn", "station_id", "date"], order=["datetime"], columns=_shared_and(columns))


def flow_obs(raw: DataFrame, position: str | None = None, columns: list | None = None) -> DataFrame:
    """Typed flow visits; streamflow = entered, else corrected, else calculated.

    One row per visit: the first in the files when ``position`` names the column
    that ``read_delimited`` gave, else the first in time (tables have no row order).
    ``columns`` as for ``baseline_obs``.
    """
    df = raw.select(*[F.col(src).alias(dst) for src, dst in FLOW_COLUMNS.items()], *[position] * bool(position))
    df = with_flexible_datetime(df, "datetime", "datetime", "ymdHMp")
    df = df.withColumns({
        **{c: as_long(c) for c in ID_FIELDS},
        **{c: as_numeric(c) for c in FLOW_MEASURES},
    })
    df = _with_date(_coords(df))
    cols = df.columns
    i = cols.index("entered_streamflow")
    df = df.withColumn("streamflow", F.coalesce("entered_streamflow", "corrected_streamflow",
                                                "calculated_streamflow"))
    df = df.select(*cols[:i], "streamflow", *cols[i:])
    first = keep_first(df, ["fsn", "station_id", "date"], order=[position or "datetime"], columns=_shared_and(columns))
    return first.drop(position) if position else first


def add_units(df: DataFrame, col: str, unit: str) -> DataFrame:
    """``add_units``: a ``<col>_units`` column right after ``col``."""
    cols = df.columns
    i = cols.index(col) + 1
    return (df.withColumn(f"{col}_units", unit_label(col, unit))
              .select(*cols[:i], f"{col}_units", *cols[i:]))


def baseline_data(obs: DataFrame, flow: DataFrame) -> DataFrame:
    """Natural, NA-matching left join on the ten shared keys, calendar
    columns, unit labels, comments moved last."""
    df = natural_left_join(obs, flow)
    cols = df.columns
    i = cols.index("date") + 1
    cal = calendar_columns("date")
    df = df.withColumns(cal).select(*cols[:i], *cal.keys(), *cols[i:])
    for c, u in UNITS:
        df = add_units(df, c, u) if c in df.columns else df
    comments = [c for c in df.columns if "_comment" in c]
    return df.select(*[c for c in df.columns if c not in comments], *comments)


def valid_fsn(data: DataFrame) -> DataFrame:
    """fsn of every visit in a station-year where at least one visit has a
    key measurement (a station-year flag, aggregated, not windowed)."""
    good_years = (data.groupBy("station_id", "year").agg(any_present(*KEY_VARS).alias("valid_year"))
                      .where("valid_year"))
    # once each: a visit id on many rows is no larger on the joins' build side
    return semi_join_ns(data.select("station_id", "year", "fsn").distinct(), good_years,
                        ["station_id", "year"]).select("fsn").distinct()


def baseline_final(data: DataFrame) -> DataFrame:
    return semi_join_ns(data, valid_fsn(data), ["fsn"])


def baseline_rejected(data: DataFrame) -> DataFrame:
    return anti_join_ns(data, valid_fsn(data), ["fsn"])
