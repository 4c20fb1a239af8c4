"""Total phosphorus from three source shapes, deduplicated across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import as_long, as_numeric, month_name, parse_flexible, title_case  # noqa: F401
from limnos.functions.datetimes import with_flexible_datetime
from limnos.operators.groups import count_in_group, keep_first, top_n_with_ties
from limnos.operators.joins import natural_left_join
from limnos.session import materialize
from limnos.operators.sets import bind_rows

# The phosphorus parameter code and the plausibility cut-offs.
TP_PARAMETER = "665"
MAX_YEAR_EXCLUSIVE = 2025
MAX_TP = 5.0

PROGRAM_COLUMNS = {
    "fieldwork_seq_no": "fsn", "station_id": "station_id",
    "primary_station_name": "station_name", "calc_ll_lat_dd_amt": "latitude",
    "calc_ll_long_dd_amt": "longitude", "wbic": "wbic",
    "official_waterbody_name": "waterbody", "station_type_code": "station_type_code",
    "collector_name": "volunteer_name", "start_date_time": "datetime", "result_value_no": "tp",
}
PARTNER_COLUMNS = {
    "fieldwork_seq_no": "fsn", "sample_start_date_time": "datetime", "station_id": "station_id",
    "collector_name": "volunteer_name", "result_value_no": "tp",
}
AGENCY_COLUMNS = {
    "fieldwork_seqno": "fsn", "start_date_time": "datetime",
    "fieldwork_station_id": "station_id", "data_collector": "volunteer_name", "result": "tp",
}


def tp_value(c) -> F.Column:
    """``as.numeric(gsub("ND", 0, x))``: every "ND" substring becomes 0."""
    return as_numeric(F.regexp_replace(F.col(c), "ND", "0"))


def _select(raw: DataFrame, mapping: dict) -> DataFrame:
    return raw.select(*[F.col(s).alias(d) for s, d in mapping.items()])


def tp_program(raw: DataFrame) -> DataFrame:
    """Program export: datetime already typed, coordinates numeric."""
    df = _select(raw, PROGRAM_COLUMNS).na.drop(subset=["tp"])
    return df.withColumns({"tp": tp_value("tp"), "fsn": as_long("fsn"),
                           "station_id": as_long("station_id"), "wbic": as_long("wbic"),
                           "latitude": as_numeric("latitude"),
                           "longitude": as_numeric("longitude"),
                           "datetime": F.col("datetime").cast("timestamp_ntz")})


def tp_partner(raw: DataFrame, stations: DataFrame) -> DataFrame:
    """Partner export: text datetimes (month day year, 12-hour clock);
    station attributes from the station list."""
    df = _select(raw, PARTNER_COLUMNS).na.drop(subset=["tp"])
    df = df.withColumns({"tp": tp_value("tp"), "fsn": as_long("fsn"),
                         "station_id": as_long("station_id")})
    df = with_flexible_datetime(df, "datetime", "datetime", "mdyHMSp")
    return natural_left_join(df, stations)


def tp_agency(raw: DataFrame, stations: DataFrame) -> DataFrame:
    """Agency export: keep the phosphorus parameter only."""
    df = raw.where(F.col("sample_dnr_parameter") == TP_PARAMETER)
    df = _select(df, AGENCY_COLUMNS).na.drop(subset=["tp"])
    df = df.withColumns({"tp": tp_value("tp"), "fsn": as_long("fsn"),
                         "station_id": as_long("station_id")})
    df = with_flexible_datetime(df, "datetime", "datetime", "mdyHMSp")
    return natural_left_join(df, stations)


def tp_data(*sources: DataFrame, columns: list | None = None) -> DataFrame:
    """Stack the sources, first source wins per (station, datetime, tp);
    calendar columns; observations per station-year; years before 2025.
    ``columns``: those of the sources that are wanted, when not all (``keep_first``)."""
    ranked = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    df = bind_rows(*ranked).withColumn("volunteer_name", title_case("volunteer_name"))
    # read twice below (rows and their counts): worked once.  The calendar columns
    # follow from the key, so they do not travel with the rows
    keys = ["station_id", "datetime", "tp"]
    df = keep_first(df, keys, order=["__src"], columns=columns).drop("__src")
    df = materialize(df if columns is None else df.select(*[c for c in df.columns if c in keys or c in columns]))
    df = df.withColumn("date", F.to_date("datetime")).withColumn("year", F.year("date"))
    # the filter is on the group's key, so it may come before the count
    columns = [*df.columns, "month", "month_name", "num_obs"]
    df = count_in_group(df.drop("date").where(F.col("year") < MAX_YEAR_EXCLUSIVE), "tp", ["year", "station_id"], "num_obs")
    df = df.withColumn("date", F.to_date("datetime"))
    return df.withColumns({"month": F.month("date"), "month_name": month_name("date")}).select(*columns)


def tp_final(data: DataFrame) -> DataFrame:
    return data.drop("datetime").where(F.col("tp") < MAX_TP)


def tp_top(data: DataFrame, n: int = 5) -> DataFrame:
    """``slice_max(tp, n = 5)``: the n largest values with ties."""
    return top_n_with_ties(data, "tp", n)


def tp_map_colour_value(data: DataFrame) -> DataFrame:
    """The map colour scale value ``log1p(tp * 1000 + 1)``."""
    return data.withColumn("tp_scale", F.log1p(F.col("tp") * 1000 + 1))
