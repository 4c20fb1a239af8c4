"""DuckDB oracles: for each registered query, the same result in plain SQL.

The stand-in inputs are the shared SQL from ``standins``; the job logic is
restated here with window functions, QUALIFY and explicit null-safe
comparisons, independent of the Spark implementation.
"""

from __future__ import annotations

import math

from limnos.catalog import duck as D
from limnos.catalog import standins as S
from limnos.catalog.tables import duck_sql

NL = " IS NOT DISTINCT FROM "


def _cte(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({duck_sql(v)})" for k, v in parts.items())


# --- stations (T1) ---------------------------------------------------------------

STATION_CTES = {
    "st_master": S.STATIONS,
    "st_extra": S.EXTRA_STATIONS,
    "st_u": f"""
      SELECT station_id, {D.clean_station_name('station_name')} AS station_name, latitude,
             longitude, CAST(wbic AS INTEGER) AS wbic, waterbody, station_type_code, 0 AS src
      FROM st_master
      UNION ALL
      SELECT station_id, {D.clean_station_name('station_name')}, latitude, longitude,
             CAST(wbic AS INTEGER), NULL, NULL, 1 FROM st_extra""",
    "stations": f"""
      SELECT station_id, station_name, latitude, longitude, wbic, waterbody, station_type_code
      FROM (SELECT * FROM st_u QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY
            {D.order_by(['src', 'station_name', 'latitude', 'longitude', 'wbic', 'waterbody',
                         'station_type_code', 'src'])}) = 1)
      WHERE station_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL""",
}

STATION_MASTER = _cte(**STATION_CTES) + "\nSELECT * FROM stations"

# --- baseline (T2) ---------------------------------------------------------------

_OBS_TIES = ["datetime", "station_name", "latitude", "longitude", "wbic", "waterbody",
             "station_type_code", "air_temp", "air_temp_units", "water_temp", "water_temp_units",
             "d_o", "d_o_percent_saturation", "ph", "specific_cond", "transparency",
             "transparency_tube_length", "weather_conditions", "weather_last_2_days",
             "current_stream_condition", "group_desc", "fieldwork_comments", "additional_comments"]
_KEYS10 = ["fsn", "datetime", "date", "station_id", "station_name", "latitude", "longitude",
           "wbic", "waterbody", "station_type_code"]
_KEY_VARS = ["air_temp", "water_temp", "d_o", "ph", "specific_cond", "transparency", "streamflow"]

BASELINE_CTES = {
    "obs_raw": S.BASELINE_OBS,
    "obs_t": f"""
      SELECT {D.as_long('fieldwork_seq_no')} AS fsn,
             {D.parse_flexible('start_datetime', 'ymdHMp')} AS datetime,
             {D.as_long('station_id')} AS station_id, primary_station_name AS station_name,
             {D.as_numeric('latitude')} AS latitude, {D.as_numeric('longitude')} AS longitude,
             {D.as_long('wbic')} AS wbic, official_waterbody_name AS waterbody,
             station_type_code,
             {D.as_numeric('ambient_air_temp')} AS air_temp, ambient_air_temp_units AS air_temp_units,
             {D.as_numeric('water_temp')} AS water_temp, water_temp_units,
             {D.as_numeric('do_mg')} AS d_o, {D.as_numeric('do_pct')} AS d_o_percent_saturation,
             {D.as_numeric('ph')} AS ph, {D.as_numeric('specific_cond')} AS specific_cond,
             {D.as_numeric('transparency_avg')} AS transparency,
             {D.as_numeric('transparency_tube_length')} AS transparency_tube_length,
             {D.sentence_case("replace(weather_conditions, '_', ' ')")} AS weather_conditions,
             {D.sentence_case(D.squish('weather_last_2_days'))} AS weather_last_2_days,
             current_stream_condition, group_desc,
             {D.sentence_case(D.squish('fieldwork_comment'))} AS fieldwork_comments,
             {D.sentence_case(D.squish('additional_comments'))} AS additional_comments
      FROM obs_raw""",
    "obs": f"""
      SELECT * FROM (SELECT *, CAST(datetime AS DATE) AS date FROM obs_t)
      WHERE datetime >= TIMESTAMP '2015-01-01 00:00:00'
      QUALIFY row_number() OVER (PARTITION BY fsn, station_id, date
                                 ORDER BY {D.order_by(_OBS_TIES)}) = 1""",
    "flow_raw": S.BASELINE_FLOW,
    "flow_t": f"""
      SELECT {D.as_long('fieldwork_seq_no')} AS fsn,
             {D.parse_flexible('start_datetime', 'ymdHMp')} AS datetime,
             {D.as_long('station_id')} AS station_id, primary_station_name AS station_name,
             {D.as_numeric('latitude')} AS latitude, {D.as_numeric('longitude')} AS longitude,
             {D.as_long('wbic')} AS wbic, official_waterbody_name AS waterbody,
             station_type_code,
             {D.as_numeric('stream_width')} AS stream_width,
             {D.as_numeric('average_stream_depth')} AS average_stream_depth,
             {D.as_numeric('average_surface_velocity')} AS average_surface_velocity,
             {D.as_numeric('stream_flow_cfs')} AS entered_streamflow,
             {D.as_numeric('calculated_streamflow_cfs')} AS calculated_streamflow,
             {D.as_numeric('calculated_corrected_streamflow_cfs')} AS corrected_streamflow,
             flow_method_used
      FROM flow_raw""",
    "flow": """
      SELECT *, CAST(datetime AS DATE) AS date,
             coalesce(entered_streamflow, corrected_streamflow, calculated_streamflow) AS streamflow
      FROM flow_t
      QUALIFY row_number() OVER (PARTITION BY fsn, station_id, CAST(datetime AS DATE)
                                 ORDER BY datetime NULLS LAST, station_name NULLS LAST) = 1""",
    "data0": f"""
      SELECT o.*, f.stream_width, f.average_stream_depth, f.average_surface_velocity, f.streamflow,
             f.entered_streamflow, f.calculated_streamflow, f.corrected_streamflow,
             f.flow_method_used
      FROM obs o LEFT JOIN flow f ON {' AND '.join(f'o.{k}{NL}f.{k}' for k in _KEYS10)}""",
    "data": """
      SELECT *, year(date) AS year, month(date) AS month, day(date) AS day,
             dayofyear(date) AS yday,
             CASE WHEN d_o IS NULL THEN '' ELSE 'mg/L' END AS d_o_units,
             CASE WHEN transparency IS NULL THEN '' ELSE 'cm' END AS transparency_units,
             CASE WHEN stream_width IS NULL THEN '' ELSE 'ft' END AS stream_width_units,
             CASE WHEN average_stream_depth IS NULL THEN '' ELSE 'ft' END
               AS average_stream_depth_units,
             CASE WHEN average_surface_velocity IS NULL THEN '' ELSE 'ft/s' END
               AS average_surface_velocity_units,
             CASE WHEN streamflow IS NULL THEN '' ELSE 'cfs' END AS streamflow_units
      FROM data0""",
    "good_years": f"""
      SELECT station_id, year FROM data GROUP BY station_id, year
      HAVING bool_or({' OR '.join(f'{c} IS NOT NULL' for c in _KEY_VARS)})""",
    "valid_fsn": f"""
      SELECT d.fsn FROM data d
      WHERE EXISTS (SELECT 1 FROM good_years g WHERE d.station_id{NL}g.station_id
                    AND d.year{NL}g.year)""",
}


def _baseline_out(where: str) -> str:
    return (_cte(**BASELINE_CTES)
            + f"\nSELECT * REPLACE ({D.ts_text('datetime')} AS datetime, "
              f"{D.date_text('date')} AS date) FROM data d WHERE {where}")


BASELINE_FINAL = _baseline_out(f"EXISTS (SELECT 1 FROM valid_fsn v WHERE v.fsn{NL}d.fsn)")
BASELINE_REJECTED = _baseline_out(f"NOT EXISTS (SELECT 1 FROM valid_fsn v WHERE v.fsn{NL}d.fsn)")

# --- phosphorus (T3) --------------------------------------------------------------


def _tp_num(c: str) -> str:
    return D.as_numeric(f"replace({c}, 'ND', '0')")


_TP_TIES = ["src", "fsn", "station_name", "latitude", "longitude", "wbic", "waterbody",
            "station_type_code", "volunteer_name", "src", "date", "year", "month", "month_name"]
_STATION_ATTRS = "s.station_name, s.latitude, s.longitude, s.wbic, s.waterbody, s.station_type_code"

TP_CTES = {
    **STATION_CTES,
    "prog_raw": S.TP_PROGRAM,
    "part_raw": S.TP_PARTNER,
    "agen_raw": S.TP_AGENCY,
    "p1": f"""
      SELECT {D.as_long('fieldwork_seq_no')} AS fsn, {D.as_long('station_id')} AS station_id,
             primary_station_name AS station_name,
             {D.as_numeric('calc_ll_lat_dd_amt')} AS latitude,
             {D.as_numeric('calc_ll_long_dd_amt')} AS longitude,
             {D.as_long('wbic')} AS wbic, official_waterbody_name AS waterbody, station_type_code,
             collector_name AS volunteer_name, CAST(start_date_time AS TIMESTAMP) AS datetime,
             {_tp_num('result_value_no')} AS tp, 0 AS src
      FROM prog_raw WHERE result_value_no IS NOT NULL""",
    "p2": f"""
      SELECT {D.as_long('fieldwork_seq_no')} AS fsn,
             {D.parse_flexible('sample_start_date_time', 'mdyHMSp')} AS datetime,
             {D.as_long('station_id')} AS station_id, collector_name AS volunteer_name,
             {_tp_num('result_value_no')} AS tp
      FROM part_raw WHERE result_value_no IS NOT NULL""",
    "p3": f"""
      SELECT {D.as_long('fieldwork_seqno')} AS fsn,
             {D.parse_flexible('start_date_time', 'mdyHMSp')} AS datetime,
             {D.as_long('fieldwork_station_id')} AS station_id, data_collector AS volunteer_name,
             {_tp_num('result')} AS tp
      FROM agen_raw WHERE sample_dnr_parameter = '665' AND result IS NOT NULL""",
    "tp_u": f"""
      SELECT fsn, station_id, station_name, latitude, longitude, wbic, waterbody,
             station_type_code, volunteer_name, datetime, tp, src FROM p1
      UNION ALL
      SELECT p.fsn, p.station_id, {_STATION_ATTRS}, p.volunteer_name, p.datetime, p.tp, 1
      FROM p2 p LEFT JOIN stations s ON p.station_id{NL}s.station_id
      UNION ALL
      SELECT p.fsn, p.station_id, {_STATION_ATTRS}, p.volunteer_name, p.datetime, p.tp, 2
      FROM p3 p LEFT JOIN stations s ON p.station_id{NL}s.station_id""",
    "tp_c": f"""
      SELECT * REPLACE ({D.title_case('volunteer_name')} AS volunteer_name),
             CAST(datetime AS DATE) AS date, year(CAST(datetime AS DATE)) AS year,
             month(CAST(datetime AS DATE)) AS month, monthname(CAST(datetime AS DATE)) AS month_name
      FROM tp_u""",
    "tp_d": f"""
      SELECT * FROM tp_c QUALIFY row_number() OVER (PARTITION BY station_id, datetime, tp
                                                    ORDER BY {D.order_by(_TP_TIES)}) = 1""",
    "tp_data": """
      SELECT * EXCLUDE (src), count(tp) OVER (PARTITION BY year, station_id) AS num_obs
      FROM tp_d QUALIFY year < 2025""",
}

TP_FINAL = (_cte(**TP_CTES) + f"\nSELECT * EXCLUDE (datetime) REPLACE ({D.date_text('date')} AS date)"
            " FROM tp_data WHERE tp < 5")

TP_TOP5 = (_cte(**TP_CTES) + f"\nSELECT * REPLACE ({D.date_text('date')} AS date, "
           f"{D.ts_text('datetime')} AS datetime) FROM tp_data WHERE tp >= (SELECT min(tp) FROM "
           "(SELECT tp FROM tp_data WHERE tp IS NOT NULL ORDER BY tp DESC LIMIT 5))")

TP_HISTOGRAM = (_cte(**TP_CTES) + """
SELECT bin, n, round(bin * CAST(0.1 AS DOUBLE) + CAST(0.0 AS DOUBLE), 6) AS bin_lo,
       round((bin + 1) * CAST(0.1 AS DOUBLE) + CAST(0.0 AS DOUBLE), 6) AS bin_hi
FROM (SELECT CAST(floor((sqrt(tp) - CAST(0.0 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) AS BIGINT) AS bin,
             count(*) AS n
      FROM tp_data WHERE tp < 5 AND tp IS NOT NULL GROUP BY 1)""")

# --- loggers (T4-T8) ---------------------------------------------------------------

LOGGER_CTES = {
    "lg_raw": S.LOGGER_RAW,
    "lg_t": f"""
      SELECT logger_sn, unit, {D.as_numeric('raw_temp')} AS temp,
             {D.parse_exact('raw_datetime')} AS date_time FROM lg_raw""",
    "lg_t2": """
      SELECT *, CAST(date_time AS DATE) AS date, year(CAST(date_time AS DATE)) AS year,
             CASE WHEN unit = 'F' THEN temp BETWEEN 23.0 AND 86.0
                  ELSE temp BETWEEN -5.0 AND 30.0 END AS temp_ok
      FROM lg_t WHERE temp IS NOT NULL""",
    "readings": f"""
      SELECT logger_sn, date_time, date, year,
             CASE WHEN unit = 'F' THEN temp ELSE {D.r_round('temp * 1.8 + 32', 2)} END AS temp_f,
             CASE WHEN unit = 'C' THEN temp ELSE {D.r_round('(temp - 32) * 5 / 9.0', 2)} END
               AS temp_c,
             2024 AS inventory_year
      FROM lg_t2 WHERE temp_ok""",
}

INVENTORY_CTES = {
    **STATION_CTES,
    "inv_raw": S.INVENTORY,
    "inv": f"""
      SELECT i.*, s.station_name, s.latitude, s.longitude
      FROM inv_raw i LEFT JOIN stations s ON i.station_id{NL}s.station_id""",
}

TRIM_CTES = {
    **LOGGER_CTES,
    **INVENTORY_CTES,
    "trk": f"""
      SELECT r.logger_sn, r.date_time, r.date, r.year, month(r.date) AS month,
             day(r.date) AS day, hour(r.date_time) AS hour, dayofyear(r.date) AS yday,
             r.temp_f, r.temp_c, i.device_type, i.contact_name, i.date_deployed,
             i.date_removed, i.station_id, i.station_name, i.latitude, i.longitude
      FROM readings r LEFT JOIN inv i
        ON r.logger_sn{NL}i.logger_sn AND r.inventory_year{NL}i.year
      WHERE i.station_id IS NOT NULL
        AND (CASE WHEN i.date_deployed IS NOT NULL THEN r.date > i.date_deployed ELSE true END)
        AND (CASE WHEN i.date_removed IS NOT NULL THEN r.date < i.date_removed ELSE true END)""",
    "hobo": """
      SELECT * EXCLUDE (contact_name, date_deployed, date_removed) FROM trk
      WHERE NOT coalesce(logger_sn IN (7.0), false) AND station_id IS NOT NULL""",
}


def _dates_out(cols_dates=(), cols_ts=()) -> str:
    reps = [f"{D.date_text(c)} AS {c}" for c in cols_dates] + [f"{D.ts_text(c)} AS {c}"
                                                             for c in cols_ts]
    return f"* REPLACE ({', '.join(reps)})" if reps else "*"


LOGGER_READINGS = (_cte(**LOGGER_CTES)
                   + f"\nSELECT {_dates_out(['date'], ['date_time'])} FROM readings")

LOGGER_QC = _cte(**LOGGER_CTES) + """
SELECT logger_sn, count(*) AS n_obs, max(unit) AS unit,
       CASE WHEN count(date) = count(*) THEN CAST(min(date) AS VARCHAR) END AS date_min,
       CASE WHEN count(date) = count(*) THEN CAST(max(date) AS VARCHAR) END AS date_max,
       min(temp) AS temp_min, max(temp) AS temp_max,
       count(DISTINCT year) + max(CASE WHEN year IS NULL THEN 1 ELSE 0 END) AS n_years,
       CAST(count_if(coalesce(year <> 2024, true)) AS BIGINT) AS n_other_year,
       CAST(count_if(NOT temp_ok) AS BIGINT) AS n_out_of_range, CAST(count_if(date_time IS NULL) AS BIGINT) AS n_unparsed
FROM lg_t2 GROUP BY logger_sn"""

LOGGER_WARNINGS = _cte(**LOGGER_CTES) + """,
qc AS (SELECT logger_sn, count(DISTINCT year) + max(CASE WHEN year IS NULL THEN 1 ELSE 0 END) AS n_years,
              array_to_string(list_sort(list(DISTINCT CAST(year AS VARCHAR)) FILTER (WHERE year IS NOT NULL)), ', ')
                AS known_years,
              CAST(count_if(coalesce(year <> 2024, true)) AS BIGINT) AS n_other_year,
              CAST(count_if(NOT temp_ok) AS BIGINT) AS n_out_of_range FROM lg_t2 GROUP BY logger_sn)
SELECT logger_sn, 'other_year' AS code, n_other_year AS n,
       'Outside the inventory year: ' || CAST(n_other_year AS VARCHAR) || ' readings' AS message
FROM qc WHERE n_years > 1
UNION ALL
SELECT logger_sn, 'several_years', n_years, 'Readings fall in the years ' || coalesce(known_years, '')
FROM qc WHERE n_years > 1
UNION ALL
SELECT logger_sn, 'out_of_range', n_out_of_range,
       'Beyond the plausible range: ' || CAST(n_out_of_range AS VARCHAR) || ' readings dropped'
FROM qc WHERE n_out_of_range > 0"""

LOGGER_TRIMMED = (_cte(**TRIM_CTES) + "\nSELECT "
                  + _dates_out(["date"], ["date_time"]).replace("*", "* EXCLUDE (contact_name, "
                                                                 "date_deployed, date_removed)", 1)
                  + " FROM trk")

_STATUS_TIES = ["date_time", "date", "year", "month", "day", "hour", "yday", "temp_f", "temp_c",
                "device_type", "contact_name", "date_deployed", "date_removed", "station_id",
                "station_name", "latitude", "longitude"]
_FIRST = "ORDER BY " + D.order_by(_STATUS_TIES)


def _num_text(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


STATUS_CTES = {
    **TRIM_CTES,
    "before": """
      SELECT logger_sn,
             CASE WHEN count(date) = count(*) THEN min(date) END AS date_min,
             CASE WHEN count(date) = count(*) THEN max(date) END AS date_max,
             count(DISTINCT date) + max(CASE WHEN date IS NULL THEN 1 ELSE 0 END) AS days
      FROM readings GROUP BY logger_sn""",
    "after": f"""
      SELECT logger_sn, first(date_deployed {_FIRST}) AS deployed,
             first(date_removed {_FIRST}) AS removed,
             count(DISTINCT date) + max(CASE WHEN date IS NULL THEN 1 ELSE 0 END) AS clean_days,
             first(station_id {_FIRST}) AS station_id,
             {_num_text(f'first(latitude {_FIRST})')} AS latitude,
             {_num_text(f'first(longitude {_FIRST})')} AS longitude,
             first(station_name {_FIRST}) AS station_name
      FROM trk GROUP BY logger_sn""",
    "status": f"""
      SELECT b.logger_sn, b.date_min, b.date_max, b.days, a.deployed, a.removed, a.clean_days,
             b.days - a.clean_days AS days_rm,
             CASE WHEN a.station_id IS NULL THEN 'missing station id'
                  WHEN a.deployed IS NULL AND a.removed IS NULL THEN 'missing deploy/removal'
                  WHEN a.deployed IS NULL THEN 'missing deploy'
                  WHEN a.removed IS NULL THEN 'missing removal'
                  ELSE 'OK' END AS status,
             a.station_id, a.latitude, a.longitude, a.station_name
      FROM before b LEFT JOIN after a ON b.logger_sn{NL}a.logger_sn""",
}

LOGGER_STATUS = (_cte(**STATUS_CTES) + "\nSELECT "
                 + _dates_out(["date_min", "date_max", "deployed", "removed"]) + " FROM status")

LOGGER_STATUS_SUMMARY = _cte(**STATUS_CTES) + """
SELECT count(*) AS loggers, CAST(count_if(status = 'missing station id') AS BIGINT) AS missing_station_id,
       CAST(count_if(deployed IS NULL) AS BIGINT) AS missing_deployed, CAST(count_if(removed IS NULL) AS BIGINT) AS missing_removed
FROM status"""

FLAG_CTES = {
    **TRIM_CTES,
    "flagged": f"""
      SELECT i.*, coalesce(h.have_data, false) AS have_data
      FROM inv i LEFT JOIN (SELECT DISTINCT year, logger_sn, true AS have_data FROM hobo) h
        ON i.year{NL}h.year AND i.logger_sn{NL}h.logger_sn""",
}

INVENTORY_WITHOUT_DATA = (_cte(**FLAG_CTES) + "\nSELECT "
                          + _dates_out(["date_deployed", "date_removed"])
                          + " FROM flagged WHERE NOT have_data")
INVENTORY_EXPORT = (_cte(**FLAG_CTES) + "\nSELECT "
                    + _dates_out(["date_deployed", "date_removed"]).replace(
                        "*", "* EXCLUDE (have_data)", 1) + " FROM flagged WHERE have_data")

DAILY_CTES = {
    **LOGGER_CTES,
    "daily": """
      SELECT logger_sn, date,
             CASE WHEN count(temp_f) = count(*) THEN min(temp_f) END AS min,
             CASE WHEN count(temp_f) = count(*) THEN avg(temp_f) END AS mean,
             CASE WHEN count(temp_f) = count(*) THEN max(temp_f) END AS max,
             CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR AS date_time
      FROM readings GROUP BY logger_sn, date""",
}

LOGGER_DAILY = (_cte(**DAILY_CTES) + "\nSELECT " + _dates_out(["date"], ["date_time"])[:-1]
                + ", round(mean, 6) AS mean) FROM daily")

LOGGER_DAILY_RANGES = _cte(**DAILY_CTES, weather=S.WEATHER) + f""",
water AS (SELECT logger_sn, date_time, max - mean AS water_range FROM daily),
air AS (SELECT logger_sn, CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR AS date_time,
               max_temp - min_temp AS air_range FROM weather)
SELECT w.logger_sn, {D.ts_text('w.date_time')} AS date_time, round(w.water_range, 6) AS water_range,
       round(a.air_range, 6) AS air_range,
       round(CASE WHEN a.air_range = 0 THEN NULL ELSE w.water_range / a.air_range END, 6) AS ratio,
       w.water_range < a.air_range AS valid
FROM water w LEFT JOIN air a ON w.logger_sn{NL}a.logger_sn AND w.date_time{NL}a.date_time"""

_REQ_TIES = ["date_time", "date", "year", "month", "day", "hour", "yday", "temp_f", "temp_c",
             "device_type", "station_id", "station_name", "latitude", "longitude"]
_RFIRST = "ORDER BY " + D.order_by(_REQ_TIES)

WEATHER_REQUESTS = _cte(**TRIM_CTES) + f""",
req AS (SELECT logger_sn, first(latitude {_RFIRST}) AS latitude,
               first(longitude {_RFIRST}) AS longitude,
               CASE WHEN count(date) = count(*) THEN min(date) END AS start_date,
               CASE WHEN count(date) = count(*) THEN max(date) END AS end_date
        FROM hobo GROUP BY logger_sn)
SELECT logger_sn, latitude, longitude, CAST(start_date AS VARCHAR) AS start_date,
       CAST(end_date AS VARCHAR) AS end_date,
       CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL AND start_date IS NOT NULL
                 AND end_date IS NOT NULL
            THEN 'lat=' || {_num_text('latitude')} || '&long=' || {_num_text('longitude')}
                 || '&start_date=' || CAST(start_date AS VARCHAR) || '&end_date='
                 || CAST(end_date AS VARCHAR) END AS query
FROM req"""

# --- QC (T13) ----------------------------------------------------------------------

LOGGERS_PER_YEAR = _cte(**TRIM_CTES) + """
SELECT year, count(*) AS count FROM (SELECT logger_sn, year FROM hobo GROUP BY 1, 2) GROUP BY year"""

_TALLY = """
SELECT station_id, station_name, latitude, longitude, wbic, waterbody, station_type_code,
       count(*) AS n
FROM data d WHERE EXISTS (SELECT 1 FROM valid_fsn v WHERE v.fsn IS NOT DISTINCT FROM d.fsn)
GROUP BY ALL"""

BASELINE_STATION_TALLY = _cte(**BASELINE_CTES) + _TALLY
SAMPLE_CTES = {
    "prog_raw": S.SAMPLES_PROGRAM,
    "part_raw": S.SAMPLES_PARTNER,
    "samples": f"""
      SELECT source, fsn, station_id, start_date_time,
             coalesce({_tp_num('result_value_no')}, 0.0) AS result_value_no
      FROM (SELECT 'Program' AS source, fieldwork_seq_no AS fsn,
                   {D.as_long('station_id')} AS station_id,
                   CAST(start_date_time AS TIMESTAMP) AS start_date_time, result_value_no
            FROM prog_raw
            UNION ALL
            SELECT 'Partner', fieldwork_seq_no, {D.as_long('station_id')},
                   {D.parse_flexible('sample_start_date_time', 'mdyHMSp')}, result_value_no
            FROM part_raw)""",
    "cnt": """
      SELECT *, count(*) OVER (PARTITION BY start_date_time, station_id, result_value_no) AS k
      FROM samples""",
}

DUPLICATE_SAMPLES = _cte(**SAMPLE_CTES) + f"""
SELECT source, fsn, station_id, {D.ts_text('start_date_time')} AS start_date_time,
       result_value_no,
       dense_rank() OVER (ORDER BY start_date_time NULLS LAST, station_id NULLS LAST,
                          result_value_no NULLS LAST) AS dupe_id
FROM cnt WHERE k > 1"""

UNIQUE_PARTNER_SAMPLES = _cte(**SAMPLE_CTES) + f"""
SELECT source, fsn, station_id, {D.ts_text('start_date_time')} AS start_date_time,
       result_value_no
FROM cnt WHERE k = 1 AND source = 'Partner'"""

SAMPLES_BY_SOURCE = _cte(**SAMPLE_CTES) + """
SELECT station_id,
       CASE WHEN CAST(count_if(source = 'Program') AS BIGINT) > 0 THEN CAST(count_if(source = 'Program') AS BIGINT) END AS "Program",
       CASE WHEN CAST(count_if(source = 'Partner') AS BIGINT) > 0 THEN CAST(count_if(source = 'Partner') AS BIGINT) END
         AS "Partner"
FROM samples GROUP BY station_id"""


# --- spatial (T9-T12): brute force over cell centres and points --------------------

def _dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _tm_sql(lon: str, lat: str) -> tuple[str, str]:
    """Transverse Mercator forward (same published series) in DuckDB SQL."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    k0, lon0, fe, fn = 0.9996, -90.0, 520000.0, -4480000.0
    phi = f"radians({lat})"
    n = f"({a!r} / sqrt(1 - {e2!r} * pow(sin({phi}), 2)))"
    t = f"pow(tan({phi}), 2)"
    c = f"({ep2!r} * pow(cos({phi}), 2))"
    A = f"(radians({lon} - ({lon0!r})) * cos({phi}))"
    m = (f"({a!r} * (({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r}) * {phi} "
         f"- ({3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r}) * sin(2 * {phi}) "
         f"+ ({15 * e2**2 / 256 + 45 * e2**3 / 1024!r}) * sin(4 * {phi}) "
         f"- ({35 * e2**3 / 3072!r}) * sin(6 * {phi})))")
    x = (f"({k0!r} * {n} * ({A} + (1 - {t} + {c}) * pow({A}, 3) / 6 + "
         f"(5 - 18 * {t} + pow({t}, 2) + 72 * {c} - 58 * {ep2!r}) * pow({A}, 5) / 120) + {fe!r})")
    y = (f"({k0!r} * ({m} + {n} * tan({phi}) * (pow({A}, 2) / 2 + "
         f"(5 - {t} + 9 * {c} + 4 * pow({c}, 2)) * pow({A}, 4) / 24 + "
         f"(61 - 58 * {t} + pow({t}, 2) + 600 * {c} - 330 * {ep2!r}) * pow({A}, 6) / 720)) + {fn!r})")
    return x, y


def _albers_sql(lon: str, lat: str) -> tuple[str, str]:
    """Albers equal-area conic forward (EPSG:5070) in DuckDB SQL."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q_of(p: float) -> float:
        s = math.sin(p)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    p1, p2, p0 = map(math.radians, (29.5, 45.5, 23.0))
    m1, m2 = (math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2) for p in (p1, p2))
    n = (m1 ** 2 - m2 ** 2) / (q_of(p2) - q_of(p1))
    c = m1 ** 2 + n * q_of(p1)
    rho0 = a * math.sqrt(c - n * q_of(p0)) / n
    s = f"sin(radians({lat}))"
    q = (f"({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - "
         f"ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))")
    rho = f"({a!r} * sqrt({c!r} - {n!r} * {q}) / {n!r})"
    theta = f"({n!r} * radians({lon} - (-96.0)))"
    return f"({rho} * sin({theta}))", f"({rho0!r} - {rho} * cos({theta}))"


def _projected(v: str, sql) -> str:
    x, y = sql("CAST(x AS DOUBLE)", "CAST(y AS DOUBLE)")
    return f"SELECT pid, part, ring, i, {x} AS x, {y} AS y FROM {v}"


def _edges(v: str) -> str:
    return (f"SELECT a.pid, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {v} a JOIN {v} b "
            "ON a.pid = b.pid AND a.part = b.part AND a.ring = b.ring AND b.i = a.i + 1")


def _inside(px: str, py: str) -> str:
    """Ray-crossing test of point (px, py) against edge alias e."""
    return (f"(e.y1 > {py}) <> (e.y2 > {py}) AND "
            f"{px} < (e.x2 - e.x1) * ({py} - e.y1) / (e.y2 - e.y1) + e.x1")


def _raster(p: str, v: str, x0: float, y0: float, cell: float) -> dict[str, str]:
    """CTEs {p}_e (edges) and {p}_r (pid, i, j): cells whose centre is inside,
    by testing every cell of the polygon's bounding box against every edge."""
    X0, Y0, C = _dbl(x0), _dbl(y0), _dbl(cell)
    return {
        f"{p}_e": _edges(v),
        f"{p}_bb": f"SELECT pid, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy "
                   f"FROM {v} GROUP BY pid",
        f"{p}_ci": f"SELECT pid, miny, maxy, unnest(range("
                   f"CAST(floor((minx - {X0}) / {C}) AS BIGINT) - 1, "
                   f"CAST(ceil((maxx - {X0}) / {C}) AS BIGINT) + 2)) AS i FROM {p}_bb",
        f"{p}_cc": f"SELECT pid, i, unnest(range(CAST(floor((miny - {Y0}) / {C}) AS BIGINT) - 1, "
                   f"CAST(ceil((maxy - {Y0}) / {C}) AS BIGINT) + 2)) AS j FROM {p}_ci",
        f"{p}_r": f"SELECT c.pid, c.i, c.j FROM (SELECT pid, i, j, {X0} + (i + {_dbl(0.5)}) * {C} AS xc, "
                  f"{Y0} + (j + {_dbl(0.5)}) * {C} AS yc FROM {p}_cc) c JOIN {p}_e e "
                  f"ON c.pid = e.pid AND {_inside('c.xc', 'c.yc')} "
                  f"GROUP BY c.pid, c.i, c.j HAVING count(*) % 2 = 1",
    }


def _best_parent(name: str, child: str, parent: str) -> dict[str, str]:
    return {name: f"SELECT c.pid, p.pid AS parent, count(*) AS n FROM {child} c "
                  f"JOIN {parent} p ON c.i = p.i AND c.j = p.j GROUP BY c.pid, p.pid "
                  "QUALIFY row_number() OVER (PARTITION BY c.pid ORDER BY count(*) DESC, "
                  "p.pid) = 1"}


_HX0, _HY0, _HC = 200000.0, 0.0, 2000.0
HIER_CTES = {
    "v6": S.HUC6_VERTICES, "v8": S.REGION_VERTICES, "v10": S.COUNTY_VERTICES,
    "v12": S.HUC12_VERTICES,
    "a6": S.HUC6_ATTRS, "a8": S.HUC8_ATTRS, "a10": S.HUC10_ATTRS, "a12": S.HUC12_ATTRS,
    **{f"p{k}": _projected(f"v{k}", _tm_sql) for k in (6, 8, 10, 12)},
    **_raster("h6", "p6", _HX0, _HY0, _HC), **_raster("h8", "p8", _HX0, _HY0, _HC),
    **_raster("h10", "p10", _HX0, _HY0, _HC), **_raster("h12", "p12", _HX0, _HY0, _HC),
    **_best_parent("l8", "h8_r", "h6_r"), **_best_parent("l10", "h10_r", "h8_r"),
    **_best_parent("l12", "h12_r", "h10_r"),
    "w8": "SELECT a.*, p.MajorBasin FROM a8 a LEFT JOIN l8 l ON a.pid = l.pid "
          "LEFT JOIN a6 p ON l.parent = p.pid",
    "w10": "SELECT a.*, p.Huc8Code, p.Huc8Name, p.MajorBasin FROM a10 a "
           "LEFT JOIN l10 l ON a.pid = l.pid LEFT JOIN w8 p ON l.parent = p.pid",
    "w12": "SELECT a.*, p.Huc10Code, p.Huc10Name, p.Huc8Code, p.Huc8Name, p.MajorBasin "
           "FROM a12 a LEFT JOIN l12 l ON a.pid = l.pid LEFT JOIN w10 p ON l.parent = p.pid",
}


def _cte2(parts: dict[str, str]) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({duck_sql(v)})" for k, v in parts.items())


WATERSHED_HIERARCHY = _cte2(HIER_CTES) + "\nSELECT * FROM w12"

_SL_TIES = ["src", "station_name", "latitude", "longitude", "wbic", "waterbody",
            "station_type_code", "src"]


def _first_poly(name: str, pts: str, v: str) -> dict[str, str]:
    return {
        f"{name}_e": _edges(v),
        name: f"SELECT station_id, min(pid) AS pid FROM (SELECT k.station_id, e.pid "
              f"FROM {pts} k JOIN {name}_e e ON {_inside('k.longitude', 'k.latitude')} "
              "GROUP BY k.station_id, e.pid HAVING count(*) % 2 = 1) GROUP BY station_id",
    }


# the prioritised station list (master, baseline, nutrient, logger stations) and
# the part of it that any data table uses
LIST_CTES = {
    "bfinal": f"SELECT * FROM data d WHERE EXISTS (SELECT 1 FROM valid_fsn v WHERE v.fsn{NL}d.fsn)",
    "tpf": "SELECT * FROM tp_data WHERE tp < 5",
    "sl_src": """
      SELECT station_id, station_name, latitude, longitude, CAST(wbic AS BIGINT) AS wbic,
             waterbody, station_type_code, 0 AS src FROM stations
      UNION ALL
      SELECT DISTINCT station_id, station_name, latitude, longitude, CAST(wbic AS BIGINT),
             waterbody, station_type_code, 1 FROM bfinal
      UNION ALL
      SELECT DISTINCT station_id, station_name, latitude, longitude, CAST(wbic AS BIGINT),
             waterbody, station_type_code, 2 FROM tpf
      UNION ALL
      SELECT DISTINCT station_id, station_name, latitude, longitude, NULL, NULL, NULL, 3
      FROM inv WHERE station_id IS NOT NULL AND station_name IS NOT NULL
                 AND latitude IS NOT NULL AND longitude IS NOT NULL""",
    "sl_first": f"""
      SELECT * FROM sl_src
      WHERE station_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY {D.order_by(_SL_TIES)}) = 1""",
    "sl": f"""SELECT * EXCLUDE (src) REPLACE ({D.clean_station_name('station_name')} AS station_name)
              FROM sl_first""",
    "kept_ids": """
      SELECT station_id FROM data UNION SELECT station_id FROM tpf
      UNION SELECT station_id FROM hobo""",
    "kept": f"SELECT * FROM sl s WHERE EXISTS (SELECT 1 FROM kept_ids k WHERE k.station_id{NL}s.station_id)",
}

_MISSING = f"""SELECT station_id, '%s' AS source, count(*) AS n FROM %s t
WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.station_id{NL}t.station_id) GROUP BY station_id"""
_QC_CTES = {**BASELINE_CTES, **TP_CTES, **TRIM_CTES, **LIST_CTES}
STATIONS_MISSING_FROM_LIST = _cte(**_QC_CTES) + "\n" + "\nUNION ALL\n".join(
    _MISSING % x for x in (("baseline", "bfinal"), ("nutrient", "tpf"), ("logger", "hobo")))

DUPLICATE_COORDINATES = _cte(**_QC_CTES) + """
SELECT 'all' AS list, station_id, station_name, latitude, longitude, n_at_site
FROM (SELECT *, count(*) OVER (PARTITION BY latitude, longitude) AS n_at_site FROM kept) WHERE n_at_site > 1
UNION ALL
SELECT 'baseline', station_id, station_name, latitude, longitude, n_at_site
FROM (SELECT *, count(*) OVER (PARTITION BY latitude, longitude) AS n_at_site
      FROM (SELECT DISTINCT station_id, station_name, latitude, longitude, wbic, waterbody, station_type_code
            FROM bfinal)) WHERE n_at_site > 1
UNION ALL
SELECT 'nutrient', station_id, station_name, latitude, longitude, n_at_site
FROM (SELECT *, count(*) OVER (PARTITION BY latitude, longitude) AS n_at_site
      FROM (SELECT DISTINCT station_id, station_name, latitude, longitude, wbic, waterbody, station_type_code
            FROM tpf)) WHERE n_at_site > 1"""

BASELINE_VISITS_PER_YEAR = _cte(**BASELINE_CTES) + f"""
SELECT station_id, year, count(*) AS n FROM data d
WHERE EXISTS (SELECT 1 FROM valid_fsn v WHERE v.fsn{NL}d.fsn) GROUP BY station_id, year"""

STATION_WATERSHEDS = _cte2({
    **BASELINE_CTES, **TP_CTES, **TRIM_CTES, **HIER_CTES, **LIST_CTES,
    "vc": S.COUNTY_VERTICES, "ac": S.COUNTY_ATTRS, "vd": S.REGION_VERTICES, "ad": S.DNR_ATTRS,
    **_first_poly("pc", "kept", "vc"), **_first_poly("ph", "kept", "v12"),
    **_first_poly("pd", "kept", "vd"),
}) + """
SELECT k.station_id, k.station_name, k.latitude, k.longitude, c.CountyName AS county_name,
       c.DnrRegion AS dnr_region, k.wbic, k.waterbody, h.Huc12Code AS huc12,
       h.Huc12Name AS sub_watershed, h.Huc10Code AS huc10, h.Huc10Name AS watershed,
       d.DnrWatershedName AS dnr_watershed_name, d.DnrWatershedCode AS dnr_watershed_code,
       h.Huc8Code AS huc8, h.Huc8Name AS sub_basin, h.MajorBasin AS major_basin
FROM kept k
LEFT JOIN pc ON pc.station_id = k.station_id LEFT JOIN ac c ON c.pid = pc.pid
LEFT JOIN ph ON ph.station_id = k.station_id LEFT JOIN w12 h ON h.pid = ph.pid
LEFT JOIN pd ON pd.station_id = k.station_id LEFT JOIN ad d ON d.pid = pd.pid"""

LAYER_STATS = _cte2({"v6": S.HUC6_VERTICES, "v8": S.REGION_VERTICES, "v10": S.COUNTY_VERTICES,
                     "v12": S.HUC12_VERTICES}) + """
SELECT layer, count(DISTINCT pid) AS features, count(*) AS vertices,
       count(DISTINCT (pid, part, ring)) AS rings
FROM (SELECT 'huc6' AS layer, * FROM v6 UNION ALL SELECT 'huc8', * FROM v8
      UNION ALL SELECT 'huc10', * FROM v10 UNION ALL SELECT 'huc12', * FROM v12
      UNION ALL SELECT 'counties', * FROM v10 UNION ALL SELECT 'dnr_watersheds', * FROM v8)
GROUP BY layer"""

# land cover: the exact share of every cell of a polygon's box, as the integral
# of each ring segment's x, clamped to the cell, over the height it has in the
# cell's row (grid units; outer rings counted as counter-clockwise, holes not)
_LX0, _LY0, _LC = 270000.0, 2100000.0, 2500.0


def _mean_clamped(p: str, q: str) -> str:
    """Mean of min(max(t, 0), 1) for t from p to q."""
    g = lambda t: f"(CASE WHEN {t} <= 0 THEN 0.0 WHEN {t} >= 1 THEN {t} - 0.5 ELSE {t} * {t} / 2 END)"
    return (f"(CASE WHEN abs({q} - ({p})) < 1e-9 THEN least(greatest(({p} + {q}) / 2, 0.0), 1.0) "
            f"ELSE ({g(q)} - {g(p)}) / ({q} - ({p})) END)")


def _shares(p: str, v: str) -> dict[str, str]:
    X0, Y0, C = _dbl(_LX0), _dbl(_LY0), _dbl(_LC)
    at = lambda y: f"(u1 + (u2 - u1) * ({y} - v1) / (v2 - v1))"
    return {
        f"{p}_p": _projected(v, _albers_sql),
        f"{p}_o": f"SELECT a.pid, a.part, a.ring, (a.x - {X0}) / {C} AS u1, (a.y - {Y0}) / {C} AS v1, "
                  f"(b.x - {X0}) / {C} AS u2, (b.y - {Y0}) / {C} AS v2 FROM {p}_p a JOIN {p}_p b "
                  "ON a.pid = b.pid AND a.part = b.part AND a.ring = b.ring AND b.i = a.i + 1",
        f"{p}_t": f"SELECT pid, part, ring, CASE WHEN (sum(u1 * v2 - u2 * v1) < 0) = (ring = 0) THEN -1 ELSE 1 END AS w "
                  f"FROM {p}_o GROUP BY pid, part, ring",
        f"{p}_e": f"SELECT o.*, t.w FROM {p}_o o JOIN {p}_t t USING (pid, part, ring) WHERE v1 <> v2",
        f"{p}_b": f"SELECT pid, floor(min(least(u1, u2))) AS i0, floor(max(greatest(u1, u2))) AS i1, "
                  f"floor(min(least(v1, v2))) AS j0, floor(max(greatest(v1, v2))) AS j1 FROM {p}_o GROUP BY pid",
        f"{p}_i": f"SELECT pid, j0, j1, unnest(range(CAST(i0 AS BIGINT), CAST(i1 AS BIGINT) + 1)) AS i FROM {p}_b",
        f"{p}_c": f"SELECT pid, i, unnest(range(CAST(j0 AS BIGINT), CAST(j1 AS BIGINT) + 1)) AS j FROM {p}_i",
        f"{p}_h": f"SELECT c.pid, c.i, c.j, e.*  EXCLUDE (pid), least(greatest(v1, j), j + 1) AS va, "
                  f"least(greatest(v2, j), j + 1) AS vb FROM {p}_c c JOIN {p}_e e ON c.pid = e.pid "
                  "AND greatest(v1, v2) > c.j AND least(v1, v2) < c.j + 1",
        f"{p}_g": f"SELECT pid, i, j, w * (vb - va) AS dv, {at('va')} - i AS p, {at('vb')} - i AS q FROM {p}_h",
        f"{p}_f": f"SELECT pid, i, j, round(sum(dv * {_mean_clamped('p', 'q')}), 12) AS frac "
                  f"FROM {p}_g GROUP BY pid, i, j",
        f"{p}_a": f"SELECT f.pid, c.class, sum(c.cell_area * f.frac) AS area FROM lc_cells c "
                  f"JOIN {p}_f f ON c.i = f.i AND c.j = f.j WHERE f.frac > 0 GROUP BY f.pid, c.class",
        f"{p}_s": f"SELECT a.*, t.total_area, a.area / t.total_area AS pct_area FROM {p}_a a "
                  f"JOIN (SELECT pid, sum(area) AS total_area FROM {p}_a GROUP BY pid) t "
                  "ON a.pid = t.pid",
    }


LANDSCAPE_CTES = {
    "lc_raw": S.LANDCOVER_CELLS,
    "lc_cells": f"SELECT *, CAST(floor((x - {_dbl(_LX0)}) / {_dbl(_LC)}) AS BIGINT) AS i, "
                f"CAST(floor((y - {_dbl(_LY0)}) / {_dbl(_LC)}) AS BIGINT) AS j FROM lc_raw",
    "v8": S.REGION_VERTICES, "v10": S.COUNTY_VERTICES, "v12": S.HUC12_VERTICES,
    "a8": S.HUC8_ATTRS, "a10": S.HUC10_ATTRS, "a12": S.HUC12_ATTRS,
    **_shares("s8", "v8"), **_shares("s10", "v10"), **_shares("s12", "v12"),
    "landscape0": """
      SELECT 8 AS huc_level, a.Huc8Code AS huc, a.Huc8Name AS huc_name, s.class, s.area,
             s.total_area, s.pct_area FROM a8 a LEFT JOIN s8_s s ON a.pid = s.pid
      UNION ALL
      SELECT 10, a.Huc10Code, a.Huc10Name, s.class, s.area, s.total_area, s.pct_area
      FROM a10 a LEFT JOIN s10_s s ON a.pid = s.pid
      UNION ALL
      SELECT 12, a.Huc12Code, a.Huc12Name, s.class, s.area, s.total_area, s.pct_area
      FROM a12 a LEFT JOIN s12_s s ON a.pid = s.pid""",
    "landscape": "SELECT * REPLACE (CASE WHEN class = 0 THEN 11 ELSE class END AS class) "
                 "FROM landscape0",
}

LANDCOVER_SHARES = _cte2(LANDSCAPE_CTES) + """
SELECT huc_level, huc, huc_name, class, round(area, 1) AS area,
       round(total_area, 1) AS total_area, round(pct_area, 6) AS pct_area FROM landscape"""

LANDCOVER_AREA_SUMMARY = _cte2(LANDSCAPE_CTES) + """,
per AS (SELECT huc_level, huc, CASE WHEN count(total_area) = count(*) THEN avg(total_area) END
               AS mean_area FROM landscape GROUP BY huc_level, huc),
lvl AS (SELECT huc_level, CASE WHEN count(mean_area) = count(*) THEN avg(mean_area) END
               AS mean_area, count(*) AS n FROM per GROUP BY huc_level)
SELECT huc_level, round(mean_area, 1) AS mean_area, n, round(mean_area / 1e6, 6) AS sq_km,
       round(mean_area / 1e6 * 0.3861, 6) AS sq_mi FROM lvl"""


def _legend() -> str:
    from limnos.plans.landcover import CLASSES
    rows = " UNION ALL ".join(f"SELECT {c} AS class, {D.q(n)} AS class_name, {D.q(h)} AS hex, "
                              f"{i} AS class_order" for i, (c, n, h) in enumerate(CLASSES))
    return rows


STATE_CTES = {
    **LANDSCAPE_CTES,
    "legend": _legend(),
    "l12": "SELECT l.*, g.class_name, g.hex, g.class_order FROM landscape l "
           "LEFT JOIN legend g ON l.class = g.class WHERE l.huc_level = 12",
    "state": "SELECT class_name, hex, class_order, CASE WHEN count(pct_area) = count(*) "
             "THEN avg(pct_area) END AS pct_area FROM l12 GROUP BY class_name, hex, class_order",
}

LANDCOVER_STATE_MEANS = _cte2(STATE_CTES) + """
SELECT class_name, hex, class_order, round(pct_area, 6) AS pct_area FROM state"""


LANDCOVER_SAMPLE_WATERSHED = _cte2(STATE_CTES) + """,
pick AS (SELECT huc FROM landscape WHERE huc_level = 12 AND huc IS NOT NULL GROUP BY huc
         ORDER BY sha256('42:' || huc), huc LIMIT 1)
SELECT l.huc_level, l.huc, l.huc_name, l.class, round(l.area, 1) AS area, round(l.total_area, 1) AS total_area,
       round(l.pct_area, 6) AS pct_area, g.class_name, g.hex, g.class_order
FROM landscape l LEFT JOIN legend g ON l.class = g.class WHERE l.huc IN (SELECT huc FROM pick)"""


def _pct(x: str) -> str:
    v = D.r_round(f"({x}) * 100", 1)
    return f"printf('%.1f%%', CASE WHEN {v} = 0 THEN 0.0 ELSE {v} END)"


LANDCOVER_VS_STATE = _cte2(STATE_CTES) + f""",
ws AS (SELECT huc, class_name, pct_area AS pct_area2 FROM l12 WHERE class_name IS NOT NULL),
st AS (SELECT class_name, hex, pct_area FROM state WHERE class_name IS NOT NULL),
pairs AS (
  SELECT w.huc, w.class_name, s.hex, s.pct_area, w.pct_area2 FROM ws w JOIN st s USING (class_name)
  UNION ALL
  SELECT h.huc, s.class_name, s.hex, s.pct_area, 0.0 FROM (SELECT DISTINCT huc FROM ws) h, st s
  WHERE NOT EXISTS (SELECT 1 FROM ws w WHERE w.huc = h.huc AND w.class_name = s.class_name)),
d AS (SELECT *, pct_area2 - pct_area AS diff FROM pairs),
lab AS (SELECT *, CASE WHEN left({_pct('diff')}, 1) = '-' THEN {_pct('diff')}
                       ELSE '+' || {_pct('diff')} END AS label FROM d)
SELECT huc, class_name, hex, round(pct_area, 6) AS pct_area, round(pct_area2, 6) AS pct_area2,
       round(diff, 6) AS diff, label,
       round(CASE WHEN diff = 0 THEN 0.0 ELSE -1 * sign(diff) * {_dbl(0.00001)} END, 6) AS label_pos,
       'Current watershed: ' || {_pct('pct_area2')} || '<br>State average: ' || {_pct('pct_area')}
         || '<br>Difference: ' || label AS hovertext
FROM lab"""

PLAN_ATTRIBUTES = _cte2({"plans": S.PLAN_TEXT}) + f"""
SELECT plan_id,
       {D.sentence_case("trim(regexp_replace(plan_name, '[\\r\\n]', '', 'g'))")} AS plan_name,
       {D.sentence_case("trim(regexp_replace(purpose, '[\\r\\n]', '', 'g'))")} AS purpose,
       {D.sentence_case("trim(regexp_replace(objective, '[\\r\\n]', '', 'g'))")} AS objective
FROM plans"""


_X, _Y = _tm_sql("longitude", "latitude")
STATIONS_WTM = _cte(**STATION_CTES) + f"""
SELECT station_id, round({_X}, 3) AS x_wtm, round({_Y}, 3) AS y_wtm FROM stations"""


EVENT_PROPS = """
SELECT event_id, user_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"""


LOGGER_EXPORT_ROUNDTRIP = (_cte(**TRIM_CTES) + "\nSELECT "
                           + _dates_out(["date"], ["date_time"]) + " FROM hobo")


WEATHER_FILES_ROUNDTRIP = _cte(weather=S.WEATHER) + """
SELECT logger_sn, CAST(date AS VARCHAR) AS date, min_temp, round(avg_temp, 6) AS avg_temp,
       max_temp FROM weather"""


# --- further sinks, reshaping and derived values ----------------------------------------

STATIONS_EXPORT_TARGETS = _cte(**STATION_CTES) + """
SELECT CAST(k AS INTEGER) AS "copy", CAST(station_id AS BIGINT) AS station_id, station_name
FROM stations CROSS JOIN range(4) r(k)"""

WEATHER_LONG = _cte(w=S.WEATHER) + """
SELECT logger_sn, CAST(date AS VARCHAR) AS date, 'min_temp' AS measure, round(CAST(min_temp AS DOUBLE), 6) AS value FROM w
UNION ALL SELECT logger_sn, CAST(date AS VARCHAR), 'avg_temp', round(CAST(avg_temp AS DOUBLE), 6) FROM w
UNION ALL SELECT logger_sn, CAST(date AS VARCHAR), 'max_temp', round(CAST(max_temp AS DOUBLE), 6) FROM w"""

TP_SCALE = _cte(**TP_CTES) + """
SELECT fsn, station_id, tp, round(ln(1 + (tp * 1000 + 1)), 6) AS tp_scale FROM tp_data WHERE tp < 5"""

LANDCOVER_AXIS_RANGE = f"""
SELECT round(min(diff) * 1.25, 6) AS lo, round(max(diff) * 1.25, 6) AS hi FROM ({LANDCOVER_VS_STATE})"""

VISITS_EXCEL_TEXT = _cte(**BASELINE_CTES) + """
SELECT station_id, CAST(date AS VARCHAR) AS date, count(*) AS n, count(water_temp) AS n_water_temp
FROM obs GROUP BY station_id, date"""
