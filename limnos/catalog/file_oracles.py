"""DuckDB oracles of the queries on files and years."""

from __future__ import annotations

from limnos.catalog import duck as D
from limnos.catalog import standins as S
from limnos.catalog.oracles import (BASELINE_CTES, INVENTORY_CTES, LOGGER_CTES, LOGGER_QC, NL, SAMPLE_CTES, TP_CTES,
                                    TRIM_CTES, _cte, _dates_out, _num_text, _REQ_TIES)

_FLOW_OUT = ["fsn", "datetime", "station_id", "station_name", "latitude", "longitude", "wbic", "waterbody",
             "station_type_code", "stream_width", "average_stream_depth", "average_surface_velocity",
             "entered_streamflow", "calculated_streamflow", "corrected_streamflow", "flow_method_used"]

FLOW_FIRST_IN_FILE = _cte(flow_raw=S.FLOW_FILES) + f"""
SELECT {', '.join(c if c != 'datetime' else D.ts_text('datetime') + ' AS datetime' for c in _FLOW_OUT)},
       CAST(CAST(datetime AS DATE) AS VARCHAR) AS date,
       coalesce(entered_streamflow, corrected_streamflow, calculated_streamflow) AS streamflow
FROM ({BASELINE_CTES['flow_t'].replace('SELECT', 'SELECT file_no, line_no,', 1)})
QUALIFY row_number() OVER (PARTITION BY fsn, station_id, CAST(datetime AS DATE) ORDER BY file_no, line_no) = 1"""

_YEAR_LOGGERS = {
    **LOGGER_CTES,
    "lg_raw": S.LOGGER_FOLDERS,
    "lg_t": LOGGER_CTES["lg_t"].replace("SELECT", "SELECT folder,", 1),
    "readings": LOGGER_CTES["readings"].replace("2024 AS inventory_year", "CAST(left(folder, 4) AS INT) AS inventory_year, folder"),
}
_YEAR_CTES = {
    **_YEAR_LOGGERS, **INVENTORY_CTES, "inv_raw": S.INVENTORY_YEARS,
    "trk": TRIM_CTES["trk"].replace("SELECT", "SELECT r.inventory_year,", 1),
}
_OUT = "EXCLUDE (contact_name, date_deployed, date_removed)"


def _without(excluded: dict) -> str:
    return " AND ".join(f"NOT coalesce(inventory_year = {y} AND logger_sn IN ({', '.join(map(str, sns))}), false)"
                        for y, sns in excluded.items())


def _years(first: dict, later: dict) -> str:
    done = " OR ".join(f"inventory_year = {y}" for y in later)
    return (f"SELECT * {_OUT} FROM trk WHERE NOT ({done}) AND {_without(first)}\n"
            f"UNION ALL SELECT * {_OUT} FROM trk WHERE ({done}) AND {_without(later)}")


LOGGER_YEARS = _cte(**_YEAR_CTES) + ",\nmerged AS (" + _years({2023: (7.0,), 2024: (9.0,)}, {2024: (8.0,)}) + ")\nSELECT " \
    + _dates_out(["date"], ["date_time"]) + " FROM merged"

LOGGER_YEARS_QC = (_cte(**{**_YEAR_LOGGERS, "lg_t2": LOGGER_CTES["lg_t2"].replace(
    "SELECT *,", "SELECT *, CAST(left(folder, 4) AS INT) AS inventory_year,", 1)})
    + LOGGER_QC[LOGGER_QC.index("\nSELECT logger_sn, count(*)"):].replace(
        "SELECT logger_sn,", "SELECT logger_sn, inventory_year,").replace(
        "year <> 2024", "year <> inventory_year").replace("GROUP BY logger_sn", "GROUP BY logger_sn, inventory_year"))

INVENTORY_YEARS_WITHOUT_DATA = _cte(**_YEAR_CTES) + f""",
have AS (SELECT DISTINCT year, logger_sn FROM trk WHERE {_without({2023: (7.0,), 2024: (9.0,)})})
SELECT i.* REPLACE (CAST(date_deployed AS VARCHAR) AS date_deployed, CAST(date_removed AS VARCHAR) AS date_removed),
       false AS have_data
FROM inv i WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.year{NL}i.year AND h.logger_sn{NL}i.logger_sn)"""

_TFIRST = "ORDER BY " + D.order_by(_REQ_TIES)


def _text(x: str) -> str:
    return f"coalesce({_num_text(x)}, 'NA')"


LOGGER_TITLES = _cte(**TRIM_CTES) + f""",
f AS (SELECT logger_sn, first(year {_TFIRST}) AS year, first(station_id {_TFIRST}) AS station_id,
             first(latitude {_TFIRST}) AS latitude, first(longitude {_TFIRST}) AS longitude
      FROM hobo GROUP BY logger_sn)
SELECT logger_sn,
       'Year: ' || {_text('year')} || ' | Logger SN: ' || {_text('logger_sn')} || ' | Station ID: ' || {_text('station_id')}
         || ' | Coords: ' || {_text('latitude')} || ', ' || {_text('longitude')} AS title,
       {_text('year')} || ' thermistors - SN ' || {_text('logger_sn')} || ' - Stn ' || {_text('station_id')} || ' ('
         || CASE WHEN latitude IS NULL THEN 'NA' ELSE printf('%.4f', latitude) END || ', '
         || CASE WHEN longitude IS NULL THEN 'NA' ELSE printf('%.4f', longitude) END || ')' AS image_name
FROM f"""

STATION_TALLY_ARRANGED = _cte(**BASELINE_CTES) + f""",
tally AS (SELECT station_id, station_name, latitude, longitude, wbic, waterbody, station_type_code, count(*) AS n
          FROM data d WHERE EXISTS (SELECT 1 FROM valid_fsn v WHERE v.fsn{NL}d.fsn) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY n DESC NULLS LAST, station_name NULLS LAST, station_id NULLS LAST, latitude NULLS LAST,
                          longitude NULLS LAST, wbic NULLS LAST, waterbody NULLS LAST, station_type_code NULLS LAST) AS row,
       station_id, station_name, n, true AS files_in_order
FROM tally"""

# class count by Sturges; the step is 1, 2, 5 or 10 times a power of ten
TP_HISTOGRAM_AUTO = _cte(**TP_CTES) + """,
x AS (SELECT tp FROM tp_data WHERE tp < 5 AND tp IS NOT NULL AND NOT isnan(tp)),
r AS (SELECT min(tp) AS lo, max(tp) AS hi, ceil(log2(count(*)) + 1) AS classes FROM x),
c AS (SELECT *, (hi - lo) / classes AS cell, pow(10, floor(log10((hi - lo) / classes))) AS base FROM r),
s AS (SELECT *, base * CASE WHEN cell <= 1.4 * base THEN 1 WHEN cell <= 2.8 * base THEN 2
                            WHEN cell <= 7 * base THEN 5 ELSE 10 END AS step FROM c),
k AS (SELECT *, CAST(floor(lo / step + 1e-10) AS BIGINT) AS k0, CAST(ceil(hi / step - 1e-10) AS BIGINT) AS k1 FROM s),
b AS (SELECT unnest(range(k0, k1)) AS kk, k0, step FROM k)
SELECT kk - k0 AS bin, round(kk * step, 6) AS bin_lo, round((kk + 1) * step, 6) AS bin_hi,
       (SELECT count(*) FROM x WHERE (tp > kk * step + 1e-7 * step OR kk = k0) AND tp <= (kk + 1) * step + 1e-7 * step) AS n
FROM b"""

BASELINE_AT_DUPLICATES = _cte(**BASELINE_CTES) + f""",
final AS (SELECT * FROM data d WHERE EXISTS (SELECT 1 FROM valid_fsn v WHERE v.fsn{NL}d.fsn)),
st AS (SELECT DISTINCT station_id, station_name, latitude, longitude, wbic, waterbody, station_type_code FROM final),
twins AS (SELECT station_id FROM (SELECT *, count(*) OVER (PARTITION BY latitude, longitude) AS k FROM st) WHERE k > 1)
SELECT station_id, station_name, latitude, longitude, fsn, {D.ts_text('datetime')} AS datetime, water_temp
FROM final f WHERE EXISTS (SELECT 1 FROM twins t WHERE t.station_id{NL}f.station_id)"""

DUPLICATE_SAMPLES_OF_YEAR = _cte(**{**SAMPLE_CTES, "samples": SAMPLE_CTES["samples"].replace(
    "FROM prog_raw", "FROM prog_raw WHERE year(CAST(start_date_time AS TIMESTAMP)) = 2016")}) + f"""
SELECT source, fsn, station_id, {D.ts_text('start_date_time')} AS start_date_time, result_value_no,
       dense_rank() OVER (ORDER BY start_date_time NULLS LAST, station_id NULLS LAST, result_value_no NULLS LAST) AS dupe_id
FROM cnt WHERE k > 1"""

READING_TIME_ZONE = _cte(**LOGGER_CTES) + f"""
SELECT 'UTC' AS tz, count(*) AS n, {D.ts_text('min(date_time)')} AS first, {D.ts_text('max(date_time)')} AS last
FROM readings WHERE date_time IS NOT NULL"""
