"""Stand-in inputs derived from the given tables (portable SQL, see tables.py).

Mapping: customers are the station list and suppliers the extra stations;
orders x lineitem are field visits and lab samples; events are logger
readings (user = logger); customers also give the logger inventory; nations
and regions give polygon layers; lineitem gives land-cover cells.  NULLs,
malformed text and duplicates are injected by deterministic expressions on
keys; every row of the source tables is used.
"""

from __future__ import annotations


def date_text(ts: str, add_years: int = 0, sep: str = "-") -> str:
    """yyyy-MM-dd text of a timestamp, years shifted (portable SQL)."""
    return (f"CAST(year({ts}) + {add_years} AS STRING) || '{sep}' || "
            f"lpad(CAST(month({ts}) AS STRING), 2, '0') || '{sep}' || "
            f"lpad(CAST(day({ts}) AS STRING), 2, '0')")


def clock12(hour: str, minute: str, second: str | None = None) -> str:
    """h:mm[:ss] AM/PM text from integer expressions."""
    h12 = f"CASE WHEN ({hour}) % 12 = 0 THEN 12 ELSE ({hour}) % 12 END"
    sec = f" || ':' || lpad(CAST({second} AS STRING), 2, '0')" if second else ""
    return (f"CAST({h12} AS STRING) || ':' || lpad(CAST({minute} AS STRING), 2, '0'){sec} || "
            f"CASE WHEN ({hour}) < 12 THEN ' AM' ELSE ' PM' END")


def clock24(hour: str, minute: str, second: str | None = None) -> str:
    sec = f" || ':' || lpad(CAST({second} AS STRING), 2, '0')" if second else ""
    return f"CAST({hour} AS STRING) || ':' || lpad(CAST({minute} AS STRING), 2, '0'){sec}"


# --- stations ---------------------------------------------------------------

STATIONS = """
SELECT c_custkey AS station_id,
       c_name || chr(9) || ' ' || c_mktsegment || '  $' AS station_name,
       CASE WHEN c_custkey % 41 = 7 THEN NULL
            ELSE CAST(42.0 + (c_custkey % 97) * 0.05 AS DOUBLE) END AS latitude,
       CAST(-92.0 + c_nationkey * 0.25 + (c_custkey % 13) * 0.01 AS DOUBLE) AS longitude,
       c_nationkey AS wbic,
       c_mktsegment AS waterbody,
       CASE WHEN c_custkey % 3 = 0 THEN 'RIVER' ELSE 'LAKE' END AS station_type_code
FROM {customer}
"""

EXTRA_STATIONS = """
SELECT s_suppkey * 20 AS station_id,
       s_name AS station_name,
       CAST(42.0 + (s_suppkey % 89) * 0.05 AS DOUBLE) AS latitude,
       CAST(-92.0 + s_nationkey * 0.25 AS DOUBLE) AS longitude,
       s_nationkey AS wbic
FROM {supplier}
"""

def _fsn(key: str) -> str:
    """Visit ids, half of them beyond 2^53, where doubles no longer tell neighbours apart."""
    return f"({key} + CASE WHEN o_orderkey % 4 < 2 THEN 9007199254740992 ELSE 0 END)"


# visited places; a few stations have no latitude in any source, so the final list lacks them
_LAT = ("CASE WHEN o_custkey % 41 = 7 THEN NULL "
        "ELSE CAST(CAST(42.0 + (o_custkey % 97) * 0.05 AS DOUBLE) AS STRING) END")

# --- baseline visits (all text, as exported) ----------------------------------

_VISIT_HOUR = "((5 + l_linenumber * 2) % 24)"
_VISIT_MIN = "(l_partkey % 60)"
_VISIT_DATE = date_text("o_orderdate", 19)
_BLANK = "(o_custkey % 37 = 0 OR l_partkey % 29 = 0)"

BASELINE_OBS = f"""
SELECT CASE WHEN l_orderkey % 10 = 3 THEN CAST(l_orderkey AS STRING) || '.7'
            ELSE CAST({_fsn('l_orderkey')} AS STRING) END AS fieldwork_seq_no,
       CASE WHEN l_partkey % 5 = 0 THEN replace({_VISIT_DATE}, '-', '/') ELSE {_VISIT_DATE} END
         || ' ' ||
       CASE WHEN l_partkey % 9 = 0 THEN {clock24(_VISIT_HOUR, _VISIT_MIN)}
            ELSE {clock12(_VISIT_HOUR, _VISIT_MIN)} END AS start_datetime,
       CAST(o_custkey AS STRING) AS station_id,
       'Station ' || CAST(o_custkey AS STRING) AS primary_station_name,
       {_LAT} AS latitude,
       CAST(CAST(-92.0 + (o_custkey % 23) * 0.25 AS DOUBLE) AS STRING) AS longitude,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS STRING) END AS wbic,
       CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END
         AS official_waterbody_name,
       o_orderstatus AS station_type_code,
       CASE WHEN {_BLANK} THEN NULL WHEN l_partkey % 11 = 0 THEN 'abc'
            ELSE CAST(l_partkey % 35 AS STRING) END AS ambient_air_temp,
       'F' AS ambient_air_temp_units,
       CASE WHEN {_BLANK} OR l_partkey % 4 = 0 THEN NULL
            ELSE CAST(l_extendedprice / 10000 AS STRING) END AS water_temp,
       'C' AS water_temp_units,
       CASE WHEN {_BLANK} OR l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN '1d'
            ELSE CAST(l_partkey % 12 AS STRING) || '.5' END AS do_mg,
       CASE WHEN l_partkey % 19 = 0 THEN 'NaN' ELSE CAST(l_partkey % 100 AS STRING) END AS do_pct,
       CASE WHEN {_BLANK} OR l_partkey % 6 = 0 THEN NULL
            ELSE '7.' || CAST(l_partkey % 10 AS STRING) END AS ph,
       CASE WHEN {_BLANK} OR l_partkey % 8 = 0 THEN NULL
            ELSE CAST(l_partkey % 900 AS STRING) END AS specific_cond,
       CASE WHEN {_BLANK} OR l_partkey % 3 = 0 THEN NULL
            ELSE CAST(l_partkey % 120 AS STRING) END AS transparency_avg,
       '120' AS transparency_tube_length,
       CASE l_partkey % 3 WHEN 0 THEN 'partly_cloudy' WHEN 1 THEN 'SUNNY_and_WARM' END
         AS weather_conditions,
       CASE l_linenumber % 4 WHEN 0 THEN '  light RAIN.   then sun '
            WHEN 1 THEN 'dry! very dry. etc. and so' WHEN 2 THEN NULL
            ELSE 'storms?  yes.' || chr(10) || 'flooding' END AS weather_last_2_days,
       o_orderpriority AS current_stream_condition,
       o_orderstatus AS group_desc,
       CASE WHEN l_linenumber = 1 THEN 'checked the site. all good' END AS fieldwork_comment,
       CASE WHEN l_linenumber = 2 THEN 'NEW volunteer!  trained on site.' END
         AS additional_comments
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

_FLOW_DATE = date_text("o_orderdate", 19)
BASELINE_FLOW = f"""
SELECT CAST({_fsn('o_orderkey')} AS STRING) AS fieldwork_seq_no,
       {_FLOW_DATE} || ' ' || {clock12('7', '(o_orderkey % 60)')} AS start_datetime,
       CAST(o_custkey AS STRING) AS station_id,
       CASE WHEN o_orderkey % 17 = 0 THEN 'Another name'
            ELSE 'Station ' || CAST(o_custkey AS STRING) END AS primary_station_name,
       {_LAT} AS latitude,
       CAST(CAST(-92.0 + (o_custkey % 23) * 0.25 AS DOUBLE) AS STRING) AS longitude,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS STRING) END AS wbic,
       CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END
         AS official_waterbody_name,
       o_orderstatus AS station_type_code,
       CAST(o_orderkey % 40 AS STRING) || '.25' AS stream_width,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE '1.' || CAST(o_orderkey % 9 AS STRING) END
         AS average_stream_depth,
       '0.' || CAST(o_orderkey % 10 AS STRING) AS average_surface_velocity,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 70 AS STRING) END AS stream_flow_cfs,
       CASE WHEN o_orderkey % 2 = 0 THEN '3.5' END AS calculated_streamflow_cfs,
       CASE WHEN o_orderkey % 5 = 0 THEN '2.25' END AS calculated_corrected_streamflow_cfs,
       CASE WHEN o_orderkey % 2 = 0 THEN 'float' ELSE 'meter' END AS flow_method_used
FROM {{orders}}
"""

# flow exports as twelve files: every visit, and a third of them once more, with
# another velocity, in another file or further down in the same one
_FLOW_BODY = BASELINE_FLOW.strip()[len("SELECT "):]
FLOW_FILES = f"""
SELECT o_orderkey % 12 AS file_no, CAST(o_orderkey AS DOUBLE) AS line_no, {_FLOW_BODY}
UNION ALL
SELECT (o_orderkey * 7 + 5) % 12, CAST(o_orderkey AS DOUBLE) + 0.5, {_FLOW_BODY.replace("'0.' ||", "'7.' ||")}
WHERE o_orderkey % 3 = 0
"""

# --- phosphorus samples: lines 1-3 program, 3-5 partner (line 3 in both), 6-7 agency

_TP_HOUR = "(6 + l_linenumber)"
_TP_MIN = "(l_partkey % 60)"
_TP_VALUE = """CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN 'ND'
            WHEN l_partkey % 29 = 0 THEN 'ND 0.02' WHEN l_partkey % 37 = 0 THEN '7.5'
            ELSE CAST(l_discount * 10 + l_tax AS STRING) END"""
_TP_YEARS = "CASE WHEN l_linenumber = 7 THEN 24 ELSE 20 END"
_COLLECTOR = """CASE l_partkey % 4 WHEN 0 THEN 'mary SMITH-JONES' WHEN 1 THEN 'o' || chr(39) || 'brien (ann)'
            WHEN 2 THEN 'JOHN  doe' END"""


def _mdy_text(ts: str, years: str) -> str:
    return (f"CAST(month({ts}) AS STRING) || '/' || CAST(day({ts}) AS STRING) || '/' || "
            f"CAST(year({ts}) + {years} AS STRING)")


TP_PROGRAM = f"""
SELECT CAST({_fsn('l_orderkey')} AS STRING) AS fieldwork_seq_no,
       CAST(o_custkey AS STRING) AS station_id,
       'Station ' || CAST(o_custkey AS STRING) AS primary_station_name,
       {_LAT} AS calc_ll_lat_dd_amt,
       CAST(CAST(-92.0 + (o_custkey % 23) * 0.25 AS DOUBLE) AS STRING) AS calc_ll_long_dd_amt,
       CAST(o_custkey % 50 AS STRING) AS wbic,
       o_orderpriority AS official_waterbody_name,
       o_orderstatus AS station_type_code,
       {_COLLECTOR} AS collector_name,
       CAST(CAST(year(o_orderdate) + {_TP_YEARS} AS STRING) || '-' ||
            lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' ||
            lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || ' ' ||
            lpad(CAST({_TP_HOUR} AS STRING), 2, '0') || ':' ||
            lpad(CAST({_TP_MIN} AS STRING), 2, '0') || ':00' AS TIMESTAMP) AS start_date_time,
       {_TP_VALUE} AS result_value_no
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
WHERE l_linenumber <= 3
"""

TP_PARTNER = f"""
SELECT CAST({_fsn('l_orderkey')} AS STRING) AS fieldwork_seq_no,
       {_mdy_text('o_orderdate', _TP_YEARS)} || ' ' ||
         {clock12(_TP_HOUR, _TP_MIN, '0')} AS sample_start_date_time,
       CAST(o_custkey AS STRING) AS station_id,
       {_COLLECTOR} AS collector_name,
       {_TP_VALUE} AS result_value_no
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
WHERE l_linenumber BETWEEN 3 AND 5
"""

# duplicate check between the two sample exports: every line of the source
# table is in one of them or (line 3) in both
SAMPLES_PROGRAM = TP_PROGRAM
SAMPLES_PARTNER = TP_PARTNER.replace("l_linenumber BETWEEN 3 AND 5", "l_linenumber >= 3")

TP_AGENCY = f"""
SELECT CAST({_fsn('l_orderkey')} AS STRING) AS fieldwork_seqno,
       {_mdy_text('o_orderdate', _TP_YEARS)} || ' ' ||
         {clock12(_TP_HOUR, _TP_MIN, '0')} AS start_date_time,
       CAST(o_custkey AS STRING) AS fieldwork_station_id,
       {_COLLECTOR} AS data_collector,
       {_TP_VALUE} AS result,
       CASE WHEN l_tax = 0 THEN '666' ELSE '665' END AS sample_dnr_parameter
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
WHERE l_linenumber >= 6
"""

# --- loggers: events are readings, user_id is the serial -----------------------

_EV_Y = "CAST(year(ts) AS STRING)"
_EV_YY = "lpad(CAST(year(ts) % 100 AS STRING), 2, '0')"
_EV_M = "CAST(month(ts) AS STRING)"
_EV_MM = "lpad(CAST(month(ts) AS STRING), 2, '0')"
_EV_D = "CAST(day(ts) AS STRING)"
_EV_DD = "lpad(CAST(day(ts) AS STRING), 2, '0')"
_EV_T = clock24("hour(ts)", "minute(ts)", "second(ts)")
_EV_T12 = clock12("hour(ts)", "minute(ts)", "second(ts)")
_EV_HM = clock24("hour(ts)", "minute(ts)")

LOGGER_RAW = f"""
SELECT CAST(user_id AS DOUBLE) AS logger_sn,
       CASE WHEN event_id % 97 = 0 THEN 'not a date'
            WHEN event_id % 7 = 0 THEN {_EV_Y} || '-' || {_EV_M} || '-' || {_EV_D} || ' ' || {_EV_T}
            WHEN event_id % 7 = 1 THEN {_EV_MM} || '-' || {_EV_DD} || '-' || {_EV_Y} || ' ' || {_EV_T}
            WHEN event_id % 7 = 2 THEN {_EV_MM} || '-' || {_EV_DD} || '-' || {_EV_YY} || ' ' || {_EV_T}
            WHEN event_id % 7 = 3 THEN {_EV_M} || '/' || {_EV_D} || '/' || {_EV_YY} || ' ' || {_EV_T12}
            WHEN event_id % 7 = 4 THEN {_EV_M} || '/' || {_EV_D} || '/' || {_EV_YY} || ' ' || {_EV_T}
            WHEN event_id % 7 = 5 THEN {_EV_M} || '/' || {_EV_D} || '/' || {_EV_Y} || ' ' || {_EV_HM}
            ELSE {_EV_M} || '/' || {_EV_D} || '/' || {_EV_Y} || ' ' || {_EV_T} END AS raw_datetime,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(value AS STRING) END AS raw_temp,
       CASE WHEN user_id % 4 = 0 THEN 'C' ELSE 'F' END AS unit
FROM {{events}}
"""

INVENTORY = """
SELECT 2024 AS year,
       CAST(c_custkey AS DOUBLE) AS logger_sn,
       CASE WHEN c_custkey % 2 = 0 THEN 'MX2201' ELSE 'UA-001' END AS device_type,
       c_name AS contact_name,
       CASE WHEN c_custkey % 5 IN (1, 3) THEN NULL
            ELSE DATE '2024-01-01' + CAST(c_custkey % 7 AS INT) END AS date_deployed,
       CASE WHEN c_custkey % 5 IN (2, 3) THEN NULL
            ELSE DATE '2024-01-20' + CAST(c_custkey % 9 AS INT) END AS date_removed,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END AS station_id
FROM {customer}
"""

# yearly logger folders, two for each year; one reading in a hundred lies a year before its folder's
LOGGER_FOLDERS = LOGGER_RAW.replace("year(ts)", "(year(ts) - CASE WHEN event_id % 4 < 2 THEN 1 ELSE 0 END"
                                    " - CASE WHEN event_id % 101 = 5 THEN 1 ELSE 0 END)").replace(
    "SELECT", "SELECT CASE event_id % 4 WHEN 0 THEN '2023' WHEN 1 THEN '2023_mrk' WHEN 2 THEN '2024' "
    "ELSE '2024_extra' END AS folder,", 1)
INVENTORY_YEARS = (INVENTORY + "UNION ALL"
                   + INVENTORY.replace("2024", "2023").replace("% 5 IN (1, 3)", "% 6 IN (1, 3)"))

# "Air" readings for the weather comparison: daily extremes of the events of
# the same logger and day, shifted so ranges differ from the water series.
WEATHER = """
SELECT CAST(user_id AS DOUBLE) AS logger_sn,
       CAST(ts AS DATE) AS date,
       min(value) / 2 AS min_temp,
       avg(value) / 2 AS avg_temp,
       max(value) / 2 + (user_id % 3) AS max_temp
FROM {events}
GROUP BY user_id, CAST(ts AS DATE)
"""

# --- polygon layers as vertex rows (id, part, ring, i, x, y), rings closed ------
# Coordinates are exact decimals cast to double, identical in both engines.

_NCX = "(-91.4 + (n_nationkey % 5) * 1.25)"
_NCY = "(42.7 + CAST((n_nationkey - n_nationkey % 5) / 5 AS INT) * 1.0)"
_RXL = "(-92.5 + r_regionkey * 1.3)"


class Layer(str):
    """Vertex-row SQL (for the oracle) that also carries a one-scan form
    building the nested ``polys`` array directly (for Spark)."""

    polys_sql: str


def _polys_sql(table: str, id_expr: str, rings, where: dict | None) -> str:
    parts = sorted({p for p, _, _ in rings})
    part_sql = []
    for part in parts:
        ring_sql = []
        for p, ring, pts in rings:
            if p != part:
                continue
            verts = ", ".join(f"array(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))"
                              for x, y in pts + pts[:1])
            cond = (where or {}).get((p, ring))
            r = f"array({verts})"
            ring_sql.append(f"CASE WHEN {cond} THEN {r} END" if cond else r)
        part_sql.append(f"filter(array({', '.join(ring_sql)}), r -> r IS NOT NULL)")
    polys = f"filter(array({', '.join(part_sql)}), p -> size(p) > 0)"
    return f"SELECT {id_expr} AS pid, {polys} AS polys FROM {table}"


def _vertex_rows(table: str, id_expr: str, rings: list[tuple[int, int, list[tuple[str, str]]]],
                 where: dict | None = None) -> str:
    out = Layer(_vertex_rows_sql(table, id_expr, rings, where))
    out.polys_sql = _polys_sql(table, id_expr, rings, where)
    return out


def _vertex_rows_sql(table: str, id_expr: str, rings, where: dict | None = None) -> str:
    """UNION ALL of one SELECT per vertex; ``rings`` = [(part, ring, [(x, y), ...])]."""
    sel = []
    for part, ring, pts in rings:
        cond = (where or {}).get((part, ring))
        for i, (x, y) in enumerate(pts + pts[:1]):
            sel.append(f"SELECT {id_expr} AS pid, {part} AS part, {ring} AS ring, {i} AS i, "
                       f"CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {table}"
                       + (f" WHERE {cond}" if cond else ""))
    return "\nUNION ALL\n".join(sel)


# counties: a diamond per nation
COUNTY_VERTICES = _vertex_rows("{nation}", "n_nationkey", [(0, 0, [
    (f"{_NCX} - 0.7", _NCY), (_NCX, f"{_NCY} + 0.55"), (f"{_NCX} + 0.7", _NCY),
    (_NCX, f"{_NCY} - 0.55")])])
COUNTY_ATTRS = """
SELECT n_nationkey AS pid, n_name AS CountyName, r_name AS DnrRegion
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

# sub-watersheds (HUC12 stand-in): a triangle per nation
HUC12_VERTICES = _vertex_rows("{nation}", "n_nationkey", [(0, 0, [
    (f"{_NCX} - 0.6", f"{_NCY} - 0.45"), (f"{_NCX} + 0.6", f"{_NCY} - 0.45"),
    (_NCX, f"{_NCY} + 0.5")])])
HUC12_ATTRS = """
SELECT n_nationkey AS pid, lpad(CAST(n_nationkey AS STRING), 12, '0') AS Huc12Code,
       'Sub ' || n_name AS Huc12Name
FROM {nation}
"""

# watersheds (HUC10 stand-in): the county diamonds
HUC10_ATTRS = """
SELECT n_nationkey AS pid, lpad(CAST(n_nationkey AS STRING), 10, '0') AS Huc10Code,
       'Watershed ' || n_name AS Huc10Name
FROM {nation}
"""

# DNR watersheds and sub-basins (HUC8 stand-in): a band per region, with a
# hole in even regions and a second part in region 4
REGION_VERTICES = _vertex_rows("{region}", "r_regionkey", [
    (0, 0, [(_RXL, "42.0"), (f"{_RXL} + 1.3", "42.0"), (f"{_RXL} + 1.3", "47.5"), (_RXL, "47.5")]),
    (0, 1, [(f"{_RXL} + 0.4", "44.0"), (f"{_RXL} + 0.9", "44.0"), (f"{_RXL} + 0.9", "44.6"),
            (f"{_RXL} + 0.4", "44.6")]),
    (1, 0, [("-86.0", "41.6"), ("-85.5", "41.6"), ("-85.5", "41.9"), ("-86.0", "41.9")]),
], where={(0, 1): "r_regionkey % 2 = 0", (1, 0): "r_regionkey = 4"})
DNR_ATTRS = """
SELECT r_regionkey AS pid, 'W' || CAST(r_regionkey AS STRING) AS DnrWatershedCode,
       r_name || ' watershed' AS DnrWatershedName
FROM {region}
"""
HUC8_ATTRS = """
SELECT r_regionkey AS pid, lpad(CAST(r_regionkey AS STRING), 8, '0') AS Huc8Code,
       r_name || ' basin' AS Huc8Name
FROM {region}
"""

# major basins (HUC6 stand-in): the region bands widened by 0.3 on each side
HUC6_VERTICES = _vertex_rows("{region}", "r_regionkey", [(0, 0, [
    (f"{_RXL} - 0.3", "41.5"), (f"{_RXL} + 1.6", "41.5"), (f"{_RXL} + 1.6", "48.0"),
    (f"{_RXL} - 0.3", "48.0")])])
HUC6_ATTRS = """
SELECT r_regionkey AS pid, 'Basin ' || r_name AS MajorBasin FROM {region}
"""

# DNR watersheds with shared winding borders: a cell of a lattice per supplier;
# the vertices of a side follow from the side, so neighbours have the same ones
_CX, _RY = "((s_suppkey - 1) % 10)", "CAST((s_suppkey - 1 - (s_suppkey - 1) % 10) / 10 AS BIGINT)"


def _winding(dc: int, dr: int, m: int, across: bool) -> tuple[str, str]:
    """Vertex m of the side that starts at lattice point (c + dc, r + dr)."""
    c, r = f"({_CX} + {dc})", f"({_RY} + {dr})"
    bend = f"(({c} * 7 + {r} * 13 + {m * 5 + 3 * across}) % 9 - 4) * 0.02"
    return (f"{c} + {m} * 0.125", f"{r} + {bend}") if across else (f"{c} + {bend}", f"{r} + {m} * 0.125")


def _lattice(dc: int, dr: int) -> tuple[str, str]:
    return f"{_CX} + {dc}", f"{_RY} + {dr}"


BASIN_VERTICES = _vertex_rows("{supplier}", "s_suppkey", [(0, 0, [
    _lattice(0, 0), *[_winding(0, 0, m, True) for m in range(1, 7)],
    _lattice(1, 0), *[_winding(1, 0, m, False) for m in range(1, 7)],
    _lattice(1, 1), *[_winding(0, 1, m, True) for m in range(6, 0, -1)],
    _lattice(0, 1), *[_winding(0, 0, m, False) for m in range(6, 0, -1)]])])
BASIN_ATTRS = """
SELECT s_suppkey AS pid, 'W' || CAST(s_suppkey AS STRING) AS WSHED_CODE, s_name AS WSHED_NAME,
       CAST(s_acctbal AS DOUBLE) AS WATERSHED_SIZE_ACRES_AMT,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_acctbal AS DOUBLE) / 640 END AS WATERSHED_SIZE_SQ_MILES_AMT,
       CAST(s_nationkey AS DOUBLE) AS TOTAL_LAKE_ACRES_AMT,
       CAST(s_suppkey % 100 AS DOUBLE) + 0.5 AS TOTAL_WETLAND_ACRES_AMT
FROM {supplier}
"""

# lakes: a hexagon per supplier, clockwise, with an island in every third
_LX, _LY, _LR = f"{_CX} + 0.5", f"{_RY} + 0.5", "(0.05 + (s_suppkey % 1000) * 0.0001)"
LAKE_VERTICES = _vertex_rows("{supplier}", "s_suppkey", [
    (0, 0, [(f"{_LX} - {_LR}", _LY), (f"{_LX} - {_LR} * 0.5", f"{_LY} + {_LR}"), (f"{_LX} + {_LR} * 0.5", f"{_LY} + {_LR}"),
            (f"{_LX} + {_LR}", _LY), (f"{_LX} + {_LR} * 0.5", f"{_LY} - {_LR}"), (f"{_LX} - {_LR} * 0.5", f"{_LY} - {_LR}")]),
    (0, 1, [(f"{_LX} - {_LR} * 0.25", _LY), (_LX, f"{_LY} + {_LR} * 0.25"), (f"{_LX} + {_LR} * 0.25", _LY)]),
], where={(0, 1): "s_suppkey % 3 = 0"})
LAKE_ATTRS = """
SELECT s_suppkey AS pid, 'Lake "' || s_name || '" ' || chr(123) || chr(125) || chr(10) || ' "Feature"' AS LakeName FROM {supplier}
"""

# restoration plans: documents as plan texts with dates, a tenth without an id
NKE_PLANS = """
SELECT CASE WHEN doc_id % 10 = 3 THEN NULL ELSE doc_id END AS PlanId, source || chr(13) || chr(10) AS PlanName,
       lang AS PurposeDe, text AS Objective,
       DATE '2020-01-01' + CAST(doc_id % 500 AS INT) AS StartDate,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE DATE '2024-06-30' + CAST(doc_id % 90 AS INT) END AS EndDate
FROM {documents}
"""

# land-cover cells: one record per lineitem on a 2500 m grid (EPSG:5070)
LANDCOVER_CELLS = """
SELECT CAST(270000 + ((l_orderkey % 331) + 0.5) * 2500 AS DOUBLE) AS x,
       CAST(2100000 + ((l_partkey % 277) + 0.5) * 2500 AS DOUBLE) AS y,
       CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0
            WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 11
            WHEN l_returnflag = 'N' THEN 21
            WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN 41
            WHEN l_returnflag = 'R' THEN 90
            ELSE 82 END AS class,
       l_quantity * 900.0 AS cell_area
FROM {lineitem}
"""

# plan attributes: documents as free-text plan descriptions
PLAN_TEXT = """
SELECT doc_id AS plan_id, source AS plan_name, lang AS purpose, text AS objective
FROM {documents}
"""
