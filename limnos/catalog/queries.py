"""Registered queries: each job / operator run on the given tables.

Every query takes (spark, sf_dir), reads whole tables through the stand-in
SQL in ``standins`` and runs the library's jobs on them.  Dates and
timestamps leave as ISO text and computed doubles are rounded to 6 places,
so results compare across engines.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.catalog import standins as S
from limnos.catalog.tables import spark_sql
from limnos.functions import format_datetime
from limnos.functions.datetimes import with_flexible_datetime
from limnos.operators.aggregates import histogram
from limnos.plans import baseline as B
from limnos.plans import loggers as L
from limnos.plans import nutrient as N
from limnos.plans import qc as Q
from limnos.plans import stations as ST
from limnos.operators.joins import join_ns
from limnos.operators.sets import unpivot
from limnos.session import materialize, passing_tables, shuffles_freed, side_by_side

LOGGER_YEAR = 2024


def portable(df: DataFrame, round_cols: tuple = (), areas: tuple = ()) -> DataFrame:
    """Dates -> 'yyyy-MM-dd', timestamps -> 'yyyy-MM-dd HH:mm:ss', the named
    doubles rounded to 6 places, areas (large sums of products) to 1."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = format_datetime(c)
        elif f.name in round_cols or f.name in areas:
            c = F.round(c, 1 if f.name in areas else 6)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- inputs ----------------------------------------------------------------------

# Job outputs that later steps read more than once are materialised (a
# reliable checkpoint in the shared checkpoint folder), as the reference
# writes each section's table before the next section uses it.

def _stations(spark, sf):
    return materialize(ST.station_master(spark_sql(spark, sf, S.STATIONS),
                                         spark_sql(spark, sf, S.EXTRA_STATIONS)))


def _baseline_data(spark, sf, columns=None, store=materialize):
    obs = B.baseline_obs(spark_sql(spark, sf, S.BASELINE_OBS), columns)
    flow = B.flow_obs(spark_sql(spark, sf, S.BASELINE_FLOW), columns=columns)
    if columns is None:
        return store(B.baseline_data(obs, flow))
    # the visits' shuffles can go before those of the join come
    with passing_tables(spark) as keep:
        return store(B.baseline_data(*side_by_side(spark, partial(keep, obs), partial(keep, flow))).select(*columns))


def _tp_data(spark, sf, stations=None, columns=None):
    # not written again: its rows are (tp_data), and a job takes the columns it needs
    stations = stations if stations is not None else _stations(spark, sf)
    sources = [N.tp_program(spark_sql(spark, sf, S.TP_PROGRAM)),
               N.tp_partner(spark_sql(spark, sf, S.TP_PARTNER), stations),
               N.tp_agency(spark_sql(spark, sf, S.TP_AGENCY), stations)]
    if columns is None:
        return N.tp_data(*sources)
    # the sources' shuffles can go before those of all samples come
    with passing_tables(spark) as keep:
        return N.tp_data(*side_by_side(spark, *[partial(keep, s) for s in sources]), columns=columns)


def _inventory(spark, sf, stations=None):
    inv = spark_sql(spark, sf, S.INVENTORY)
    stations = stations if stations is not None else _stations(spark, sf)
    st = stations.select("station_id", "station_name", "latitude", "longitude")
    return materialize(join_ns(inv, st, ["station_id"], "left"))


def _readings(spark, sf):
    return materialize(L.parse_readings(spark_sql(spark, sf, S.LOGGER_RAW), LOGGER_YEAR))


def _trimmed(spark, sf, keep=False, inventory=None):
    inventory = inventory if inventory is not None else _inventory(spark, sf)
    return L.trim_to_deployment(_readings(spark, sf), inventory, keep_inventory_cols=keep)


def _hobo_data(spark, sf, inventory=None):
    return L.merge_years(_trimmed(spark, sf, inventory=inventory), exclude_serials=(7.0,))


# --- T1 / T9 stations ----------------------------------------------------------------

def station_master(spark: SparkSession, sf: str) -> DataFrame:
    return _stations(spark, sf)


# --- T2 baseline ---------------------------------------------------------------------

def baseline_final(spark, sf):
    return portable(B.baseline_final(_baseline_data(spark, sf)))


def baseline_rejected(spark, sf):
    return portable(B.baseline_rejected(_baseline_data(spark, sf)))


# --- T3 phosphorus -------------------------------------------------------------------

def tp_final(spark, sf):
    return portable(N.tp_final(_tp_data(spark, sf)))


def tp_top5(spark, sf):
    return portable(N.tp_top(materialize(_tp_data(spark, sf)), 5))


def tp_histogram(spark, sf):
    h = histogram(N.tp_final(_tp_data(spark, sf)), "tp", width=0.1, sqrt_scale=True)
    return portable(h, round_cols=("bin_lo", "bin_hi"))


# --- T4-T8 loggers -------------------------------------------------------------------

def logger_readings(spark, sf):
    return portable(_readings(spark, sf))


def logger_qc(spark, sf):
    raw = spark_sql(spark, sf, S.LOGGER_RAW)
    return portable(L.reading_qc(raw, LOGGER_YEAR).drop("known_years"))


def logger_warnings(spark, sf):
    raw = spark_sql(spark, sf, S.LOGGER_RAW)
    return L.qc_warnings(L.reading_qc(raw, LOGGER_YEAR))


def logger_trimmed(spark, sf):
    return portable(_trimmed(spark, sf))


def logger_status(spark, sf):
    readings = _readings(spark, sf)
    trimmed = L.trim_to_deployment(readings, _inventory(spark, sf), keep_inventory_cols=True)
    return portable(L.logger_status(readings, trimmed))


def logger_status_summary(spark, sf):
    readings = _readings(spark, sf)
    trimmed = L.trim_to_deployment(readings, _inventory(spark, sf), keep_inventory_cols=True)
    return L.status_summary(L.logger_status(readings, trimmed))


def inventory_without_data(spark, sf):
    inv = _inventory(spark, sf)
    flagged = L.inventory_with_data_flag(inv, _hobo_data(spark, sf, inventory=inv))
    return portable(L.inventory_without_data(flagged))


def inventory_export(spark, sf):
    inv = _inventory(spark, sf)
    flagged = L.inventory_with_data_flag(inv, _hobo_data(spark, sf, inventory=inv))
    return portable(L.inventory_export(flagged))


def logger_daily(spark, sf):
    daily = L.daily_temperatures(_readings(spark, sf))
    return portable(daily, round_cols=("mean",))


def logger_daily_ranges(spark, sf):
    daily = L.daily_temperatures(_readings(spark, sf))
    ranges = L.daily_ranges(daily, spark_sql(spark, sf, S.WEATHER))
    return portable(ranges, round_cols=("water_range", "air_range", "ratio"))


def weather_requests(spark, sf):
    return portable(L.weather_requests(_hobo_data(spark, sf)))


# --- T13 QC --------------------------------------------------------------------------

def loggers_per_year(spark, sf):
    return Q.loggers_per_year(_hobo_data(spark, sf))


def baseline_station_tally(spark, sf):
    return Q.station_tally(B.baseline_final(_baseline_data(spark, sf)))


def _station_parts(spark, sf):
    """The prioritised station list, the data tables (their station columns) and the stations in use."""
    def loggers():
        inv = _inventory(spark, sf, stations=master)
        return inv, materialize(_hobo_data(spark, sf, inventory=inv).select("station_id"))

    def samples():
        # the two large jobs one after the other: their shuffles are not on disk together
        with passing_tables(spark) as keep:
            data = _baseline_data(spark, sf, ["fsn", *ST.STATION_COLS, "year", *B.KEY_VARS], keep)
            bfinal = materialize(B.baseline_final(data).select(*ST.STATION_COLS))
            visited = materialize(data.select("station_id").distinct())
        return visited, bfinal, materialize(N.tp_final(_tp_data(spark, sf, master, ST.STATION_COLS)).select(*ST.STATION_COLS))
    with shuffles_freed(spark):
        master = _stations(spark, sf)
        # jobs that read only the station list
        (visited, bfinal, tp), (inv, hobo) = side_by_side(spark, samples, loggers)
        therm = ST.station_attributes(inv).na.drop()
        stn = materialize(ST.station_list(master, ST.station_attributes(bfinal), ST.station_attributes(tp), therm))
    return stn, bfinal, tp, hobo, lambda s: ST.stations_in_use(s, visited, tp, hobo)


def stations_missing_from_list(spark, sf):
    stn, bfinal, tp, hobo, _ = _station_parts(spark, sf)
    return Q.missing_from_list(stn, {"baseline": bfinal, "nutrient": tp, "logger": hobo})


def duplicate_coordinates(spark, sf):
    """Stations that share coordinates: in the final list and per source list."""
    stn, bfinal, tp, _, in_use = _station_parts(spark, sf)
    # each list is read for its counts and for its rows
    with shuffles_freed(spark):
        lists = {"all": materialize(in_use(stn)), "baseline": materialize(ST.station_attributes(bfinal)),
                 "nutrient": materialize(ST.station_attributes(tp))}
    return Q.duplicate_coordinates(lists)


def baseline_visits_per_year(spark, sf):
    return Q.visits_per_year(B.baseline_final(_baseline_data(spark, sf)))


def _combined_samples(spark, sf, program_year=None):
    prog = spark_sql(spark, sf, S.SAMPLES_PROGRAM).select(
        F.lit("Program").alias("source"), F.col("fieldwork_seq_no").alias("fsn"),
        N.as_long("station_id").alias("station_id"),
        F.col("start_date_time").cast("timestamp_ntz").alias("start_date_time"),
        "result_value_no")
    if program_year:
        prog = Q.samples_of_year(prog, program_year)
    part = with_flexible_datetime(spark_sql(spark, sf, S.SAMPLES_PARTNER), "sample_start_date_time",
                                  "start_date_time", "mdyHMSp").select(
        F.lit("Partner").alias("source"), F.col("fieldwork_seq_no").alias("fsn"),
        N.as_long("station_id").alias("station_id"), "start_date_time", "result_value_no")
    return materialize(Q.combined_samples(prog, part))


SAMPLE_KEYS = ["start_date_time", "station_id", "result_value_no"]


def duplicate_samples(spark, sf):
    return portable(Q.duplicate_samples(_combined_samples(spark, sf), SAMPLE_KEYS))


def unique_partner_samples(spark, sf):
    return portable(Q.unique_samples(_combined_samples(spark, sf), SAMPLE_KEYS, "source", "Partner"))


def samples_by_source(spark, sf):
    return Q.samples_by_source(_combined_samples(spark, sf), ["station_id"], "source",
                               ["Program", "Partner"])


# --- spatial stand-ins ------------------------------------------------------------

from limnos.operators.ordering import pick_keys  # noqa: E402
from limnos.operators.spatial import tm_forward  # noqa: E402
from limnos.plans import landcover as LC  # noqa: E402
from limnos.plans import watersheds as W  # noqa: E402

# grids in metres: the largest-overlap chain (EPSG:3071), the land-cover cells (EPSG:5070)
HIER_GRID = (200_000.0, 0.0, 2_000.0)
LC_GRID = (270_000.0, 2_100_000.0, 2_500.0)


def _layer(spark, sf, vertices_sql, attrs_sql):
    # Stand-in layers are cheap to rebuild; a layer read from large GeoJSON
    # and used by several joins would be materialised once instead.
    polys = spark_sql(spark, sf, vertices_sql.polys_sql)
    return spark_sql(spark, sf, attrs_sql).join(polys, "pid", "left")


def _layers(spark, sf):
    return {
        "huc6": _layer(spark, sf, S.HUC6_VERTICES, S.HUC6_ATTRS),
        "huc8": _layer(spark, sf, S.REGION_VERTICES, S.HUC8_ATTRS),
        "huc10": _layer(spark, sf, S.COUNTY_VERTICES, S.HUC10_ATTRS),
        "huc12": _layer(spark, sf, S.HUC12_VERTICES, S.HUC12_ATTRS),
        "counties": _layer(spark, sf, S.COUNTY_VERTICES, S.COUNTY_ATTRS),
        "dnr_watersheds": _layer(spark, sf, S.REGION_VERTICES, S.DNR_ATTRS),
    }


def _hierarchy(spark, sf, layers=None):
    lyr = layers or _layers(spark, sf)
    return W.watershed_hierarchy(lyr["huc6"], lyr["huc8"], lyr["huc10"], lyr["huc12"], *HIER_GRID)


def watershed_hierarchy(spark, sf):
    return _hierarchy(spark, sf)["huc12"].drop("polys")


def station_watersheds(spark, sf):
    """Final station list with county / watershed attributes."""
    lyr = _layers(spark, sf)
    with shuffles_freed(spark):
        (stn, _, _, _, in_use), levels = side_by_side(
            spark, lambda: _station_parts(spark, sf), lambda: _hierarchy(spark, sf, lyr))
        keep = materialize(in_use(stn))
        huc12 = levels["huc12"].join(lyr["huc12"].select("pid", "polys"), "pid")
        return W.attribute_stations(keep, lyr["counties"], huc12, lyr["dnr_watersheds"])


def layer_stats(spark, sf):
    return W.layer_summary(_layers(spark, sf))


def display_layer_stats(spark, sf):
    lyr = _layers(spark, sf)
    return W.layer_summary({k: W.display_layer(v, k) for k, v in lyr.items()})


def stations_wtm(spark, sf):
    """Station coordinates in Wisconsin Transverse Mercator (metres)."""
    st = _stations(spark, sf)
    x, y = tm_forward("longitude", "latitude")
    return st.select("station_id", F.round(x, 3).alias("x_wtm"), F.round(y, 3).alias("y_wtm"))


def _landscape(spark, sf):
    lyr = _layers(spark, sf)
    cells = spark_sql(spark, sf, S.LANDCOVER_CELLS)
    layers, attrs = {}, None
    for level, name, code, cname in ((8, "huc8", "Huc8Code", "Huc8Name"),
                                     (10, "huc10", "Huc10Code", "Huc10Name"),
                                     (12, "huc12", "Huc12Code", "Huc12Name")):
        layers[level] = lyr[name].select("pid", "polys")
        a = lyr[name].select(F.lit(level).alias("huc_level"), "pid", F.col(code).alias("huc"),
                             F.col(cname).alias("huc_name"))
        attrs = a if attrs is None else attrs.unionByName(a)
    shares = LC.class_shares_levels(cells, layers, *LC_GRID)
    return materialize(LC.landscape_from_shares(attrs, shares))


def landcover_shares(spark, sf):
    return portable(_landscape(spark, sf), round_cols=("pct_area",), areas=("area", "total_area"))


def landcover_area_summary(spark, sf):
    return portable(LC.area_summary(_landscape(spark, sf)),
                    round_cols=("sq_km", "sq_mi"), areas=("mean_area",))


def landcover_state_means(spark, sf):
    return portable(LC.state_means(_landscape(spark, sf), LC.class_table(spark)),
                    round_cols=("pct_area",))


def landcover_vs_state(spark, sf):
    out = LC.watershed_vs_state(_landscape(spark, sf), LC.class_table(spark))
    return portable(out, round_cols=("pct_area", "pct_area2", "diff", "label_pos"))


def landcover_sample_watershed(spark, sf):
    """The class table of one repeatably sampled level-12 watershed."""
    ls = _landscape(spark, sf)
    pick = pick_keys(ls.where(F.col("huc_level") == 12), "huc", 1, seed=42)
    return portable(LC.lookup(ls, LC.class_table(spark), ["class"]).join(pick, "huc"),
                    round_cols=("pct_area",), areas=("area", "total_area"))


def plan_attributes(spark, sf):
    """T14 on whole document texts."""
    plans = spark_sql(spark, sf, S.PLAN_TEXT)
    return W.plan_attributes(plans, ["plan_name", "purpose", "objective"])


# --- sources and sinks, written and read back -------------------------------------

from limnos.functions import as_integer, as_long, as_numeric  # noqa: E402
from limnos.sources import files as FI  # noqa: E402
from limnos.sources import loggers as LF  # noqa: E402
from limnos.sources import sinks as SK  # noqa: E402


def stations_csv_roundtrip(spark, sf):
    """The station list written as gzip CSV ("NA" for NULL) and
    read back as text, then typed by name."""
    out = SK.write_csv(_stations(spark, sf), SK.scratch_path(spark, "stations"),
                       compression="gzip")
    back = FI.read_delimited(spark, out)
    back = FI.typed(back, {"station_id": as_long, "latitude": as_numeric,
                           "longitude": as_numeric, "wbic": as_integer})
    return back.select(*ST.STATION_COLS)


def logger_files(spark, sf) -> str:
    """Logger CSV files made from the readings: an optional banner line, a
    header naming the unit, numbered data rows; one folder per serial."""
    raw = spark_sql(spark, sf, S.LOGGER_RAW)
    sn = F.col("logger_sn").cast("bigint").cast("string")
    head = raw.groupBy("logger_sn", "unit").agg(F.lit(1).alias("k"))
    banner = head.where(F.col("logger_sn") % 2 == 0).select(
        "logger_sn", F.concat(F.lit("Plot Title: "), sn).alias("value"))
    header = head.select("logger_sn", F.format_string(
        '"#","Date Time, GMT-05:00","Temp, \u00b0%s (LGR S/N: %s, SEN S/N: %s)"',
        F.col("unit"), sn, sn).alias("value"))
    rows = raw.select("logger_sn", F.concat_ws(
        ",", F.monotonically_increasing_id().cast("string"), F.col("raw_datetime"),
        F.coalesce(F.col("raw_temp"), F.lit(""))).alias("value"))
    lines = banner.unionByName(header).unionByName(rows)
    out = SK.scratch_path(spark, "loggers")
    lines.repartition("logger_sn").write.partitionBy("logger_sn").text(out)
    return out


def logger_files_roundtrip(spark, sf):
    """S3 + T4 end to end: readings parsed from logger files on disk."""
    folder = logger_files(spark, sf)
    raw = LF.read_logger_folder(spark, folder, pattern="*/*.txt",
                                serial_pattern=r"logger_sn=([^/]+)/")
    LF.assert_units(raw)
    return portable(L.parse_readings(raw, LOGGER_YEAR))


def event_props(spark, sf):
    """The JSON payload of each event as columns."""
    ev = spark_sql(spark, sf, "SELECT event_id, user_id, props FROM {events}")
    return FI.json_columns(ev, "props", "k int")


def logger_export_roundtrip(spark, sf):
    """The cleaned logger data written one folder per (year, logger,
    station), read back with partition discovery and typed again."""
    hobo = _hobo_data(spark, sf)
    out = SK.export_per_logger(hobo, SK.scratch_path(spark, "hobo-export"), LOGGER_YEAR)
    back = (spark.read.option("header", True).option("nullValue", "NA")
            .option("recursiveFileLookup", False).csv(f"{out}/export_year={LOGGER_YEAR}"))
    typed = back.select(
        F.col("logger_sn").cast("double").alias("logger_sn"), "date_time", "date",
        *[F.col(c).cast("int").alias(c) for c in ("year", "month", "day", "hour", "yday")],
        F.col("temp_f").cast("double").alias("temp_f"), F.col("temp_c").cast("double").alias("temp_c"),
        "device_type", F.col("station_id").cast("bigint").alias("station_id"), "station_name",
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"))
    return typed


def weather_files_roundtrip(spark, sf):
    """Daily weather written as one ``{"data": [...]}`` answer per logger
    (as a weather service returns it) and read back as one row per day.
    Each answer holds one logger's days, so the collect is bounded by the
    request span, never by the table."""
    w = spark_sql(spark, sf, S.WEATHER)
    docs = (w.groupBy("logger_sn")
              .agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(
                  F.col("date").cast("string").alias("date"), "min_temp", "avg_temp",
                  "max_temp"))).alias("data"))).alias("value")))
    out = SK.scratch_path(spark, "weather")
    docs.repartition("logger_sn").write.partitionBy("logger_sn").text(out)
    back = FI.read_weather(spark, out, key_pattern=r"logger_sn=([^/]+)/", pattern="*/*.txt")
    return back.select(F.col("key").cast("double").alias("logger_sn"),
                       F.col("date").cast("string").alias("date"),
                       "min_temp", F.round("avg_temp", 6).alias("avg_temp"), "max_temp")


# --- further sinks, reshaping and derived values ------------------------------------

def stations_table_roundtrip(spark, sf):
    """The typed table sink, read back."""
    return spark.read.parquet(SK.write_table(_stations(spark, sf), SK.scratch_path(spark, "stations-table")))


def stations_export_targets(spark, sf):
    """One table to two folders in two formats; rows of every copy."""
    base = SK.scratch_path(spark, "targets")
    paths = SK.export_targets(_stations(spark, sf), [f"{base}/a", f"{base}/b"], "stations", year_col=None)
    parts = []
    for k, p in enumerate(paths):
        df = spark.read.parquet(p) if p.endswith(".parquet") else FI.read_delimited(spark, p)
        parts.append(df.select(F.lit(k).alias("copy"), F.col("station_id").cast("bigint").alias("station_id"), "station_name"))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def tally_tee(spark, sf):
    """A QC table written in mid-pipeline and used on."""
    return SK.tee(Q.visits_per_year(B.baseline_final(_baseline_data(spark, sf))), SK.scratch_path(spark, "tally"))


def weather_long(spark, sf):
    """Daily measures as one row per (day, measure)."""
    w = spark_sql(spark, sf, S.WEATHER)
    return portable(unpivot(w, ["logger_sn", "date"], ["min_temp", "avg_temp", "max_temp"], "measure", "value"),
                    round_cols=("value",))


def tp_scale(spark, sf):
    """The colour scale value of each phosphorus sample."""
    tp = N.tp_map_colour_value(N.tp_final(_tp_data(spark, sf)))
    return portable(tp.select("fsn", "station_id", "tp", "tp_scale"), round_cols=("tp_scale",))


def landcover_axis_range(spark, sf):
    """Axis range of the differences from the state means."""
    return portable(LC.diff_axis_range(landcover_vs_state(spark, sf)), round_cols=("lo", "hi"))


def visits_excel_text(spark, sf):
    """The visit export as delimited text with dirty headers and NA tokens,
    read back by normalised name and run through the visit job."""
    raw = spark_sql(spark, sf, S.BASELINE_OBS)
    dirty = raw.toDF(*[c.upper().replace("_", " ") for c in raw.columns])
    path = SK.write_csv(dirty, SK.scratch_path(spark, "visits"), rows_per_file=200_000)
    back = FI.read_delimited(spark, path, multi_line=True)
    return portable(B.baseline_obs(back).groupBy("station_id", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count("water_temp").alias("n_water_temp")))
