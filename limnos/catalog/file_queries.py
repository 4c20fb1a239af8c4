"""Registered queries on files and years: row order of files, yearly logger
folders, ordered sinks, reports over several years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.catalog import standins as S
from limnos.catalog.queries import (SAMPLE_KEYS, _baseline_data, _combined_samples, _hobo_data, _readings, _stations,
                                    _tp_data, portable)
from limnos.catalog.tables import spark_sql
from limnos.operators.aggregates import auto_histogram
from limnos.operators.joins import join_ns
from limnos.plans import baseline as B
from limnos.plans import loggers as L
from limnos.plans import nutrient as N
from limnos.plans import qc as Q
from limnos.plans import stations as ST
from limnos.session import assert_utc, materialize
from limnos.sources import files as FI
from limnos.sources import loggers as LF
from limnos.sources import sinks as SK

EXCLUDED = {2023: (7.0,), 2024: (9.0,)}
EXCLUDED_LATER = {2024: (8.0,)}
SAMPLE_YEAR = 2016


def flow_first_in_file(spark: SparkSession, sf: str) -> DataFrame:
    """Flow exports in several files; of a repeated visit the row that
    comes first stays, files in natural order (2 before 10), then by line."""
    path = SK.scratch_path(spark, "flow-files")
    lines = spark_sql(spark, sf, S.FLOW_FILES)
    (lines.repartition("file_no").sortWithinPartitions("file_no", "line_no").drop("line_no")
          .write.option("header", True).option("nullValue", "NA").partitionBy("file_no").csv(path))
    raw = FI.read_delimited(spark, path, position="pos")
    return portable(B.flow_obs(raw, position="pos"))


def logger_year_files(spark: SparkSession, sf: str) -> str:
    """A folder per year and partner, a file per logger in it."""
    raw = spark_sql(spark, sf, S.LOGGER_FOLDERS)
    keys = ["folder", "logger_sn"]
    sn = F.col("logger_sn").cast("bigint").cast("string")
    head = raw.groupBy(*keys, "unit").agg(F.lit(1).alias("k"))
    banner = head.where(F.col("logger_sn") % 3 == 0).select(*keys, F.concat(F.lit("Plot Title: "), sn).alias("value"))
    header = head.select(*keys, F.format_string('"#","Date Time, GMT-05:00","Temp, %s (LGR S/N: %s)"', "unit", sn).alias("value"))
    data = raw.select(*keys, F.concat_ws(",", F.lit("1"), "raw_datetime", F.coalesce("raw_temp", F.lit(""))).alias("value"))
    return SK.write_lines(banner.unionByName(header).unionByName(data), SK.scratch_path(spark, "logger-years"), keys)


def _year_readings(spark: SparkSession, sf: str) -> DataFrame:
    raw = LF.read_logger_years(spark, logger_year_files(spark, sf), "*/*/*.txt", r"logger_sn=([^/]+)/", r"folder=([^/]+)/")
    LF.assert_units(raw)
    return materialize(raw.drop("file"))


def _year_inventory(spark: SparkSession, sf: str) -> DataFrame:
    st = _stations(spark, sf).select("station_id", "station_name", "latitude", "longitude")
    return materialize(join_ns(spark_sql(spark, sf, S.INVENTORY_YEARS), st, ["station_id"], "left"))


def logger_years(spark: SparkSession, sf: str) -> DataFrame:
    """Four folders of two inventory years cleaned in one pass and written
    a folder a year; then one year cleaned anew, which replaces that year only."""
    raw, inv = _year_readings(spark, sf), _year_inventory(spark, sf)
    path = SK.write_years(L.clean_folders(raw, inv, EXCLUDED), SK.scratch_path(spark, "years"))
    SK.write_years(L.clean_folders(raw.where(F.col("folder").startswith("2024")), inv, EXCLUDED_LATER), path)
    back = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    return back.select(
        F.col("inventory_year").cast("int").alias("inventory_year"), F.col("logger_sn").cast("double").alias("logger_sn"),
        "date_time", "date", *[F.col(c).cast("int").alias(c) for c in ("year", "month", "day", "hour", "yday")],
        F.col("temp_f").cast("double").alias("temp_f"), F.col("temp_c").cast("double").alias("temp_c"), "device_type",
        F.col("station_id").cast("bigint").alias("station_id"), "station_name",
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))


def logger_years_qc(spark: SparkSession, sf: str) -> DataFrame:
    """T4 checks per logger and inventory year; readings outside their folder's year counted."""
    raw = spark_sql(spark, sf, S.LOGGER_FOLDERS)
    year = F.left(F.col("folder"), F.lit(4)).try_cast("int")
    return portable(L.reading_qc(raw, year).drop("known_years"))


def inventory_years_without_data(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory entries of two years without any reading of that year."""
    inv = _year_inventory(spark, sf)
    hobo = L.clean_folders(spark_sql(spark, sf, S.LOGGER_FOLDERS), inv, EXCLUDED)
    return portable(L.inventory_without_data(L.inventory_with_data_flag(inv, hobo)))


def logger_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Chart title and image name of each logger."""
    return L.logger_titles(_hobo_data(spark, sf))


def station_tally_arranged(spark: SparkSession, sf: str) -> DataFrame:
    """The visit tally in descending order of visits, written as CSV in
    that order, with row numbers, and read back in file order."""
    tally = Q.station_tally(B.baseline_final(_baseline_data(spark, sf)))
    path = SK.write_ordered(tally, SK.scratch_path(spark, "tally"), "n", "station_name", desc=("n",))
    back = FI.read_delimited(spark, path, position="pos")
    # rows stand in the files as they are numbered: none is before one with a smaller number
    ends = back.groupBy("pos.file").agg(F.min(F.col("row").cast("long")).alias("lo"), F.max(F.col("row").cast("long")).alias("hi"),
                                        F.count("*").alias("c")).agg(F.bool_and(F.col("hi") - F.col("lo") + 1 == F.col("c")))
    return back.select(F.col("row").cast("long").alias("row"), F.col("station_id").cast("long").alias("station_id"), "station_name",
                       F.col("n").cast("long").alias("n"), ends.scalar().alias("files_in_order"))


def tp_histogram_auto(spark: SparkSession, sf: str) -> DataFrame:
    """Phosphorus in Sturges' number of classes with pretty breaks."""
    # read for the range and for the counts: one column, written once
    tp = materialize(N.tp_final(_tp_data(spark, sf)).select("tp"))
    return portable(auto_histogram(tp, "tp"), round_cols=("bin_lo", "bin_hi"))


def baseline_at_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Visits assigned to stations that share their coordinates with another one."""
    final = materialize(B.baseline_final(_baseline_data(spark, sf)))
    return portable(Q.data_at_duplicates(final, ST.station_attributes(final)).select(
        "station_id", "station_name", "latitude", "longitude", "fsn", "datetime", "water_temp"))


def duplicate_samples_of_year(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of one year's program export that the partner export holds too."""
    return portable(Q.duplicate_samples(_combined_samples(spark, sf, SAMPLE_YEAR), SAMPLE_KEYS))


def reading_time_zone(spark: SparkSession, sf: str) -> DataFrame:
    """The zone that the readings' times are in, checked before they are used."""
    assert_utc(spark)
    times = _readings(spark, sf).where(F.col("date_time").isNotNull())
    return portable(times.groupBy(F.current_timezone().alias("tz")).agg(
        F.count("*").alias("n"), F.min("date_time").alias("first"), F.max("date_time").alias("last")))
