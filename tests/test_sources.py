import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from limnos.plans.loggers import parse_readings
from limnos.sources import files as FI
from limnos.sources import loggers as LF
from limnos.sources import sinks as SK
from limnos.streaming.logger_stream import logger_stream, read_stream_output
from tests.conftest import rows

HOBO_F = ('"Plot Title: 20361490"\n'
          '"#","Date Time, GMT-05:00","Temp, °F (LGR S/N: 20361490, SEN S/N: 20361490)"\n'
          '1,06/01/23 12:00:00 PM,68.752,Logged\n'
          '2,06/01/23 01:00:00 PM,90.1\n'
          '3,06/01/23 02:00:00 PM,\n'
          '4,not a date,70.0\n')
HOBO_C = ('#,"Date Time, GMT-05:00","Temp, Â°C (LGR S/N: 5)"\n'
          '1,2023-06-01 12:00:00,20.5\n'
          '2,2023-06-01 13:00:00,-5.0\n')


def write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_logger_folder(spark, tmp):
    # S3: optional banner, unit from the header (mis-encoded degree sign ok),
    # serial from the file name, extra columns ignored
    write(f"{tmp}/20361490.csv", HOBO_F)
    write(f"{tmp}/5.csv", HOBO_C)
    raw = LF.read_logger_folder(spark, tmp)
    LF.assert_units(raw)
    units = dict(rows(raw.select("logger_sn", "unit").distinct()))
    assert units == {20361490.0: "F", 5.0: "C"}
    got = sorted(rows(parse_readings(raw, 2023), "logger_sn", "date_time", "temp_f", "temp_c"),
                 key=lambda r: (r[0], str(r[1])))
    assert got == [(5.0, dt.datetime(2023, 6, 1, 12), 68.9, 20.5),
                   (5.0, dt.datetime(2023, 6, 1, 13), 23.0, -5.0),
                   (20361490.0, dt.datetime(2023, 6, 1, 12), 68.752, 20.42),
                   (20361490.0, None, 70.0, 21.11)]


def test_logger_rows_of_any_first_field_are_kept(spark, tmp):
    # an empty, decimal or grouped row number is still a data row
    write(f"{tmp}/8.csv", 'Plot Title: 8\n#,"Date Time","Temp, °C (LGR)"\n,2023-06-01 12:00:00,20.5\n'
          '1.0,2023-06-01 13:00:00,21.5\n"1,000",2023-06-01 14:00:00,22.5\n4,2023-06-01 15:00:00,\n\n')
    raw = LF.read_logger_folder(spark, tmp)
    got = sorted(rows(raw, "raw_datetime", "raw_temp", "unit"))
    assert [g[1] for g in got] == ["20.5", "21.5", "22.5", None] and {g[2] for g in got} == {"C"}


def test_logger_folder_errors(spark, tmp):
    with pytest.raises(FileNotFoundError):
        LF.read_logger_folder(spark, tmp)
    write(f"{tmp}/7.csv", '#,"Date Time","Temperature"\n1,2023-06-01 12:00:00,20.5\n')
    with pytest.raises(ValueError):
        LF.assert_units(LF.read_logger_folder(spark, tmp))


def test_delimited_reader(spark, tmp):
    # Header names normalised, NA tokens and blanks -> NULL
    write(f"{tmp}/s.csv", 'STATION_ID,Primary Station Name,LATITUDE\n1,"Lake, North",43.1\n2,NA, \n')
    df = FI.read_delimited(spark, f"{tmp}/s.csv")
    assert df.columns == ["station_id", "primary_station_name", "latitude"]
    assert sorted(rows(df)) == [("1", "Lake, North", "43.1"), ("2", None, None)]


def test_weather_json(spark, tmp):
    # S6 / R3
    json.dump({"data": [{"date": "2024-01-02", "min_temp": 1.0, "avg_temp": 2.0, "max_temp": 3.0},
                        {"date": "2024-01-03", "min_temp": 0.0, "avg_temp": 1.0, "max_temp": 0.0}]},
              open(f"{tmp}/16.json", "w"))
    df = FI.read_weather(spark, f"{tmp}/*.json")
    assert sorted(rows(df, "key", "date", "max_temp")) == [("16", dt.date(2024, 1, 2), 3.0),
                                                          ("16", dt.date(2024, 1, 3), 0.0)]


def test_sinks(spark, tmp):
    # S8/S9/S10/S11/S13
    df = spark.createDataFrame([(2021, "a", None), (2023, "b", 1.5)], "year int, s string, v double")
    out = SK.write_csv(df, f"{tmp}/x.csv.gz", compression="gzip")
    assert glob.glob(f"{out}/*.csv.gz")
    back = spark.read.option("header", True).option("nullValue", "NA").csv(out)
    assert sorted(rows(back)) == [("2021", "a", None), ("2023", "b", "1.5")]
    written = SK.export_targets(df, [f"{tmp}/t1", f"{tmp}/t2"], "baseline-data")
    assert sorted(os.path.basename(p) for p in written) == [
        "baseline-data-2021-2023.csv", "baseline-data-2021-2023.csv",
        "baseline-data-2021-2023.parquet", "baseline-data-2021-2023.parquet"]
    t = SK.tee(df, f"{tmp}/qc")
    assert t.count() == 2 and glob.glob(f"{tmp}/qc.csv/*.csv")


def test_per_logger_export(spark, tmp):
    # One folder per (year, logger, station), time-ordered text datetimes
    df = spark.createDataFrame([(1.0, dt.datetime(2024, 5, 1, 2), 10, 60.0),
                                (1.0, dt.datetime(2024, 5, 1, 1), 10, 61.0),
                                (2.0, dt.datetime(2024, 5, 1, 1), 11, 62.0)],
                               "logger_sn double, date_time timestamp_ntz, station_id int, temp_f double")
    out = SK.export_per_logger(df, f"{tmp}/hobo", 2024)
    files = glob.glob(f"{out}/export_year=2024/logger_sn=1.0/station_id=10/*.csv")
    assert len(files) == 1
    lines = open(files[0]).read().splitlines()
    assert lines[1].startswith("2024-05-01 01:00:00") and lines[2].startswith("2024-05-01 02:00:00")


def test_logger_stream(spark, tmp):
    # Structured Streaming ingest gives the same readings as the batch read
    os.makedirs(f"{tmp}/in")
    write(f"{tmp}/in/20361490.csv", HOBO_F)
    write(f"{tmp}/in/5.csv", HOBO_C)
    q = logger_stream(spark, f"{tmp}/in", f"{tmp}/out", f"{tmp}/ck", 2023)
    q.awaitTermination(120)
    streamed = sorted(rows(read_stream_output(spark, f"{tmp}/out")), key=str)
    batch = sorted(rows(parse_readings(LF.read_logger_folder(spark, f"{tmp}/in"), 2023)), key=str)
    assert streamed == batch and len(batch) == 4


def test_deep_files_are_read_at_their_level_and_once(spark, tmp):
    # many small files below a folder: one listing, one pass over the files
    for where in ("2023/logger_sn=5", "2024 x/logger_sn=6", "2024 x/logger_sn=6/deeper", "shallow"):
        os.makedirs(f"{tmp}/in 1/{where}")
        write(f"{tmp}/in 1/{where}/a.csv", HOBO_C)
    write(f"{tmp}/in 1/2023/logger_sn=5/b.txt", HOBO_F)
    raw = LF.read_logger_years(spark, f"{tmp}/in 1", "*/*/*.csv", r"logger_sn=([^/]+)/", r"([^/]+)/[^/]+/[^/]+$")
    before = sorted(rows(raw, "logger_sn", "raw_temp", "unit"))
    assert before == [(5.0, "-5.0", "C"), (5.0, "20.5", "C"), (6.0, "-5.0", "C"), (6.0, "20.5", "C")]
    # the lines are kept: later uses do not open the files again
    os.remove(f"{tmp}/in 1/2024 x/logger_sn=6/a.csv")
    assert sorted(rows(raw, "logger_sn", "raw_temp", "unit")) == before
    with pytest.raises(FileNotFoundError):
        LF.read_logger_folder(spark, f"{tmp}/in 1", "*/*/*/*/*.csv")
    write(f"{tmp}/in 1/shallow/empty.dat", "")
    assert LF.read_logger_folder(spark, f"{tmp}/in 1", "*/*.dat").count() == 0


def test_unsplittable_csv_is_written_in_bounded_files(spark, tmp):
    # one task reads a whole file when fields hold line breaks, so files stay small
    out = SK.write_csv(spark.range(2500).coalesce(1).select("id", F.lit("a\nb").alias("s")), f"{tmp}/v", rows_per_file=1000)
    assert len(glob.glob(f"{out}/*.csv")) == 3
    back = FI.read_delimited(spark, out, multi_line=True)
    assert back.count() == 2500 and back.where("s = 'a\nb'").count() == 2500
