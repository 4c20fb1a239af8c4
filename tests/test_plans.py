import datetime as dt

from pyspark.sql import functions as F

from limnos.functions import noon
from limnos.plans import baseline as B
from limnos.plans import loggers as L
from limnos.plans import stations as ST
from tests.conftest import rows


def test_station_master_dedups_before_dropping(spark):
    # The first row per id wins even when it lacks coordinates
    cols = "station_id long, station_name string, latitude double, longitude double, wbic long, " \
           "waterbody string, station_type_code string"
    master = spark.createDataFrame([(1, "A  b\u0007", None, -90.0, 1, "w", "R"),
                                    (2, "Café $x", 43.0, -90.0, 2, "w", "R")], cols)
    extra = spark.createDataFrame([(1, "dup", 44.0, -91.0), (3, "new", 45.0, -92.0)],
                                  "station_id long, station_name string, latitude double, longitude double")
    out = sorted(rows(ST.station_master(master, extra), "station_id", "station_name"))
    assert out == [(2, "Café x"), (3, "new")]


def _raw_visits(spark):
    cols = list(B.OBS_COLUMNS)
    def row(fsn, when, sid, **vals):
        r = {c: None for c in cols}
        r.update(fieldwork_seq_no=fsn, start_datetime=when, station_id=sid, latitude="43.0",
                 longitude="-90.0", primary_station_name="S", **vals)
        return tuple(r[c] for c in cols)
    data = [row("1", "2016-05-01 09:00 AM", "10", water_temp="12"),
            row("1", "2016-05-01 08:00 AM", "10", water_temp="11"),      # same visit, earlier
            row("2", "2016-06-01 09:00 AM", "10"),                      # no data, valid year
            row("3", "2016-06-01 09:00 AM", "20"),                      # station-year without data
            row("4", "2014-12-31 11:59 PM", "10", water_temp="5")]      # before 2015
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))


def test_baseline_validity(spark):
    # Keep-first per visit in time order, validity by station-year
    obs = B.baseline_obs(_raw_visits(spark))
    flow_cols = ", ".join(f"{c} string" for c in B.FLOW_COLUMNS)
    flow = spark.createDataFrame([], flow_cols)
    data = B.baseline_data(obs, B.flow_obs(flow))
    final = sorted(rows(B.baseline_final(data), "fsn", "water_temp", "d_o_units"))
    assert final == [(1, 11.0, ""), (2, None, "")]
    assert rows(B.baseline_rejected(data), "fsn") == [(3,)]


def test_deployment_window(spark):
    # Strictly inside, missing bound = open, reading on the
    # deploy day dropped, no inventory -> dropped
    d = dt.date
    readings = spark.createDataFrame(
        [(1.0, dt.datetime(2024, 6, k, 12), d(2024, 6, k), 2024, 60.0, 15.56, 2024) for k in (1, 2, 9, 10)]
        + [(2.0, dt.datetime(2024, 6, 1, 12), d(2024, 6, 1), 2024, 60.0, 15.56, 2024),
           (3.0, dt.datetime(2024, 6, 1, 12), d(2024, 6, 1), 2024, 60.0, 15.56, 2024)],
        "logger_sn double, date_time timestamp_ntz, date date, year int, temp_f double, "
        "temp_c double, inventory_year int")
    inv = spark.createDataFrame([(2024, 1.0, "t", "c", d(2024, 6, 1), d(2024, 6, 10), 7),
                                 (2024, 2.0, "t", "c", None, None, 8)],
                                "year int, logger_sn double, device_type string, contact_name string, "
                                "date_deployed date, date_removed date, station_id long")
    out = sorted(rows(L.trim_to_deployment(readings, inv), "logger_sn", "day"))
    assert out == [(1.0, 2), (1.0, 9), (2.0, 1)]
    st = {r["logger_sn"]: r["status"] for r in
          L.logger_status(readings, L.trim_to_deployment(readings, inv, keep_inventory_cols=True)).collect()}
    assert st == {1.0: "OK", 2.0: "missing deploy/removal", 3.0: "missing station id"}


def test_daily_ranges_divide_by_zero(spark):
    # Zero air range -> NULL ratio
    daily = spark.createDataFrame([(1.0, dt.date(2024, 1, 1), 50.0, 52.0, 55.0)],
                                  "logger_sn double, date date, min double, mean double, max double"
                                  ).withColumn("date_time", noon("date"))
    weather = spark.createDataFrame([(1.0, dt.date(2024, 1, 1), 30.0, 30.0)],
                                    "logger_sn double, date date, min_temp double, max_temp double")
    r = L.daily_ranges(daily, weather).first()
    assert (r["water_range"], r["air_range"], r["ratio"], r["valid"]) == (3.0, 0.0, None, False)


def test_visit_times_are_parsed_once(spark):
    # F11 and the queries on visits: the filter on the first day must not parse the time once more
    plan = B.baseline_obs(_raw_visits(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^0-9A-Za-z]+") == 1
    assert all(line.count("gettimestamp") <= 2 for line in plan.splitlines()) and plan.count("gettimestamp") == 2
