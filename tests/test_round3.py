"""Findings of round 3 on the phosphorus jobs."""

import datetime as dt

from pyspark.sql import functions as F

from limnos.functions import title_case
from limnos.plans import nutrient as N


def test_calendar_columns_do_not_travel_and_late_years_go_before_the_count(spark, monkeypatch):
    written = []
    monkeypatch.setattr(N, "materialize", lambda df: written.append(df.columns) or df)
    rows = [(1, 7, dt.datetime(2020, 5, 1, 9), 0.1, "ANN lee"), (1, 7, dt.datetime(2020, 5, 1, 9), 0.1, "second"),
            (2, 7, dt.datetime(2020, 6, 2, 9), None, "o'brien (ann)"), (3, 7, dt.datetime(2025, 1, 1), 0.2, None), (4, 7, None, 0.3, None)]
    df = spark.createDataFrame(rows, "fsn long, station_id long, datetime timestamp_ntz, tp double, volunteer_name string")
    out = N.tp_data(df, df)
    assert written == [["fsn", "station_id", "datetime", "tp", "volunteer_name"]]
    assert out.columns == [*written[0], "date", "year", "month", "month_name", "num_obs"]
    got = {(r.fsn, r.volunteer_name, r.date, r.year, r.month, r.month_name, r.num_obs) for r in out.collect()}
    assert got == {(1, "Ann Lee", dt.date(2020, 5, 1), 2020, 5, "May", 1), (2, "O'brien (Ann)", dt.date(2020, 6, 2), 2020, 6, "June", 1)}


def test_title_case_of_plain_and_other_values(spark):
    names = ["JOHN  doe", " mary", "", "mary SMITH-JONES", "o'brien (ann)", "a.b c", "élan VITAL", "x1y z", "tab\tnext"]
    got = spark.createDataFrame([(n,) for n in [*names, None]], "n string").select(title_case("n").alias("t"), F.col("n")).collect()
    want = ["John  Doe", " Mary", "", "Mary Smith-Jones", "O'brien (Ann)", "A.b C", "Élan Vital", "X1y Z", "Tab\tNext", None]
    assert [r.t for r in got] == want
