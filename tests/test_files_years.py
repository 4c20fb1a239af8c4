"""Row order of files, yearly logger folders, ordered sinks, automatic bins."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from limnos.functions import as_long
from limnos.operators.aggregates import auto_histogram, pretty_breaks
from limnos.operators.ordering import pick_keys
from limnos.plans import loggers as L
from limnos.plans import qc as Q
from limnos.session import materialize, release
from limnos.sources import files as FI
from limnos.sources import loggers as LF
from limnos.sources import sinks as SK
from tests.conftest import rows


def test_ids_above_2_53_are_exact(spark):
    big = 2 ** 53
    texts = [str(big), str(big + 1), f" {big + 3} ", "12.7", "1e3", "-5", "+7", "9223372036854775807", "9223372036854775808", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(as_long("t")).collect()]
    assert got == [big, big + 1, big + 3, 12, 1000, -5, 7, 2 ** 63 - 1, None, None, None]


def test_position_follows_files_and_lines(spark, tmp):
    # natural file order (2 before 10), a file of several splits, more files than tasks
    for name, n in (("a10.csv", 40), ("a2.csv", 3000), ("a3.csv", 1)):
        with open(f"{tmp}/{name}", "w") as fh:
            fh.write("File,Line Number\n" + "".join(f"{name},{k}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = FI.read_delimited(spark, tmp, position="pos")
        assert df.rdd.getNumPartitions() > 4
        order = [(r["file"], int(r["line_number"])) for r in materialize(df.repartition(5)).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert order == [(n, k) for n, c in (("a2.csv", 3000), ("a3.csv", 1), ("a10.csv", 40)) for k in range(c)]


def _folders(tmp):
    for folder, year, serial in (("2023", 2023, 1), ("2023_partner", 2023, 2), ("2024", 2024, 1), ("2024", 2024, 3)):
        os.makedirs(f"{tmp}/raw/{folder}", exist_ok=True)
        with open(f"{tmp}/raw/{folder}/{serial}.csv", "w") as fh:
            fh.write('Plot Title: x\n"#","Date Time","Temp, F"\n')
            fh.write(f"1,{year}-06-10 10:00:00,50\n2,{year}-06-11 10:00:00,51\n3,{year - 1}-06-12 10:00:00,52\n4,bad,53\n")
    return f"{tmp}/raw"


def _inventory(spark):
    d = dt.date
    return spark.createDataFrame([(2023, 1.0, "t", "c", d(2023, 6, 10), None, 11), (2023, 2.0, "t", "c", None, None, 12),
                                  (2024, 1.0, "t", "c", None, None, 21), (2024, 3.0, "t", "c", None, None, 23)],
                                 "year int, logger_sn double, device_type string, contact_name string, "
                                 "date_deployed date, date_removed date, station_id long")


def test_folders_of_two_years(spark, tmp):
    raw = LF.read_logger_years(spark, _folders(tmp))
    assert sorted({(r["folder"], r["logger_sn"]) for r in raw.collect()}) == [
        ("2023", 1.0), ("2023_partner", 2.0), ("2024", 1.0), ("2024", 3.0)]
    got = L.clean_folders(raw, _inventory(spark), exclude={2024: (3.0,)})
    n = {(r["inventory_year"], r["station_id"]): r["count"] for r in got.groupBy("inventory_year", "station_id").count().collect()}
    # by the inventory of the folder's year: 2023's deployment bound drops two of logger 1 (one is unparsed)
    assert n == {(2023, 11): 1, (2023, 12): 4, (2024, 21): 4}
    qc = {(r["logger_sn"], r["inventory_year"]): r["n_other_year"]
          for r in L.reading_qc(raw, F.left(F.col("folder"), F.lit(4)).try_cast("int")).collect()}
    assert qc == {(1.0, 2023): 2, (2.0, 2023): 2, (1.0, 2024): 2, (3.0, 2024): 2}


def test_a_year_is_replaced_alone(spark, tmp):
    raw, inv = LF.read_logger_years(spark, _folders(tmp)), _inventory(spark)
    path = SK.write_years(L.clean_folders(raw, inv), f"{tmp}/out")
    first = set(glob.glob(f"{path}/inventory_year=2023/part-*"))
    SK.write_years(L.clean_folders(raw.where("folder like '2024%'"), inv, exclude={2024: (1.0,)}), path)
    assert set(glob.glob(f"{path}/inventory_year=2023/part-*")) == first
    back = spark.read.option("header", True).csv(path)
    assert sorted({(r["inventory_year"], r["logger_sn"]) for r in back.collect()}) == [(2023, "1.0"), (2023, "2.0"), (2024, "3.0")]
    assert all(f.endswith(".gz") for f in glob.glob(f"{path}/*/part-*"))


def test_titles(spark):
    cols = "logger_sn double, date_time timestamp_ntz, year int, station_id long, latitude double, longitude double"
    t = dt.datetime
    df = spark.createDataFrame([(7.0, t(2024, 5, 2), 2024, 5, 44.5, -90.25), (7.0, t(2024, 5, 1), 2024, 4, 43.0, -89.0),
                                (8.0, None, 2024, 6, None, None)], cols)
    got = {r["logger_sn"]: (r["title"], r["image_name"]) for r in L.logger_titles(df).collect()}
    assert got[7.0] == ("Year: 2024 | Logger SN: 7 | Station ID: 4 | Coords: 43, -89",
                        "2024 thermistors - SN 7 - Stn 4 (43.0000, -89.0000)")
    assert got[8.0][0].endswith("Coords: NA, NA") and got[8.0][1].endswith("(NA, NA)")


def test_ordered_files_hold_ordered_rows(spark, tmp):
    df = spark.range(1000).selectExpr("id % 7 a", "cast(id as string) b")
    SK.write_ordered(df, f"{tmp}/out", "a", "b", desc=("a",))
    lines = []
    for f in sorted(glob.glob(f"{tmp}/out/part-*")):
        with open(f) as fh:
            lines += [x.split(",") for x in fh.read().splitlines()[1:]]
    assert [int(r) for _, _, r in lines] == list(range(1, 1001))
    assert [(a, b) for a, b, _ in lines] == sorted(((str(k % 7), str(k)) for k in range(1000)), key=lambda x: (-int(x[0]), x[1]))


def test_pretty_breaks():
    # values that R's pretty() gives
    assert pretty_breaks(0, 1, 5) == [k * 0.2 for k in range(6)]
    assert pretty_breaks(1, 10, 4) == [0, 2, 4, 6, 8, 10]
    assert pretty_breaks(0, 100, 8) == [k * 10 for k in range(11)]
    assert pretty_breaks(-3, 27, 6) == [-5, 0, 5, 10, 15, 20, 25, 30]
    assert len(pretty_breaks(5, 5, 3)) >= 2


def test_automatic_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 2, 3, 10)] + [(None,), (float("nan"),)], "x double")
    got = rows(auto_histogram(df, "x").orderBy("bin"), "bin_lo", "bin_hi", "n")
    # six values: four classes by Sturges; steps of two from 0 to 10
    assert got == [(0.0, 2.0, 4), (2.0, 4.0, 1), (4.0, 6.0, 0), (6.0, 8.0, 0), (8.0, 10.0, 1)]
    assert auto_histogram(df.where("x > 99 and not isnan(x)"), "x").count() == 0


def test_data_at_duplicates_and_year(spark):
    st = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 5.0, 5.0), (None, 5.0, 6.0)], "station_id long, latitude double, longitude double")
    data = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "station_id long")
    assert sorted(r[0] for r in Q.data_at_duplicates(data, st).collect()) == [1, 2, 2]
    times = spark.createDataFrame([(dt.datetime(2016, 1, 1),), (dt.datetime(2017, 1, 1),), (None,)], "start_date_time timestamp_ntz")
    assert Q.samples_of_year(times, 2016).count() == 1


def test_pick_is_repeatable_in_any_engine(spark):
    import hashlib
    df = spark.createDataFrame([(f"k{k % 50}",) for k in range(500)], "k string")
    want = sorted({f"k{k}" for k in range(50)}, key=lambda x: hashlib.sha256(f"42:{x}".encode()).hexdigest())[:3]
    assert sorted(r[0] for r in pick_keys(df, "k", 3).collect()) == sorted(want)


def test_intermediates_are_parquet_and_can_be_released(spark):
    release(spark)
    df = materialize(spark.range(10).withColumn("t", F.lit(1)))
    path = df.inputFiles()[0]
    assert path.endswith(".parquet") and df.count() == 10
    assert release(spark) == 1 and not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
