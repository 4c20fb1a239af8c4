"""One small file per logger: written by the tasks that hold its rows, read by tasks too."""

from __future__ import annotations

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from limnos.functions import format_datetime
from limnos.sources import files as FI
from limnos.sources import sinks as SK


def _by_folder(path):
    """Lines below each folder, files in the order of their names."""
    out = {}
    for f in sorted(glob.glob(f"{path}/**/*", recursive=True)):
        if os.path.isfile(f) and not os.path.basename(f).startswith("_"):
            out.setdefault(os.path.relpath(os.path.dirname(f), path), []).append(open(f, newline="").read())
    return out


def _readings(spark):
    t = lambda h: dt.datetime(2024, 5, 1 + h // 24, h % 24)
    odd = [(1.0, t(2), 10, 60.0, "a,b", None), (1.0, t(1), 10, 61.25, ' x "q" ', "é"), (None, t(1), None, 1e-7, "line\nbreak", ""),
           (2.0, None, 11, None, None, "NA"), (1e10, t(3), 11, float("nan"), "t\t#", "=[1]")]
    return spark.createDataFrame(odd + [(3.0, t(h), 5, float(h), "s", "t") for h in range(40)],
                                 "logger_sn double, date_time timestamp_ntz, station_id int, temp_f double, s string, `a,b` string")


def test_logger_export_is_what_spark_writes(spark, tmp):
    # no file system process, no move on the driver; the same folders and lines
    df, keys = _readings(spark), ["logger_sn", "station_id"]
    for _ in range(2):      # the second takes the first one's place
        out = SK.export_per_logger(df, f"{tmp}/hobo", 2024) + "/export_year=2024"
    (df.withColumn("date_time", format_datetime("date_time")).coalesce(1).sortWithinPartitions(*keys, "date_time")
       .write.option("header", True).option("nullValue", "NA").partitionBy(*keys).csv(f"{tmp}/plain"))
    assert _by_folder(out) == _by_folder(f"{tmp}/plain")
    assert os.path.exists(f"{out}/_SUCCESS")
    # Hadoop's file system would leave a checksum file beside each
    assert not glob.glob(f"{out}/**/.*", recursive=True)


def test_logger_export_in_bounded_files(spark, tmp):
    out = SK.export_per_logger(_readings(spark), f"{tmp}/hobo", 2024, max_records_per_file=7)
    files = _by_folder(f"{out}/export_year=2024")["logger_sn=3.0/station_id=5"]
    assert len(files) >= 6 and all(1 < len(f.splitlines()) <= 8 for f in files)
    hours = [line.split(",")[1] for f in files for line in f.splitlines()[1:]]
    assert sorted(map(float, hours)) == list(map(float, range(40)))


def test_task_run_anew_replaces_its_files(spark, tmp):
    rows = spark.range(6).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("value")).coalesce(1)
    for _ in range(2):
        SK.write_key_files(rows.sortWithinPartitions("k", "value"), f"{tmp}/f", ["k"])
    assert _by_folder(f"{tmp}/f") == {"k=0": ["0\n2\n4\n"], "k=1": ["1\n3\n5\n"]}


def test_text_lines_are_what_spark_reads(spark, tmp):
    # the same lines and paths as Spark's reader gives, whatever the size of the pieces
    base, odd = f"{tmp}/in 2", "o%#]}^`|<>\"\\é'(+,:;=@&$!~)\u00a0"
    data = {"a/x y.txt": b"\xef\xbb\xbfab\xb0c\r\nx\ry\n\nz", "a/e.txt": b"", "a/_h.txt": b"no\n", "a/.h.txt": b"no\n", "a/n.csv": b"no\n",
            "_k=1/é.txt": b"q\n" * 50, "_k/q.txt": b"no\n", "b/only.txt": b"\n", "b/deep/er.txt": b"no\n", "top.txt": b"no\n",
            "b/long.txt": b"".join(b"%d,%s\r\n" % (k, b"x" * (k % 41)) for k in range(300)), "b/cr.txt": b"1\r2\r\r3", f"{odd}/1.txt": b"odd"}
    for name, raw in data.items():
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "wb") as out:
            out.write(raw)
    plain = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(base)
             .select(F.hex("value"), F.col("_metadata.file_path").alias("file")))
    want = sorted(tuple(r) for r in plain.collect() if not r["file"].endswith(("/deep/er.txt", "/top.txt")))
    for block in (FI.BLOCK, 100, 7, 1):
        got = FI.text_lines(spark, base, "*/*.txt", block).select(F.hex("value"), "file")
        assert sorted(map(tuple, got.collect())) == want
    assert "FileScan text" not in got._jdf.queryExecution().toString()
    assert FI.text_lines(spark, base, "*/*.dat") is None
