"""Station jobs on disk: what is shuffled, what is written and what is freed."""

from __future__ import annotations

import os
import random

from limnos import session
from limnos.catalog import queries as CQ
from limnos.operators.groups import keep_first
from limnos.session import passing_tables, shuffles_freed

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_keep_first_of_some_columns_takes_the_same_rows(spark):
    r = random.Random(3)
    some = lambda n: r.choice([None, *range(n)])
    df = spark.createDataFrame([(some(5), some(3), some(3), some(2), some(3), some(4)) for _ in range(300)],
                               "k int, a int, t int, b int, c int, d int")
    for order in (["t"], ["t", "c"], []):
        whole = keep_first(df, ["k"], order=order)
        for columns in (["a"], ["b"], ["c", "a"], ["t"], ["d"], []):
            part = keep_first(df, ["k"], order=order, columns=columns)
            assert {"k", *columns} <= set(part.columns)
            assert _rows(part) == _rows(whole.select(*part.columns))
    assert keep_first(df, ["k"], order=["t"], columns=["b"]).columns == ["k", "a", "t", "b"]


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def _written(spark, job) -> list:
    paths = session._WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    n = len(paths)
    job()
    there = [p for p in paths[n:] if os.path.isdir(p.removeprefix("file:"))]
    return [spark.read.parquet(p) for p in there]


def test_station_jobs_write_station_columns_and_free_their_shuffles(spark):
    before = _shuffle_files(spark)
    tables = _written(spark, lambda: CQ._station_parts(spark, SF))
    assert _shuffle_files(spark) <= before
    columns = {c for t in tables for c in t.columns}
    assert columns and not columns & {"fieldwork_comments", "weather_last_2_days", "volunteer_name", "transparency_units"}


def test_shuffle_setting_is_put_back(spark):
    for was in ("false", "true"):
        spark.conf.set(session.SHUFFLE_CLEANUP, was)
        with shuffles_freed(spark), shuffles_freed(spark):
            assert spark.conf.get(session.SHUFFLE_CLEANUP) == "true"
        assert spark.conf.get(session.SHUFFLE_CLEANUP) == was
    spark.conf.unset(session.SHUFFLE_CLEANUP)


def test_duplicate_coordinates_writes_its_lists_once(spark):
    before = _shuffle_files(spark)
    out = []
    written = _written(spark, lambda: out.append(CQ.duplicate_coordinates(spark, SF)))
    assert _shuffle_files(spark) <= before
    # the result reads three written lists, not the tables they come from
    lists = [f for t in written[-3:] for f in t.inputFiles()]
    assert set(out[0].inputFiles()) == set(lists)


def test_station_watersheds_frees_the_shuffles_of_its_tables(spark):
    before = _shuffle_files(spark)
    out = CQ.station_watersheds(spark, SF)
    assert _shuffle_files(spark) <= before
    assert out.count() > 0


def test_passing_tables_are_gone_after_their_block(spark):
    paths = session._WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    with passing_tables(spark) as keep:
        df = keep(spark.range(5))
        path = paths[-1].removeprefix("file:")
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
    spark.conf.set("spark.limnos.materialize", "false")
    try:
        with passing_tables(spark) as keep:
            assert keep(df) is df
    finally:
        spark.conf.unset("spark.limnos.materialize")
