import pytest
from pyspark.sql import functions as F

from limnos.operators import aggregates as A
from limnos.operators import groups as G
from limnos.operators import joins as J
from limnos.operators import ordering as O
from limnos.operators import sets as U
from tests.conftest import rows


def test_natural_join_matches_null_keys(spark):
    # NA matches NA, other columns carried over
    left = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (3, 6, "c")], "k int, w int, x string")
    right = spark.createDataFrame([(1, None, 10.0), (2, 7, 20.0)], "k int, w int, y double")
    out = sorted(rows(J.natural_left_join(left, right), "k", "y"))
    assert out == [(1, 10.0), (2, None), (3, None)]


def test_null_safe_join_stays_equi_join(spark):
    left = spark.range(100).select(F.col("id").alias("k"))
    right = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = J.join_ns(left, right, ["k"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_semi_anti_two_valued(spark):
    # NOT IN with a NULL would return nothing; anti join does not
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert sorted(rows(J.semi_join_ns(left, right, ["k"])), key=str) == [(1,), (None,)]
    assert rows(J.anti_join_ns(left, right, ["k"])) == [(2,)]
    right2 = spark.createDataFrame([(1,)], "k int")
    assert sorted(rows(J.anti_join_ns(left, right2, ["k"])), key=str) == [(2,), (None,)]


def test_flag_join_and_fill(spark):
    # J7, J8
    inv = spark.createDataFrame([(2024, 1.0), (2024, 2.0)], "year int, sn double")
    data = spark.createDataFrame([(2024, 1.0), (2024, 1.0)], "year int, sn double")
    out = sorted(rows(J.flag_join(inv, data, ["year", "sn"]), "sn", "have_data"))
    assert out == [(1.0, True), (2.0, False)]
    filled = J.left_join_fill(inv, data.distinct().withColumn("v", F.lit(3)), ["year", "sn"], {"v": 0})
    assert sorted(rows(filled, "sn", "v")) == [(1.0, 3), (2.0, 0)]


def test_strict_aggregates(spark):
    # Any NA -> NA; N6: NA is one more distinct value
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (2, 4.0)], "g int, x double")
    out = sorted(rows(df.groupBy("g").agg(A.strict_min("x").alias("m"), A.strict_mean("x").alias("a"),
                                          A.n_distinct_na("x").alias("n")), "g", "m", "a", "n"))
    assert out == [(1, None, None, 2), (2, 2.0, 3.0, 2)]


def test_first_by_keeps_null_payload(spark):
    # N7
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, None, "z")], "g int, t int, v string")
    assert rows(df.groupBy("g").agg(A.first_by("v", "t").alias("f")), "f") == [(None,)]


def test_keep_first_is_deterministic(spark):
    # First in declared order, NA order last, ties broken by all columns
    df = spark.createDataFrame([(1, 3, "a"), (1, 1, "c"), (1, 1, "b"), (2, None, "x"), (2, 9, "y")],
                               "k int, o int, v string")
    assert sorted(rows(G.keep_first(df, ["k"], ["o"]), "k", "v")) == [(1, "b"), (2, "y")]


def test_group_values_and_counts(spark):
    # W1, W2, W3, W4
    df = spark.createDataFrame([(1, True, 1.0), (1, False, None), (2, False, 2.0), (None, False, 3.0),
                                (None, True, 4.0)], "k int, f boolean, x double")
    anyf = sorted(rows(G.any_in_group(df, "f", ["k"], "a"), "k", "a"), key=str)
    assert set(anyf) == {(1, True), (2, False), (None, True)}
    cnt = sorted(set(rows(G.count_in_group(df, "x", ["k"], "n"), "k", "n")), key=str)
    assert cnt == [(1, 1), (2, 1), (None, 2)]
    assert sorted(r[0] is None for r in rows(G.duplicated(df, ["k"]), "k")).count(True) == 2
    assert rows(G.singletons(df, ["k"]), "k") == [(2,)]


def test_top_n_with_ties(spark):
    # O3
    df = spark.createDataFrame([(v,) for v in [5, 9, 9, 7, 1, None, 7]], "x int")
    assert sorted(r[0] for r in G.top_n_with_ties(df, "x", 3).collect()) == [7, 7, 9, 9]


def test_dense_group_id(spark):
    # 1-based rank of sorted keys, NA last, across several range partitions
    df = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(60)], "k int, v int")
    ids = dict(rows(G.dense_group_id(df, ["k"], partitions=3), "k", "group_id"))
    assert [ids[k] for k in range(7)] == list(range(1, 8)) and ids[None] == 8


def test_bind_rows_checks_types(spark):
    # N12 / U1
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2.5,)], "id double")
    out = U.bind_rows(a, b)
    assert dict(out.dtypes)["id"] == "double" and rows(out, "s") == [("x",), (None,)]
    c = spark.createDataFrame([("z",)], "id string")
    with pytest.raises(TypeError):
        U.bind_rows(a, c)


def test_prioritized_union(spark):
    # U3
    a = spark.createDataFrame([(1, "master")], "k int, src string")
    b = spark.createDataFrame([(1, "extra"), (2, "extra")], "k int, src string")
    assert sorted(rows(U.prioritized_union([a, b], ["k"]))) == [(1, "master"), (2, "extra")]


def test_union_distinct_unpivot_pivot(spark):
    # U2, R1 (keeps NULL values), R2
    a = spark.createDataFrame([(1,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(rows(U.union_distinct([a, b], "k"))) == [(1,), (3,)]
    w = spark.createDataFrame([(1, 2.0, None)], "id int, a double, b double")
    assert sorted(rows(U.unpivot(w, ["id"], ["a", "b"])), key=str) == [(1, "a", 2.0), (1, "b", None)]
    s = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, src string")
    assert sorted(rows(U.pivot_counts(s, ["k"], "src", ["x", "y"]))) == [(1, 2, None), (2, None, 1)]


def test_histogram_and_count_of_counts(spark):
    # A15, A5
    df = spark.createDataFrame([(0.01,), (0.04,), (0.25,), (None,)], "x double")
    h = dict(rows(A.histogram(df, "x", 0.1, sqrt_scale=True), "bin", "n"))
    assert h == {1: 1, 2: 1, 5: 1}
    ev = spark.createDataFrame([(1, 2024), (1, 2024), (2, 2024), (2, 2023)], "sn int, year int")
    assert sorted(rows(A.count_of_counts(ev, ["sn", "year"], ["year"]))) == [(2023, 1), (2024, 2)]


def test_repeatable_pick_and_file_order(spark):
    # O6, O5
    df = spark.range(100).select(F.col("id").alias("k"))
    a = rows(O.pick_keys(df, "k", 3, seed=7))
    assert a == rows(O.pick_keys(df, "k", 3, seed=7)) and len(a) == 3
    p = spark.createDataFrame([("b/10.csv",), ("b/9.csv",), ("b/a.csv",)], "p string")
    got = [r[0] for r in p.orderBy(O.natural_path_order("p")).collect()]
    assert got == ["b/9.csv", "b/a.csv", "b/10.csv"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_skew_safe_plan_shapes(spark):
    # keep-first and per-group values are aggregates with a partial (map-side)
    # stage, not whole-partition windows; top-n needs no window at all
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"),
                                  (F.col("id") * 2).alias("v"))
    p = _plan(G.keep_first(df, ["k"], ["o"]))
    assert "Window" not in p and "partial_min(" in p
    p = _plan(G.any_in_group(df.withColumn("f", F.col("v") > 10), "f", ["k"], "a"))
    assert "Window" not in p and "partial_max" in p
    assert "Window" not in _plan(G.top_n_with_ties(df, "v", 5))
    # numbering reads written ranges: its windows run per range, plus one over
    # the one-row-per-range sizes
    assert _plan(G.dense_group_id(df, ["k"])).count("Window ") <= 2 * 2


def test_hot_key_results(spark):
    # one key holds a third of the rows: results stay exact (no capping,
    # sampling or dropped rows) through the aggregate-based operators
    n = 3000
    data = [(0 if i % 3 == 0 else i % 97 + 1, i, (i * 7) % 11) for i in range(n)]
    df = spark.createDataFrame(data, "k int, o int, v int").repartition(8)
    first = dict(rows(G.keep_first(df, ["k"], ["o"]), "k", "o"))
    assert first[0] == 0 and len(first) == 98
    counts = dict(set(rows(G.count_in_group(df, None, ["k"], "n"), "k", "n")))
    assert counts[0] == n // 3 and sum(counts.values()) == n
    assert G.duplicated(df, ["k"]).count() == n
    ids = dict(rows(G.dense_group_id(df, ["k"], partitions=4).select("k", "group_id").distinct()))
    assert sorted(ids.values()) == list(range(1, 99)) and ids[0] == 1
    top = G.top_n_with_ties(df, "v", 1).count()
    assert top == sum(1 for _, _, v in data if v == 10)


def test_dense_group_id_without_exchange_reuse(spark):
    # ids must not depend on Spark reusing one sampled range exchange
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(40_000).selectExpr("pmod(xxhash64(id), 20000) as k")
        got = G.dense_group_id(df, ["k"], partitions=7).distinct().toPandas().sort_values("k")
        assert got.group_id.tolist() == list(range(1, len(got) + 1))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_keep_first_forms_agree(spark):
    data = [(1, 5, None, "a"), (1, 5, 2.0, "b"), (1, 4, None, "z"), (2, None, 1.0, "q"), (2, 7, None, None), (None, 1, 1.0, "n")]
    df = spark.createDataFrame(data, "k int, o int, x double, s string")
    plain = sorted(rows(G.keep_first(df, ["k"], order=["o"])), key=str)
    assert plain == sorted([(1, 4, None, "z"), (2, 7, None, None), (None, 1, 1.0, "n")], key=str)
    assert sorted(rows(G.keep_first(df, ["k"], order=["o"], desc=("o",))), key=str) == \
        sorted([(1, 5, 2.0, "b"), (2, 7, None, None), (None, 1, 1.0, "n")], key=str)
