from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limnos import functions as L
from limnos.operators import groups as G
from limnos.operators import joins as J
from limnos.operators import sets as U

keys = st.one_of(st.none(), st.integers(0, 5))
tbl = st.lists(st.tuples(keys, st.integers(0, 3), st.integers(0, 100)), max_size=25)


@settings(max_examples=15, deadline=None)
@given(tbl)
def test_keep_first_unique_and_minimal(spark, data):
    df = spark.createDataFrame(data, "k int, o int, v int")
    out = G.keep_first(df, ["k"], ["o"]).collect()
    assert len({r["k"] for r in out}) == len(out) == len({r[0] for r in data})
    for r in out:
        assert (r["o"], r["v"]) == min((o, v) for k, o, v in data if k == r["k"])


@settings(max_examples=15, deadline=None)
@given(tbl, tbl)
def test_semi_plus_anti_is_all(spark, a, b):
    left = spark.createDataFrame(a, "k int, o int, v int")
    right = spark.createDataFrame(b, "k int, o int, v int")
    n = J.semi_join_ns(left, right, ["k"]).count() + J.anti_join_ns(left, right, ["k"]).count()
    assert n == len(a)


@settings(max_examples=10, deadline=None)
@given(tbl)
def test_prioritized_union_idempotent(spark, data):
    df = spark.createDataFrame(data, "k int, o int, v int")
    once = U.prioritized_union([df, df], ["k"])
    twice = U.prioritized_union([once, df], ["k"])
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-5, 30, allow_nan=False), min_size=1, max_size=20))
def test_unit_round_trip(spark, temps):
    df = spark.createDataFrame([(t,) for t in temps], "c double")
    back = df.select("c", L.r_round(L.f_to_c(L.r_round(L.c_to_f("c"), 2)), 2).alias("b")).collect()
    assert all(abs(r["c"] - r["b"]) < 0.01 + 1e-9 for r in back)
