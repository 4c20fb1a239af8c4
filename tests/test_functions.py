import datetime as dt

from pyspark.sql import functions as F

from limnos import functions as L
from limnos.functions.text import big_camel_name, snake_name, unique_names


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_as_numeric_rules(spark):
    # R coercion -- '1d' and 'NaN' are NA, blanks trimmed, exponent ok
    cases = {"12.7": 12.7, "abc": None, "1d": None, "NaN": None, " 3 ": 3.0, "1e3": 1000.0,
             "-.5": -0.5, None: None, "": None}
    for text, want in cases.items():
        assert one(spark, L.as_numeric("x"), text) == want, text


def test_as_integer_truncates(spark):
    # As.integer("12.7") == 12, overflow -> NA
    assert one(spark, L.as_integer("x"), "12.7") == 12
    assert one(spark, L.as_integer("x"), "-12.7") == -12
    assert one(spark, L.as_integer("x"), "99999999999") is None


def test_r_round_matches_r(spark):
    # Ties to even on exact ties, nearest neighbour otherwise
    for x, want in [(0.125, 0.12), (2.675, 2.67), (-2.675, -2.67), (0.5, 0.5), (1.005, 1.0)]:
        assert one(spark, L.r_round("x", 2), x, "x double") == want, x


def test_strip_and_squish(spark):
    # ICU classes keep accents, drop symbols and controls
    assert one(spark, L.clean_station_name("x"), "Café  $<Lake>\tNorth ") == "Café LakeNorth"
    assert one(spark, L.squish("x"), "  a \t\n b  ") == "a b"


def test_title_case_breaks_at_hyphen(spark):
    # N14
    assert one(spark, L.title_case("x"), "mary SMITH-JONES") == "Mary Smith-Jones"
    assert one(spark, L.title_case("x"), "o'brien (ann)") == "O'brien (Ann)"


def test_sentence_case(spark):
    # Each sentence capitalised; "etc. and" is not a sentence end
    got = one(spark, L.sentence_case("x"), "hello WORLD. this is it! and more? yes. etc. and so")
    assert got == "Hello world. this is it! And more? Yes. etc. and so"
    assert one(spark, L.sentence_case("x"), "no letters. |") == "No letters. |"


def test_logger_formats_in_order(spark):
    # Seven exact formats, first match wins, unparsable -> NULL
    want = dt.datetime(2024, 1, 5, 13, 5, 7)
    for text in ["2024-1-5 13:05:07", "01-05-2024 13:05:07", "01-05-24 13:05:07",
                 "1/5/24 1:05:07 PM", "1/5/24 13:05:07", "1/5/2024 13:05:07"]:
        assert one(spark, L.parse_exact("x"), text) == want, text
    assert one(spark, L.parse_exact("x"), "1/5/2024 13:05") == dt.datetime(2024, 1, 5, 13, 5)
    assert one(spark, L.parse_exact("x"), "2/30/2024 13:05") is None
    assert one(spark, L.parse_exact("x"), "junk") is None
    assert one(spark, L.parse_exact("x"), "1/5/24 12:05:07 AM") == dt.datetime(2024, 1, 5, 0, 5, 7)


def test_flexible_parse(spark):
    # X11: any separators, AM/PM or 24-hour
    assert one(spark, L.parse_flexible("x"), "2015-05-12 10:30 AM") == dt.datetime(2015, 5, 12, 10, 30)
    assert one(spark, L.parse_flexible("x"), "2015/5/12 1:30 pm") == dt.datetime(2015, 5, 12, 13, 30)
    assert one(spark, L.parse_flexible("x"), "2015.05.12 14:30") == dt.datetime(2015, 5, 12, 14, 30)
    assert one(spark, L.parse_flexible("x", "mdyHMSp"), "5/12/2015 1:30:05 PM") == \
        dt.datetime(2015, 5, 12, 13, 30, 5)


def test_temperature_units(spark):
    # F4 inclusive ranges, X17 conversion rounded as R does
    df = spark.createDataFrame([(86.0, "F"), (86.01, "F"), (23.0, "F"), (22.99, "F"),
                                (30.0, "C"), (-5.0, "C"), (-5.01, "C")], "t double, u string")
    ok = [r[0] for r in df.select(L.temp_check("t", "u")).collect()]
    assert ok == [True, False, True, False, True, True, False]
    r = spark.createDataFrame([(68.0, "F")], "t double, u string").select(
        *[c.alias(k) for k, c in L.both_units("t", "u").items()]).first()
    assert (r["temp_f"], r["temp_c"]) == (68.0, 20.0)


def test_percent_labels(spark):
    # Explicit sign, no negative zero
    vals = [(0.0123,), (-0.0123,), (-0.0004,), (0.0,)]
    got = [r[0] for r in spark.createDataFrame(vals, "x double").select(L.signed_percent("x")).collect()]
    assert got == ["+1.2%", "-1.2%", "+0.0%", "+0.0%"]


def test_month_name_and_noon(spark):
    r = spark.createDataFrame([(dt.date(2024, 3, 9),)], "d date").select(
        L.month_name("d").alias("m"), L.noon("d").alias("n")).first()
    assert r["m"] == "March" and r["n"] == dt.datetime(2024, 3, 9, 12, 0)


def test_clean_names():
    # S7
    assert snake_name("Primary Station Name") == "primary_station_name"
    assert snake_name("DO (%)") == "do_percent"
    assert big_camel_name("huc8_code") == "Huc8Code"
    assert big_camel_name("SHAPE_Leng") == "ShapeLeng"
    assert unique_names(["a", "a", "b"]) == ["a", "a_2", "b"]


def test_na_tokens(spark):
    # N17
    assert one(spark, L.na_tokens("x"), " NA ") is None
    assert one(spark, L.na_tokens("x"), " x ") == "x"


def test_station_label_and_utc(spark):
    # P9, X16
    from limnos.session import assert_utc
    assert one(spark, L.station_label(F.lit(12), "x"), "Lake") == "[12] Lake"
    assert_utc(spark)


def test_json_columns(spark):
    # R3
    from limnos.sources.files import json_columns, parse_json_records
    from pyspark.sql import types as T
    df = spark.createDataFrame([(1, '{"k": 69}'), (2, "not json")], "id int, props string")
    assert sorted(json_columns(df, "props", "k int").collect()) == [(1, 69), (2, None)]
    arr = spark.createDataFrame([(1, '[{"d": "a"}, {"d": "b"}]')], "id int, j string")
    rec = T.StructType([T.StructField("d", T.StringType())])
    assert sorted(parse_json_records(arr, "j", rec).collect()) == [(1, "a"), (1, "b")]


def test_ids_beyond_32_bits(spark):
    # visit and station ids are 64-bit: a large one must not become NULL
    assert one(spark, L.as_long("x"), "3000000000") == 3_000_000_000
    from limnos.plans import baseline
    from limnos.catalog import standins as S
    from limnos.catalog.tables import spark_sql
    from tests.conftest import SF_SMALL
    raw = spark_sql(spark, SF_SMALL, S.BASELINE_OBS).withColumn("fieldwork_seq_no", F.lit("3000000001"))
    assert baseline.baseline_obs(raw).select("fsn").distinct().first().fsn == 3_000_000_001
