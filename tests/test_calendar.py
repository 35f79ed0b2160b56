"""Calendar aggregation, intervals, coverage and reconstruction scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bendpoint.functions.aggregates import pearson, vector_mean_direction
from bendpoint.operators import calendar as C
from bendpoint.operators import joins as J
from bendpoint.operators import reconstruct as E
from bendpoint.operators import shape as P
from bendpoint.plans import daily as R


def hourly(spark, values, start="2020-01-01 00:00:00", site="A"):
    rows = [(site, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "site string, i int, value double")
    return df.select(
        "site", (F.lit(start).cast("timestamp") + F.make_interval(hours=F.col("i"))).alias("date"), "value"
    )


def test_one_value_has_no_sd(spark):
    row = C.calendar_agg(hourly(spark, [3.0]), "site", "date", {"s": ("value", "sd"), "m": ("value", "median")}).first()
    assert row["s"] is None and row["m"] == 3.0


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_median_is_exact(spark, accuracy):
    rng = np.random.default_rng(5)
    groups = {
        "odd": rng.normal(0, 1, 501),
        "even": rng.normal(0, 1, 500),
        "ties": rng.integers(0, 3, 400).astype(float),
        "one": np.array([2.5]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("odd", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = {r["k"]: r["median"] for r in C.group_median(df, "k", "v", accuracy=accuracy).collect()}
    assert out == {k: pytest.approx(float(np.median(v))) for k, v in groups.items()}


def test_several_medians_beside_other_statistics(spark):
    """One table with both, also for a null key and a group without values."""
    rng = np.random.default_rng(6)
    rows = [(k, float(a), None if i % 3 else float(b)) for k, n in (("x", 301), (None, 40)) for i, (a, b) in enumerate(rng.normal(0, 1, (n, 2)))]
    df = spark.createDataFrame([*rows, ("none", None, None)], "k string, a double, b double")
    out = C.group_stats(df, "k", {"ma": "a", "mb": "b"}, [F.count("a").alias("n"), F.max("b").alias("top")], accuracy=20)
    assert out.columns == ["k", "ma", "mb", "n", "top"]
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    for k in ("x", None):
        a, b = ([r[i] for r in rows if r[0] == k and r[i] is not None] for i in (1, 2))
        assert got[k] == (pytest.approx(np.median(a)), pytest.approx(np.median(b)), len(a), max(b))
    assert got["none"] == (None, None, 0, None)


def test_vector_mean_of_directions_around_north(spark):
    df = spark.createDataFrame([(1.0, 350.0), (1.0, 10.0)], "ws double, wd double")
    mean = df.agg(vector_mean_direction("wd", "ws")).first()[0]
    assert min(mean, 360 - mean) == pytest.approx(0, abs=1e-9)
    df = spark.createDataFrame([(3.0, 90.0), (1.0, 180.0)], "ws double, wd double")
    assert df.agg(vector_mean_direction("wd", "ws")).first()[0] < 135


def test_interval_and_missing_count(spark):
    df = spark.createDataFrame([(10.0, 2.0, 4), (1.0, None, 0)], "m double, s double, n int")
    rows = C.ci_bounds(df, "m", "s", "n").collect()
    assert (rows[0]["CI_lower"], rows[0]["CI_upper"]) == pytest.approx((8.04, 11.96))
    assert rows[1]["CI_lower"] is None


def test_coverage_may_exceed_one_unless_bounded(spark):
    df = hourly(spark, [1.0] * 48)
    ratio = C.coverage(df, "site", "date", "2020-01-01", "2020-01-02").first()["coverage"]
    assert ratio == pytest.approx(48 / 25)
    bounded = C.coverage(df, "site", "date", "2020-01-01", "2020-01-02", bounded=True).first()["coverage"]
    assert bounded == pytest.approx(1.0)


def test_gate_and_report(spark):
    df = hourly(spark, [1.0] * 25).unionByName(hourly(spark, [1.0] * 5, site="B"))
    cov = C.coverage(df, "site", "date", "2020-01-01", "2020-01-02")
    assert {r["site"] for r in C.gate(df, cov, "site").select("site").distinct().collect()} == {"A"}
    assert [r["site"] for r in C.skipped(cov).collect()] == ["B"]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(pearson("a", "b")).first()[0] is None


def test_interpolation_between_two_knots(spark):
    day = F.to_date("d")
    knots = spark.createDataFrame([("s", "2020-01-02", 10.0), ("s", "2020-01-04", 20.0)], "k string, d string, value double")
    grid = spark.createDataFrame([("s", f"2020-01-0{i}") for i in range(1, 6)], "k string, d string")
    out = E.interpolate_linear(knots.withColumn("day", day), grid.withColumn("day", day), "k", "day")
    assert [r["approx_value"] for r in out.orderBy("day").collect()] == [None, 10.0, 15.0, 20.0, None]
    scored = out.withColumn("value", F.lit(15.0) + F.dayofmonth("day"))
    row = E.score_reconstruction(scored, ["k"]).first()
    assert row["rmse"] == pytest.approx(np.sqrt(np.mean([7.0**2, 3.0**2, 1.0**2])))
    assert row["rsquared"] == pytest.approx(1.0)


def test_weather_joins(spark):
    stamp = F.lit("2020-01-01").cast("timestamp")
    weather = spark.createDataFrame([("M", 1.0), ("M", 2.0)], "met_code string, ws double").withColumn(
        "date", stamp + F.make_interval(hours=F.col("ws").cast("int"))
    )
    site_map = spark.createDataFrame([("A", "M"), ("B", "M")], "code string, met_code string")
    readings = spark.createDataFrame([("A", 5.0, 99.0), ("A", 6.0, 99.0)], "code string, no2 double, ws double").withColumn(
        "date", stamp + F.make_interval(hours=F.col("no2").cast("int") - 4)
    )
    left = J.join_weather(readings, weather, site_map)
    assert left.count() == 4
    assert left.filter("code = 'B' AND no2 IS NULL").count() == 2
    assert {r["ws"] for r in left.collect()} == {1.0, 2.0}
    late = readings.withColumn("date", F.col("date") + F.expr("interval 1 hour"))
    right = J.join_weather(late, weather, site_map, keep="readings")
    assert right.count() == 2 and right.filter("ws IS NULL").count() == 1


def test_median_is_called_observed_mean(spark):
    row = R.daily_observed(hourly(spark, [1.0, 2.0, 10.0])).first()
    assert row["observed_mean"] == 2.0 and row["observed_max"] == 10.0 and row["d7_rollavg_mean"] is None


def test_missing_days_are_padded_on_request(spark):
    days = C.calendar_agg(hourly(spark, [1.0] * 24), "site", "date", {"m": ("value", "mean")})
    gap = days.unionByName(days.withColumn("day", F.date_add("day", 3)))
    assert C.fill_calendar(gap, "site", "day").count() == 4


def test_ordinals_and_slices(spark):
    df = spark.createDataFrame([("Two",), ("One",), ("Six",)], "x string")
    out = {r["x"]: r["x_ord"] for r in P.add_ordinal(df, "x", ["One", "Two"]).collect()}
    assert out == {"One": 1, "Two": 2, "Six": None}
    index = spark.range(1, 11).withColumnRenamed("id", "i")
    assert sorted(r["i"] for r in P.slice_index(index, "i", 4, 6).collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        P.pick(index, ["i"], "absent").collect()
    assert P.pick_existing(index, ["i", "absent"]).columns == ["i"]


def test_has_signal_is_null_where_nothing_was_measured(spark):
    rows = spark.createDataFrame([("A", 1.0), ("A", None), ("B", None), ("C", 0.0)], "site string, c double")
    out = {r["site"]: r["has_c"] for r in C.has_signal(rows, "site", "c").collect()}
    assert out == {"A": True, "B": None, "C": False}
