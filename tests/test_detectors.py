"""Detectors on broken lines with known corners, and on the daily orders checkpoint."""

import os

import pytest
from pyspark.sql import functions as F

from bendpoint.operators import detectors as D
from bendpoint.operators import perturb as N
from bendpoint.operators import calendar as C
from bendpoint.plans import studies
from workload import roles

# Knots of the broken lines whose change points are known (fixed values).
F_KNOTS = [(0, -5), (300, 8), (600, 1), (900, 2), (1200, 3), (1500, 6)]
G_KNOTS = [(0, -5), (300, 8), (600, 1), (900, 2), (1200, 3), (1500, 4.5)]
CHECK_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lines(spark):
    both = N.piecewise_linear(spark, F_KNOTS, 1500, "f").unionByName(N.piecewise_linear(spark, G_KNOTS, 1500, "g"))
    return both.persist()


def flags(df, name):
    return sorted(r["index"] for r in df.filter(F.col("cp") & (F.col("series") == name)).collect())


def test_ratio_finds_the_corners_and_not_the_straight_knot(lines):
    out = D.gradient_ratio(lines, "series", "index", "value", 7, 2, 1e-9, rising=True, index="index")
    assert flags(out, "f") == [301, 601, 1201]
    assert flags(out, "g") == [301, 601, 1201]


def test_ratio_of_a_hundred_needs_noise(lines):
    out = D.gradient_ratio(lines, "series", "index", "value", 7, 100, 1e-9, rising=True, index="index")
    assert flags(out, "f") == []
    jittered = N.jitter(lines, "series", "index", "value", 0.01, seed=1)
    out = D.gradient_ratio(jittered, "series", "index", "jittered", 7, 100, 1e-9, rising=True, index="index")
    found = flags(out, "f")
    assert {300, 600, 1200} & {i + d for i in found for d in (-1, 0, 1)} != set()


def test_zero_predecessor_gives_no_flag_and_no_error(series):
    out = D.gradient_ratio(series([5] * 12 + [6, 9, 4] + [5] * 8), "series", "index", "value", 3, 2, index="index")
    assert out.filter("cp IS NULL").count() == 0


def test_peaks_and_long_form(lines):
    out = D.gradient_peaks(lines, "series", "index", "value", 10, 5, "equal", digits=7, index="index")
    near = [r["index"] for r in out.filter("flag AND series = 'f' AND change_point > 1e-4").collect()]
    assert near and all(min(abs(i - k) for k in (300, 600, 1200)) <= 15 for i in near)
    long = D.gradient_peaks_long(lines, "series", "index", "value", [10, 20], index="index")
    assert {r["variables"] for r in long.select("variables").distinct().collect()} == {
        "Test dataset",
        "Rolling gradient",
        "2nd derivative",
        "Rollmax",
        "r.squareds",
    }
    per_window = {r[0]: r[1] for r in long.groupBy("window_length_level").count().collect()}
    assert set(per_window) == {10, 20}
    assert all(n % 5 == 0 for n in per_window.values())


def test_half_sine_kinks(spark):
    signal = spark.range(1, 2801).select(
        F.lit("solar").alias("series"),
        F.col("id").alias("index"),
        F.greatest(F.sin((F.col("id") - 700) * 3.141592653589793 / 1400) * 60, F.lit(0.0)).alias("value"),
    )
    out = D.gradient_peaks(signal, "series", "index", "value", 40, 5, "equal", digits=7, index="index")
    strong = [r["index"] for r in out.filter("flag AND rollmax > 0.003").collect()]
    assert strong and all(min(abs(i - k) for k in (700, 2100)) <= 60 for i in strong)


def test_noise_levels_and_counts(lines):
    out = D.sweep_noise(lines, "series", "index", "value", [0, 2, 5, 10], [35, 140], index="index").persist()
    clean = out.filter("standard_deviation = 0")
    assert clean.filter("abs(noise - value) > 0").count() == 0
    added = out.filter("standard_deviation = 10").select(F.min(F.col("noise") - F.col("value")), F.max(F.col("noise") - F.col("value"))).first()
    assert 0 <= added[0] < added[1] < 10
    counts = C.count_change_points(out, ["window_length_level"], "index", "noise", within=["standard_deviation", "series"])
    assert counts.count() == 4 * 2 * 2
    row = counts.first()
    assert row["n_label"] == f"n = {row['n_cp']}"


def test_coinciding_days(spark):
    rows = [("A", "2020-01-01"), ("A", "2020-01-05"), ("B", "2020-01-05"), ("B", "2020-01-09")]
    points = spark.createDataFrame(rows, "s string, d string").select("s", F.to_date("d").alias("day"), F.lit(True).alias("cp"))
    assert [str(r["day"]) for r in D.coinciding(points, "s", "day").collect()] == ["2020-01-05"]
    near = D.coinciding(points, "s", "day", tolerance_days=4)
    assert "2020-01-03" in [str(r["day"]) for r in near.collect()]


def test_horizons_replay_the_shorter_series(spark):
    days = spark.range(30).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.sin("id").alias("value")
    )
    out = studies.horizon_study(days, "value", [("ten", "2020-01-10"), ("twenty", "2020-01-20")], w=4, k=2)
    assert {r["time_frame"]: r["count"] for r in out.groupBy("time_frame").count().collect()} == {"ten": 10, "twenty": 20}
    alone = D.gradient_peaks(days.filter("day <= '2020-01-10'"), (), "day", "value", 4, 2)
    replay = out.filter("time_frame = 'ten'").select("day", "flag")
    assert replay.exceptAll(alone.select("day", "flag")).count() == 0


# Rows, slopes, second derivatives, maxima and flags on daily orders at scale factor 0.01.
DAILY_CHECK = {
    "F": (2097, 2084, 2083, 2070, 153, 70, 588),
    "O": (2116, 2103, 2102, 2089, 159, 65, 578),
    "P": (2119, 2106, 2105, 2092, 162, 69, 562),
}


@pytest.mark.skipif(not os.path.isdir(CHECK_DIR), reason="needs the given tables")
def test_daily_orders_checkpoint(spark):
    daily = roles.orders_daily(spark, CHECK_DIR).persist()
    sign = D.gradient_peaks(daily, "series", "day", "value", 14, 14, "sign")
    equal = D.gradient_peaks(daily, "series", "day", "value", 14, 14, "equal")
    ratio = D.detect(daily, "series", "day", "value", [14], D.RatioRule(2, 1e-9))
    count = {
        r[0]: tuple(r)[1:]
        for r in sign.groupBy("series")
        .agg(
            F.count(F.lit(1)),
            F.count("slope"),
            F.count("change_point"),
            F.count("rollmax"),
            F.sum(F.col("flag").cast("int")),
        )
        .collect()
    }
    same = {r[0]: r[1] for r in equal.groupBy("series").agg(F.sum(F.col("flag").cast("int"))).collect()}
    by_ratio = {r[0]: r[1] for r in ratio.groupBy("series").agg(F.sum(F.col("cp").cast("int"))).collect()}
    assert {s: (*count[s], same[s], by_ratio[s]) for s in count} == DAILY_CHECK


def test_noise_sweep_with_levels_long_and_statistics(series):
    """Labels of the lengths, the rolling maximum as a signal of its own, sigma and r2 of every fit."""
    rows = series([i / 3 if i < 60 else 40 - i / 3 for i in range(120)])
    levels, windows = [0.0, 2.0], {5: "4%", 20: "17%"}
    wide = D.sweep_noise(rows, "series", "index", "value", levels, windows, index="index")
    assert {(r[0], r[1]) for r in wide.select("window_length_level", "percentage_level").distinct().collect()} == {(5, "4%"), (20, "17%")}
    long = D.sweep_noise_long(rows, "series", "index", "value", levels, windows, index="index")
    assert long.count() == 4 * wide.count()
    tops = long.filter("variables = 'Applied rollmax'").agg(F.sum("value")).first()[0]
    assert tops == pytest.approx(wide.agg(F.sum("rollmax")).first()[0])
    stats = D.noise_fit_stats(rows, "series", "index", "value", levels, windows, index="index")
    assert stats.count() == 2 * 2 * 2 * 120
    straight = stats.filter("standard_deviation = 0 AND index <= 60 AND value IS NOT NULL")
    kinds = {r["statistics"]: r["m"] for r in straight.groupBy("statistics").agg(F.avg("value").alias("m")).collect()}
    assert kinds["sigmas"] == pytest.approx(0, abs=1e-6) and kinds["r.squareds"] == pytest.approx(1)
    noisy = stats.filter("standard_deviation = 2 AND statistics = 'sigmas' AND window_length_level = 20")
    assert 0.3 < noisy.agg(F.avg("value")).first()[0] < 3
