"""Hand-checked rolling operators."""

import pytest
from pyspark.sql import functions as F

from bendpoint.operators import rolling as W


def column(df, name):
    return [r[name] for r in df.orderBy("index").collect()]


def test_mean_is_null_until_full_and_where_a_member_is(series):
    out = W.rolling_mean(series(range(1, 9)), "series", "index", {"value": "m"}, 7, index="index")
    assert column(out, "m") == [None] * 6 + [4.0, 5.0]
    out = W.rolling_mean(series([1, 2, 3, 4, 5, 6, 7, None]), "series", "index", {"value": "m"}, 7, index="index")
    assert column(out, "m") == [None] * 6 + [4.0, None]


def test_slope_and_r2(series):
    out = W.rolling_ols(series([2, 2, 2, 2, 7, 9, 1, 4]), "series", "index", "value", 4, index="index")
    slopes = column(out, "slope")
    assert slopes[:3] == [None] * 3
    assert slopes[3:] == pytest.approx([0, 1.5, 2.6, -0.1, -1.7])
    r2 = column(out, "r2")
    assert r2[3] is None  # constant values
    assert r2[4:] == pytest.approx([0.6, 0.889474, 0.001117, 0.393197], abs=1e-6)
    sigma = column(out, "sigma")
    assert sigma[4] == pytest.approx((0.5 * (18.75 - 1.5**2 * 5)) ** 0.5)
    forecast = column(out, "forecast")
    assert forecast[4] == pytest.approx(2.0)
    assert forecast[5] == pytest.approx(13 / 4 + 1.5 * 2.5)


@pytest.mark.parametrize("w", [1, 2, 7, 50, 64, 200])
def test_frames_of_cells_equal_plain_frames(spark, w):
    """Fits, means and maxima against Spark's own sliding frames, with gaps and spikes."""
    x = F.col("index").cast("double")
    rows = spark.range(1, 401).select(
        F.lit("s").alias("series"),
        F.col("id").alias("index"),
        F.when(F.col("id") % 150 == 0, None)
        .when((F.col("id") > 200) & (F.col("id") < 260), 2.3)
        .otherwise(F.sin("id") * 5 + F.when(F.col("id") % 37 == 0, 1e6).otherwise(0.0))
        .alias("value"),
    )
    from pyspark.sql import Window

    frame = Window.partitionBy("series").orderBy("index").rowsBetween(-(w - 1), 0)
    full = F.count("value").over(frame) == w
    sums = {n: f("value", x).over(frame) for n, f in (("xx", F.regr_sxx), ("xy", F.regr_sxy), ("yy", F.regr_syy))}
    plain = rows.withColumns(
        {n: F.when(full, c) for n, c in {**sums, "mean": F.avg("value").over(frame), "top": F.max("value").over(frame)}.items()}
    ).orderBy("index").collect()
    fits = W.Fit.over(rows, "series", "index", "value", [w], index="index", block_rows=90).frames().finish().select("index", "_frame.*")
    fits = {r["index"]: r for r in fits.collect()}
    means = column(W.rolling_mean(rows, "series", "index", {"value": "m"}, w, index="index", block_rows=90), "m")
    tops = column(W.rolling_max(rows, "series", "index", "value", w, index="index", block_rows=90), "rollmax")
    for i, want in enumerate(plain):
        got = fits[want["index"]]
        assert tops[i] == want["top"]
        assert (means[i] is None) == (want["mean"] is None)
        assert (got["n"] == w) == (want["xx"] is not None)
        if want["xx"] is not None:
            assert means[i] == pytest.approx(want["mean"], rel=1e-9, abs=1e-9)
            for n in ("xx", "xy", "yy"):
                scale = (want["xx"] * want["yy"]) ** 0.5 if n == "xy" else want[n]
                assert got[n] == pytest.approx(want[n], rel=1e-9, abs=1e-9 * scale)
            assert (want["yy"] == 0) == (got["yy"] == 0)


def test_frames_without_any_value(series):
    empty = series([None] * 12)
    out = W.rolling_ols(empty, "series", "index", "value", 4, index="index")
    assert column(out, "slope") == [None] * 12 and column(out, "sigma") == [None] * 12


def test_gradient_is_one_sided_at_the_ends(series):
    out = W.gradient(series([1, 4, 9, 16]), "series", "index", "value", index="index")
    assert column(out, "gradient") == [3, 4, 6, 7]


def test_rolling_max(series):
    out = W.rolling_max(series([1, 3, 2, 5]), "series", "index", "value", 2, index="index")
    assert column(out, "rollmax") == [None, 3, 3, 5]


def test_sign_change(series):
    out = W.sign_change(series([1, 2, 3, 2, 1, 2]), "series", "index", "value", index="index")
    assert column(out, "flag") == [None, None, False, True, False, True]


def test_slope_unit_on_a_daily_axis(spark):
    days = spark.range(10).select(
        F.lit("s").alias("series"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("index"),
        (F.col("id") * 864.0).alias("value"),
    )
    per_second = W.rolling_ols(days, "series", "index", "value", 5)
    assert column(per_second, "slope")[4:] == pytest.approx([0.01] * 6)
    per_day = W.rolling_ols(days, "series", "index", "value", 5, x_unit="day")
    assert column(per_day, "slope")[4:] == pytest.approx([864.0] * 6)
    assert column(per_day, "forecast")[5:] == pytest.approx([864.0 * i for i in range(5, 10)])


def test_kernel_keeps_a_constant_and_weighs_by_distance(series):
    out = W.kernel_smooth(series([3] * 20), "series", "index", "value", 10, index="index")
    assert column(out, "smooth") == pytest.approx([3.0] * 20)
    spike = W.kernel_smooth(series([0] * 30 + [1] + [0] * 30), "series", "index", "value", 10, index="index")
    smooth = column(spike, "smooth")
    assert max(smooth) == smooth[30]
    assert smooth[29] == pytest.approx(smooth[31])
    assert smooth[30 + 15] == 0  # beyond four kernel sd


def test_nulls_are_left_out_of_the_kernel(series):
    values = [1.0, None, 3.0, 4.0, None, 6.0]
    dense = W.kernel_smooth(series(values), "series", "index", "value", 10, index="index")
    ranged = W.kernel_smooth(series(values), "series", "index", "value", 10)
    assert column(dense, "smooth") == pytest.approx(column(ranged, "smooth"))


def test_series_bounds(series):
    out = W.series_bounds(series([4, 1, 9]), "series", ["value"]).first()
    assert (out["min_value"], out["max_value"]) == (1.0, 9.0)
