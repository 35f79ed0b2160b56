"""The arithmetic inside a block equals Spark's own, to the last bit and for NULL and NaN."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bendpoint.operators import detectors as D
from bendpoint.operators import frames as B
from bendpoint.operators import rolling as W

NUMBERS = [0.00005, 0.00015, 1.00005, 2.5, -0.00005, -1.25e-5, 1e-9, -1e-9, 0.0, 1e17, 123456.78905, 0.1 + 0.2, float("nan"), float("inf"), 4503599627370497.5]


@pytest.mark.parametrize("digits", [1, 4, 7])
def test_rounding_is_sparks(spark, digits):
    ties = [n / 2 / 10**digits for n in range(-21, 22)] + [n * 0.01 / 7140 for n in range(0, 4000, 51)]
    numbers = NUMBERS + ties
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i long, v double")
    theirs = [r[0] for r in rows.orderBy("i").select(F.round("v", digits)).collect()]
    ours = B.half_up(B.Held(np.array(numbers), np.ones(len(numbers), bool)), digits).v
    assert [repr(float(x)) for x in ours] == [repr(x) for x in theirs]


def test_three_valued_and():
    values = [(True, True), (False, True), (False, False)]  # true, false, NULL
    a, b = (B.Held(np.array([x[0] for x in s]), np.array([x[1] for x in s])) for s in zip(*[(p, q) for p in values for q in values]))
    out = B.both(a, b)
    assert [bool(v) if ok else None for v, ok in zip(out.v, out.ok)] == [True, False, None, False, False, False, None, False, None]


def test_nan_is_more_than_any_number():
    nan, one = (B.Held(np.array([v]), np.array([True])) for v in (np.nan, 1.0))
    assert nan.over(1.0).v[0] and not one.over(nan).v[0] and not nan.over(nan).v[0] and nan.same(nan).v[0]


def test_maximum_is_null_until_full():
    out = B.rolling_max(B.Held(np.array([[3.0, 1, 2, 0, 5, 4]]), np.array([[True, True, True, True, False, True]])), 3)
    assert out.ok.tolist() == [[False, False, True, True, False, False]] and out.v[0, 2:4].tolist() == [3.0, 2.0]
    assert not B.rolling_max(B.Held(np.ones((1, 2)), np.ones((1, 2), bool)), 5).ok.any()


@pytest.mark.parametrize("w", [2, 7, 40, 500])
def test_fits_equal_those_of_spark_windows(spark, w):
    value = (
        F.when(F.col("id") % 150 == 0, None)
        .when((F.col("id") > 200) & (F.col("id") < 260), 2.3)
        .when(F.col("id") == 390, float("nan"))
        .otherwise(F.sin("id") * 5 + F.when(F.col("id") % 37 == 0, 1e6).otherwise(0.0))
    )
    rows = spark.range(1, 401).select(F.lit("s").alias("series"), F.col("id").alias("index"), value.alias("value"))
    theirs = W.rolling_ols(rows, "series", "index", "value", w, index="index", block_rows=90).orderBy("index").collect()
    outputs = {"slope": "double", "r2": "double", "sigma": "double"}
    for block_rows in (None, 90):
        ours = B.each_block(
            rows, "series", "index", "value", [w, 3], (1, 0), outputs,
            lambda fits: {"slope": fits.slope(), "r2": fits.r2(), "sigma": fits.sigma()}, index="index", block_rows=block_rows,
        )
        ours = ours.filter(F.col("window_length_level") == w).orderBy("index").collect()
        for c in outputs:
            assert [repr(r[c]) for r in ours] == [repr(r[c]) for r in theirs]


def test_a_noise_sweep_moves_its_rows_once(series):
    """Levels and lengths become rows after the one exchange, and nothing is sorted for them."""
    rows = series([i / 3 for i in range(300)])
    for out in (
        D.sweep_noise(rows, "series", "index", "value", [0.0, 2.0, 5.0], [5, 20], index="index"),
        D.noise_fit_stats(rows, "series", "index", "value", [0.0, 2.0, 5.0], {5: "2%", 20: "7%"}, index="index"),
    ):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Window" not in plan
        moved = plan[plan.index("Exchange") :]
        assert moved.count("explode") == 1  # the copies at the blocks' edges
        assert "md5" not in moved
