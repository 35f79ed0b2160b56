"""Blocked execution gives what a window over the whole series gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bendpoint.operators import detectors as D
from bendpoint.operators import layout as L
from bendpoint.operators import perturb as N
from bendpoint.operators import reconstruct as E
from bendpoint.operators import rolling as W
from bendpoint.operators import segments as S


@pytest.fixture(scope="module")
def wave(spark):
    """Two series of very different length on a dense index."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("series"),
        F.when(F.col("id") < 2500, F.col("id") + 1).otherwise(F.col("id") - 2499).alias("index"),
        (F.sin(F.col("id") / 40.0) * 10 + F.pmod(F.col("id") * 7919, F.lit(101)) / 25.0).alias("value"),
    )
    return rows.persist()


def same(a, b, tolerance=1e-7):
    """Equal rows up to rounding errors, in any order."""
    columns = a.columns
    doubles = [f.name for f in a.schema.fields if f.dataType.typeName() == "double"]
    exact = [c for c in columns if c not in doubles]
    a, b = (x.select(*columns).toPandas().sort_values([*exact, *doubles], ignore_index=True) for x in (a, b))
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a[exact], b[exact])
    for c in doubles:
        np.testing.assert_allclose(a[c], b[c], rtol=tolerance, atol=tolerance)


def test_numbering_by_bins_with_a_crowded_bin(spark):
    # A third of the rows sit in one thousandth of the time span.
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), (F.col("id") % 2).cast("string"))).alias("k"),
        F.timestamp_micros(
            F.when(F.col("id") % 3 == 0, F.col("id") + 5_000_000).otherwise(F.col("id") * 10_000)
        ).alias("ts"),
        "id",
    )
    whole = rows.withColumn("index", F.row_number().over(Window.partitionBy("k").orderBy("ts")).cast("long"))
    binned = L.add_index(rows, "k", "ts", series_rows=50)
    assert "_bin" not in binned.columns
    same(whole.select("k", "id", "index"), binned.select("k", "id", "index"))


def test_equal_times_are_refused_or_ordered_by_the_tie(spark):
    rows = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 6, 3)], "k string, t long, id long")
    with pytest.raises(Exception, match="same series and axis value"):
        L.add_index(rows, "k", "t").collect()
    tied = L.add_index(rows, "k", "t", tie=["id"])
    assert [r["index"] for r in tied.orderBy("id").collect()] == [1, 2, 3]


@pytest.mark.parametrize(
    "run",
    [
        lambda df, **kw: W.rolling_mean(df, "series", "index", ["value"], 7, index="index", **kw),
        lambda df, **kw: W.rolling_max(df, "series", "index", "value", 5, index="index", **kw),
        lambda df, **kw: W.gradient(df, "series", "index", "value", index="index", **kw),
        lambda df, **kw: W.shift(df, "series", "index", "value", -4, index="index", **kw),
        lambda df, **kw: W.sign_change(df, "series", "index", "value", index="index", **kw),
        lambda df, **kw: W.rolling_ols(df, "series", "index", "value", 9, index="index", **kw),
        lambda df, **kw: W.rolling_ols(df, "series", "index", "value", 40, index="index", **kw),
        lambda df, **kw: W.kernel_smooth(df, "series", "index", "value", 10, index="index", **kw),
        lambda df, **kw: D.gradient_peaks(df, "series", "index", "value", 12, 5, "equal", digits=6, index="index", **kw),
        lambda df, **kw: D.gradient_peaks(df, "series", "index", "value", 30, 8, index="index", **kw),
        lambda df, **kw: D.gradient_ratio(df, "series", "index", "value", 7, 2.0, rising=True, index="index", **kw),
        lambda df, **kw: S.running_totals(df, "series", "index", {"total": F.col("value")}, index="index", **kw),
        lambda df, **kw: S.meanvar_split(df, "series", "index", "value", index="index", **kw),
    ],
)
def test_blocks_change_nothing(wave, run):
    same(run(wave), run(wave, block_rows=64))


def test_a_width_does_not_depend_on_the_others(wave, spark):
    """Flags and fits of a width are the same alone and in a sweep, on a signal and on a broken line."""
    line = spark.range(1, 1501).select(
        F.lit("line").alias("series"),
        F.col("id").alias("index"),
        (F.least(F.col("id") / 30.0, 20 - F.col("id") / 40.0) + F.greatest(F.lit(0.0), (F.col("id") - 900) / 70.0)).alias("value"),
    )
    rule = D.PeakRule(k=7, lead=4, floor=0.0)
    for rows in (wave.select("series", "index", "value"), line):
        alone = D.sweep_windows(rows, "series", "index", "value", [7], rule)
        swept = D.sweep_windows(rows, "series", "index", "value", [7, 42], rule)
        swept = swept.filter(F.col("window_length_level") == alone.first()["window_length_level"])
        assert sorted(map(str, swept.collect())) == sorted(map(str, alone.collect()))


def test_kernel_on_any_axis_equals_kernel_on_dense_index(wave):
    dense = W.kernel_smooth(wave, "series", "index", "value", 10, index="index")
    ranged = W.kernel_smooth(wave, "series", "index", "value", 10, bin_reaches=2)
    same(dense, ranged)


def test_knots_carried_over_bins(wave):
    knots = wave.filter(F.col("index") % 700 == 10)
    narrow = E.interpolate_linear(knots, wave, "series", "index", bin_width=32)
    wide = E.interpolate_linear(knots, wave, "series", "index", bin_width=1 << 30)
    same(wide, narrow)
    flagged = wave.withColumn("cp", F.col("index") % 700 == 10)
    lines = E.reconstruct(flagged, "series", "index", bin_width=32)
    same(wide, lines.select("series", "index", "approx_value"))


def test_knots_on_a_time_axis(wave):
    stamped = wave.withColumn("t", F.timestamp_seconds(F.col("index") * 60)).select("series", "t", "index", "value")
    knots = stamped.filter(F.col("index") % 300 == 7)
    narrow = E.interpolate_linear(knots, stamped, "series", "t", bin_width=100)
    by_index = E.interpolate_linear(knots, stamped, "series", "index")
    same(
        stamped.join(narrow, ["series", "t"]).select("series", "index", "approx_value"),
        by_index.select("series", "index", "approx_value"),
    )


def test_results_do_not_depend_on_the_number_of_tasks(spark, wave):
    def run():
        noisy = N.add_noise(wave, "series", "index", "value", 3, seed=4)
        dealt = N.permute(wave, "series", "index", "value", seed=4)
        return noisy.join(dealt.select("series", "index", "sample"), ["series", "index"]).persist()

    many = run()
    many.count()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        same(many, run())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_permutation_in_bins_keeps_the_values(wave):
    whole = N.permute(wave, "series", "index", "value", seed=1)
    binned = N.permute(wave, "series", "index", "value", seed=1, series_rows=100)
    same(whole, binned)
    same(wave.select("series", "value"), whole.select("series", F.col("sample").alias("value")))
