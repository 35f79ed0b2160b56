"""Controlled changes to a series, for robustness checks.  All draws are fixed by row and seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import axis_key, gaussian, uniform
from .layout import SERIES_ROWS, add_index, keys_of, per_key
from .reconstruct import interpolate_linear


def piecewise_linear(
    spark: SparkSession, knots: Sequence[tuple[float, float]], n: int, series: str = "f"
) -> DataFrame:
    """The broken line through the knots at x = 1..n: series, index, value."""
    corners = spark.createDataFrame(
        [(series, int(x), float(y)) for x, y in knots], "series string, index long, value double"
    )
    grid = spark.range(1, n + 1).select(F.lit(series).alias("series"), F.col("id").alias("index"))
    lines = interpolate_linear(corners, grid, "series", "index", name="value")
    return lines.filter(F.col("value").isNotNull())


def add_noise(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    level: float,
    seed: int = 0,
    name: str = "noise",
) -> DataFrame:
    """Add ``level * U(0, 1)``: one-sided, although the study calls the level a standard deviation."""
    draw = uniform(*keys_of(keys), axis_key(df, t), F.lit(float(level)), F.lit(seed))
    return df.withColumn(name, F.col(c) + F.lit(float(level)) * draw).withColumn(
        "standard_deviation", F.lit(float(level))
    )


def add_white_noise(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    sd: float,
    seed: int = 0,
    name: str = "noise",
) -> DataFrame:
    draw = gaussian(*keys_of(keys), axis_key(df, t), F.lit(seed))
    return df.withColumn(name, F.col(c) + F.lit(float(sd)) * draw)


def jitter(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    factor: float = 1.0,
    seed: int = 0,
    name: str = "jittered",
) -> DataFrame:
    """Add U(-a, a) with a = factor / 5 times the smallest gap between a series' distinct values.

    Values are first rounded to about three digits of the range, so that rounding errors make no
    gaps.  That leaves at most some 10,000 distinct values in a series for the window below.
    """
    keys = keys_of(keys)
    spread = df.groupBy(*keys).agg(F.min(c).alias("_lo"), (F.max(c) - F.min(c)).alias("_z"))
    scale = F.when(F.col("_z") != 0, F.col("_z")).when(F.col("_lo") != 0, F.abs("_lo")).otherwise(1.0)
    spread = spread.select(
        *keys, scale.alias("_z"), F.pow(F.lit(10.0), 3 - F.floor(F.log10(scale))).alias("_p")
    )
    steps = (
        df.join(per_key(spread), keys)
        .select(*keys, "_z", "_p", F.rint(F.col(c) * F.col("_p")).alias("_k"))
        .distinct()
        .withColumn("_gap", F.col("_k") - F.lag("_k").over(Window.partitionBy(*keys).orderBy("_k")))
        .groupBy(*keys, "_z", "_p")
        .agg(F.min("_gap").alias("_gap"), F.max("_k").alias("_k"))
    )
    alone = F.when(F.col("_k") != 0, F.abs("_k") / F.col("_p") / 10.0).otherwise(F.col("_z") / 10.0)
    amount = F.lit(factor / 5.0) * F.coalesce(F.col("_gap") / F.col("_p"), alone)
    draw = uniform(*keys, axis_key(df, t), F.lit("jitter"), F.lit(seed))
    return (
        df.join(per_key(steps.select(*keys, amount.alias("_a"))), keys)
        .withColumn(name, F.col(c) + F.col("_a") * (2.0 * draw - 1.0))
        .drop("_a")
    )


def permute(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    seed: int = 0,
    name: str = "sample",
    series_rows: int = SERIES_ROWS,
) -> DataFrame:
    """Deal the values of a series out again over its rows, in an order fixed by the seed."""
    keys = keys_of(keys)
    places = add_index(df, keys, t, name="_place", series_rows=series_rows)
    draw = (uniform(*keys, axis_key(df, t), F.lit("permute"), F.lit(seed)) * 4294967296.0).cast("long")
    dealt = add_index(
        df.select(*keys, t, F.col(c).alias(name), draw.alias("_draw")),
        keys,
        "_draw",
        tie=[t],
        name="_place",
        series_rows=series_rows,
    )
    return places.join(dealt.select(*keys, "_place", name), [*keys, "_place"]).drop("_place")
