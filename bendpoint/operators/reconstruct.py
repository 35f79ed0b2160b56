"""Piecewise-linear reconstruction of a series through its change points, and its score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import pearson, rmse
from .layout import SERIES_ROWS, add_index, is_daily, keys_of, position


def _around(
    df: DataFrame, keys: list[str], t: str, knot: Column, bin_width: int, first: Sequence[str] = ()
) -> DataFrame:
    """Add the knots (t, v) at or before and at or after each row as ``_prev`` and ``_next``.

    ``knot`` is NULL on rows that are none; ``first`` orders rows at the same place.  Rows look for
    knots within their bin; where there is none, the bin's carried knot is used, found on a table
    of one row per bin.  Bins are stretches of an index axis, or of the numbered rows of a time
    axis.  A daily axis needs no bins.
    """
    place = list(keys)
    df = df.withColumn("_knot", knot)
    binned = not is_daily(df, t)
    if binned:
        at = position(df, t)
        if df.schema[t].dataType.typeName().startswith("timestamp"):
            df, at = add_index(df, keys, t, tie=first, name="_place", series_rows=bin_width), F.col("_place")
        df = df.withColumn("_bin", F.floor(at / bin_width)).drop("_place")
        place.append("_bin")

    def last_seen(window, c: str, to: int = 0) -> Column:
        return F.last(c, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, to))

    inside = Window.partitionBy(*place)
    seen = df.withColumns(
        {
            "_prev": last_seen(inside.orderBy(t, *first), "_knot"),
            "_next": last_seen(inside.orderBy(F.col(t).desc(), *first), "_knot"),
        }
    )
    if binned:
        by_bin = Window.partitionBy(*keys)
        carried = (
            df.groupBy(*place)
            .agg(F.min("_knot").alias("_first"), F.max("_knot").alias("_last"))
            .select(
                *place,
                last_seen(by_bin.orderBy("_bin"), "_last", -1).alias("_carry_prev"),
                last_seen(by_bin.orderBy(F.col("_bin").desc()), "_first", -1).alias("_carry_next"),
            )
        )
        seen = (
            seen.join(carried, place)
            .withColumns({"_prev": F.coalesce("_prev", "_carry_prev"), "_next": F.coalesce("_next", "_carry_next")})
            .drop("_bin", "_carry_prev", "_carry_next")
        )
    return seen.drop("_knot")


def _line(df: DataFrame, t: str) -> Column:
    """The straight line between the neighbouring knots at the row's place."""
    at, a, b = (position(df, t, c) for c in (F.col(t), F.col("_prev.t"), F.col("_next.t")))
    share = F.try_divide((at - a).cast("double"), (b - a).cast("double"))
    return F.when(a == b, F.col("_prev.v")).otherwise(
        F.col("_prev.v") + share * (F.col("_next.v") - F.col("_prev.v"))
    )


def knots_around(
    grid: DataFrame,
    knots: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str = "value",
    name: str | None = None,
    bin_width: int = SERIES_ROWS,
) -> DataFrame:
    """For each grid row the knot at or before it and the knot at or after it.

    Gives prev_t, prev_value, next_t, next_value (NULL beyond the outer knots) and, as ``name``,
    the line between them.
    """
    keys = keys_of(keys)
    rows = grid.select(*keys, t, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_grid"))
    marks = knots.select(*keys, t, F.col(value).cast("double").alias("_v"), F.lit(False).alias("_grid"))
    both = rows.unionByName(marks.filter(F.col("_v").isNotNull()))
    knot = F.when(~F.col("_grid"), F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    # At the same place a knot comes before the grid row, in either direction.
    around = _around(both, keys, t, knot, bin_width, first=["_grid"]).filter("_grid")
    ends = [
        F.col(f"_{side}.{field}").alias(f"{side}_{text}")
        for side in ("prev", "next")
        for field, text in (("t", "t"), ("v", "value"))
    ]
    line = [_line(around, t).alias(name)] if name else []
    return around.select(*keys, t, *ends, *line)


def interpolate_linear(
    knots: DataFrame,
    grid: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str = "value",
    name: str = "approx_value",
    bin_width: int = SERIES_ROWS,
) -> DataFrame:
    """Straight lines between neighbouring knots on the grid; NULL outside the outer knots."""
    return knots_around(grid, knots, keys, t, value, name, bin_width).select(*keys_of(keys), t, name)


def reconstruct(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str = "value",
    cp: str = "cp",
    name: str = "approx_value",
    bin_width: int = SERIES_ROWS,
) -> DataFrame:
    """The series with the line through its own flagged points beside it; keys may hold a level."""
    knot = F.when(F.col(cp), F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v")))
    around = _around(df, keys_of(keys), t, knot, bin_width)
    return around.withColumn(name, _line(around, t)).drop("_prev", "_next")


def score_reconstruction(
    df: DataFrame, by: Sequence[str], value: str = "value", approx: str = "approx_value"
) -> DataFrame:
    """RMSE and correlation (named rsquared, as in the study, but not squared) per group."""
    both = df.filter(F.col(value).isNotNull() & F.col(approx).isNotNull())
    return both.groupBy(*by).agg(rmse(value, approx).alias("rmse"), pearson(value, approx).alias("rsquared"))


def reconstruction_long(
    df: DataFrame, ids: Sequence[str], value: str = "value", approx: str = "approx_value"
) -> DataFrame:
    """Complete rows with the series and its reconstruction under each other."""
    both = F.array(
        F.struct(F.lit("f(x)").alias("variables"), F.col(value).alias("value")),
        F.struct(F.lit("Approxed f(x)").alias("variables"), F.col(approx).alias("value")),
    )
    return df.na.drop("any", subset=[*ids, value, approx]).select(*ids, F.inline(both))
