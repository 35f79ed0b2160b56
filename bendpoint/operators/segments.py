"""The single change in mean and variance of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import BLOCK, ROW, SERIES_ROWS, keys_of, lay_out, per_key

MIN_VARIANCE = 1e-10


def running_totals(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    cols: dict[str, Column],
    index: str | None = None,
    block_rows: int = SERIES_ROWS,
) -> DataFrame:
    """Running sums along each series, plus the row index ``index``.

    Long series are summed block by block; a table with one row per block carries the sums over.
    """
    keys = keys_of(keys)
    layout = lay_out(df, keys, t, index=index, block_rows=block_rows)
    inside = {out: F.sum(c).over(layout.running()) for out, c in cols.items()}
    rows = layout.add(inside).df.withColumn("index", F.col(ROW))
    if BLOCK not in layout.added:
        return rows.drop(*layout.added)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        layout.df.groupBy(*keys, BLOCK)
        .agg(*[F.sum(c).alias(f"_{out}") for out, c in cols.items()])
        .select(*keys, BLOCK, *[F.sum(f"_{out}").over(earlier).alias(f"_{out}") for out in cols])
    )
    total = {out: F.col(out) + F.coalesce(F.col(f"_{out}"), F.lit(0)) for out in cols}
    return (
        rows.join(carried, [*keys, BLOCK])
        .withColumns(total)
        .drop(*[f"_{out}" for out in cols], *layout.added)
    )


def meanvar_split(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    min_seg: int = 2,
    index: str | None = None,
    block_rows: int = SERIES_ROWS,
) -> DataFrame:
    """The best single change in mean and variance of each series, and whether it counts as one.

    Normal likelihood with the modified BIC: a split after row tau costs
    tau ln s1 + (n - tau) ln s2 + ln tau + ln(n - tau); it is accepted when it beats n ln s by more
    than 4 ln n.  Output per series: n, tau, at (the last row's axis value before the change),
    null_cost, cost, accepted.  ``index`` names a dense row index of a series without NULLs; without
    it NULLs are left out and the rest is numbered.
    """
    keys = keys_of(keys)
    rows = df if index is not None else df.filter(F.col(value).isNotNull())
    # Centred values keep the digits of the running sums; their own total is 0.
    whole = rows.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n"), F.var_pop(value).alias("_var")
    )
    centred = rows.join(per_key(whole), keys).withColumn("_v", F.col(value) - F.col("_mean"))
    sums = running_totals(
        centred, keys, t, {"_s1": F.col("_v"), "_s2": F.col("_v") * F.col("_v")}, index, block_rows
    )

    def log_variance(s1: Column, s2: Column, m: Column) -> Column:
        return F.log(F.greatest(s2 / m - F.pow(s1 / m, F.lit(2.0)), F.lit(MIN_VARIANCE)))

    tau, n = F.col("index").cast("double"), F.col("_n").cast("double")
    rest = F.when(n > tau, n - tau)
    cost = (
        tau * log_variance(F.col("_s1"), F.col("_s2"), tau)
        + rest * log_variance(-F.col("_s1"), n * F.col("_var") - F.col("_s2"), rest)
        + F.log(tau)
        + F.log(rest)
    )
    allowed = (F.col("index") >= min_seg) & (F.col("_n") - F.col("index") >= min_seg)
    best = sums.groupBy(*keys).agg(
        F.first("_n").alias("n"),
        F.first(n * F.log(F.greatest("_var", F.lit(MIN_VARIANCE)))).alias("null_cost"),
        F.min(F.when(allowed, F.struct(cost.alias("cost"), F.col("index"), F.col(t).alias("at")))).alias("_best"),
    )
    return best.select(
        *keys,
        "n",
        F.col("_best.index").alias("tau"),
        F.col("_best.at").alias("at"),
        "null_cost",
        F.col("_best.cost").alias("cost"),
        (F.col("null_cost") - F.col("_best.cost") > 4.0 * F.log(F.col("n").cast("double"))).alias("accepted"),
    )
