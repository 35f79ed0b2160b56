"""Rolling statistics over row frames, per series.

Each public function takes a series table and returns it with columns added.  The functions named
``*_columns`` work on a ``Layout`` so that a detector can chain them over one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .layout import BLOCK_ROWS, ROW, Layout, keys_of, lay_out, per_key

KERNEL_SD = 0.3706506  # sd of the normal kernel per unit of bandwidth (quartiles at +-bandwidth/4)
KERNEL_REACH = 4.0  # kernel is cut at this many sd
MAX_SHIFTS = 128  # widest reach in rows that is written as shifted columns


def rolling_mean(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    cols: Sequence[str] | dict[str, str],
    w: int = 7,
    index: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Right-aligned mean of ``w`` rows; NULL until full and wherever a member is NULL.

    ``cols`` maps input to output columns; a plain list writes ``roll_<col>``.
    """
    if not isinstance(cols, dict):
        cols = {c: f"roll_{c}" for c in cols}
    layout = lay_out(df, keys, t, before=w - 1, index=index, block_rows=block_rows)
    sums, out = _over_cells({(n, c): f(c) for c in cols for n, f in (("n", F.count), ("sum", F.sum))}, layout, w)

    def mean(c: str) -> Column:
        n, total = (sums[n, c][0] + F.coalesce(sums[n, c][1], F.lit(0)) for n in ("n", "sum"))
        return F.when(n == w, total.cast("double") / F.lit(w))

    return out.add({name: mean(c) for c, name in cols.items()}).finish().drop("_head", "_tail")


def _over_cells(
    aggregates: dict[tuple[str, str], Column], layout: Layout, n: int
) -> tuple[dict[tuple[str, str], tuple[Column, Column]], Layout]:
    """For each aggregate its value over the head and over the tail of every row's frame of ``n`` rows."""
    layout, head, tail = layout.cells(n)
    fields = {key: f"f{i}" for i, key in enumerate(aggregates)}
    for side, window in (("_head", head), ("_tail", tail)):
        layout = layout.add({side: F.struct(*[c.over(window).alias(fields[key]) for key, c in aggregates.items()])})
    layout = layout.add({"_tail": layout.begun(F.col("_tail"), n)})
    layout = layout.with_rows(layout.df.drop("_cell"))
    return {key: (F.col(f"_head.{f}"), F.col(f"_tail.{f}")) for key, f in fields.items()}, layout


def rolling_max(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    k: int,
    name: str = "rollmax",
    index: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    layout = lay_out(df, keys, t, before=k - 1, index=index, block_rows=block_rows)
    return max_column(name, c, layout, k).finish()


def max_column(name: str, c: str, layout: Layout, k: int) -> Layout:
    """The layout with the maximum of a column over ``k`` rows; NULL until full."""
    held, layout = _over_cells({("n", c): F.count(c), ("max", c): F.max(c)}, layout, k)
    n = held["n", c][0] + F.coalesce(held["n", c][1], F.lit(0))
    out = layout.add({name: F.when(n == k, F.greatest(*held["max", c]))})
    return out.with_rows(out.df.drop("_head", "_tail"))


def axis_grain(df: DataFrame, t: str, x_unit: str = "s") -> tuple[Column, float]:
    """The regressor in the axis' own grain, and how many units of ``x_unit`` a grain is."""
    kind = df.schema[t].dataType.typeName()
    if kind == "date":
        return F.unix_date(F.col(t)).cast("double"), 1.0 if x_unit == "day" else 86400.0
    if kind.startswith("timestamp"):
        seconds = F.unix_micros(F.col(t).cast("timestamp")) / F.lit(1e6)
        return seconds, 1.0 / 86400.0 if x_unit == "day" else 1.0
    return F.col(t).cast("double"), 1.0


def axis_value(df: DataFrame, t: str, x_unit: str = "s") -> Column:
    """Seconds (or days) for a time axis, the number itself for an index axis."""
    x, scale = axis_grain(df, t, x_unit)
    return x if scale == 1.0 else x * F.lit(scale)


WIDTH = "_width"


@dataclass(frozen=True)
class Fit:
    """A layout on which rolling fits are made, with its regressor ``_x``; a row for each width.

    A frame is the tail of one cell of its width and the head of the next, so rows cost the same at any
    width. A window's result depends on its rows and where cells begin, which is counted from the start
    of the series: not on the other widths of a call, nor on where blocks begin.
    """

    layout: Layout
    value: str
    scale: float
    windows: tuple[int, ...]

    @classmethod
    def over(
        cls,
        df: DataFrame,
        keys: str | Sequence[str],
        t: str,
        value: str,
        windows: Sequence[int],
        reach: tuple[int, int] = (1, 0),
        x_unit: str = "s",
        index: str | None = None,
        block_rows: int | None = None,
    ) -> Fit:
        """``reach`` is how far the rows need fits before and after themselves."""
        x, scale = axis_grain(df, t, x_unit)
        before, after = max(windows) + reach[0], reach[1]
        layout = lay_out(df.withColumn("_x", x), keys, t, before, after, index, block_rows or BLOCK_ROWS)
        return cls(layout.each(WIDTH, windows), value, scale, tuple(windows))

    def _side(self, layout: Layout, side: str, window: WindowSpec) -> Layout:
        """Running moments of each cell from one end: count, sums about the means, and the means.

        Means are taken as distances from the cell's first row, so those of equal values are exact.
        """
        layout = layout.add({"_x0": F.first("_x").over(window), "_y0": F.first(self.value).over(window)})
        x, y = F.col("_x") - F.col("_x0"), F.col(self.value) - F.col("_y0")
        held = {"n": F.count(self.value), "mx": F.avg(F.when(y.isNotNull(), x)), "my": F.avg(y)}
        held |= {"xx": F.regr_sxx(self.value, "_x"), "xy": F.regr_sxy(self.value, "_x"), "yy": F.regr_syy(self.value, "_x")}
        parts = [c.over(window).alias(n) for n, c in held.items()]
        layout = layout.add({side: F.struct(*parts, F.col("_x0").alias("x0"), F.col("_y0").alias("y0"))})
        return layout.with_rows(layout.df.drop("_x0", "_y0"))

    def frames(self) -> Layout:
        """The layout with ``_frame`` of each row and width: n, xx, xy, yy, mx, my."""
        layout, head, tail = self.layout.cells(F.col(WIDTH))
        layout = self._side(self._side(layout, "_head", head), "_tail", tail)
        # Only constants can be offsets of a lag.
        begun = [F.when(F.col(WIDTH) == w, layout.begun(F.col("_tail"), w)) for w in self.windows]
        layout = layout.add({"_tail": F.coalesce(*begun)})
        h, u = ({p: F.col(f"{side}.{p}") for p in ("n", "mx", "my", "xx", "xy", "yy", "x0", "y0")} for side in ("_head", "_tail"))
        # Of two parts: sums about the common mean are theirs and the distance of their means, weighted.
        apart = {f"_d{v}": u[f"{v}0"] - h[f"{v}0"] + (u[f"m{v}"] - h[f"m{v}"]) for v in "xy"}
        layout = layout.add({"_n": h["n"] + F.coalesce(u["n"], F.lit(0)), **apart})
        n, dx, dy = F.col("_n"), F.col("_dx"), F.col("_dy")
        layout = layout.add({"_both": F.try_divide(h["n"] * u["n"], n), "_share": F.try_divide(u["n"], n)})
        none = F.lit(0.0)
        spread = {"xx": dx * dx, "xy": dx * dy, "yy": dy * dy}
        parts = [n.alias("n")]
        parts += [(h[p] + F.coalesce(u[p] + d * F.col("_both"), none)).alias(p) for p, d in spread.items()]
        parts += [
            (h[f"{v}0"] + (h[f"m{v}"] + F.coalesce(d * F.col("_share"), none))).alias(f"m{v}")
            for v, d in (("x", dx), ("y", dy))
        ]
        layout = layout.add({"_frame": F.struct(*parts)})
        return layout.with_rows(layout.df.drop("_cell", "_head", "_tail", "_n", "_dx", "_dy", "_both", "_share"))

    def columns(self, parts: Sequence[str] = ("slope",)) -> Layout:
        """The layout with ``_<part>`` of each row and width: slope, intercept, r2, sigma; NULL until full."""
        layout = self.frames()
        at = {p: F.col(f"_frame.{p}") for p in ("n", "xx", "xy", "yy", "mx", "my")}
        xx, xy, yy = at["xx"], at["xy"], at["yy"]
        width = F.col(WIDTH)
        slope = F.try_divide(xy, xx)
        rest = F.greatest(yy - F.try_divide(xy * xy, xx), F.lit(0.0))
        formula = {
            "slope": slope / F.lit(self.scale),
            "intercept": at["my"] - slope * at["mx"],
            "r2": F.try_divide(xy * xy, xx * yy),
            "sigma": F.sqrt(F.try_divide(rest, (width - 2).cast("double"))),
        }
        layout = layout.add({f"_{p}": F.when(at["n"] == width, formula[p]) for p in parts})
        return layout.with_rows(layout.df.drop("_x", "_frame"))


def rolling_ols(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    w: int,
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Rolling fit of ``c`` on the axis: slope, intercept, r2, sigma and the one-step forecast.

    The forecast at a row comes from the fit that ends one row earlier.  On an axis in seconds
    slopes are per second, so thresholds on them are of the order 1e-9.
    """
    parts = ("slope", "intercept", "r2", "sigma")
    layout = Fit.over(df, keys, t, c, [w], (1, 0), x_unit, index, block_rows).columns(parts)
    before = {p: F.lag(f"_{p}").over(layout.window) for p in ("intercept", "slope")}
    forecast = before["intercept"] + before["slope"] * axis_value(df, t, x_unit)
    out = layout.add({"forecast": forecast}).finish()
    return out.withColumnsRenamed({f"_{p}": p for p in parts})


def gradient_column(c: str, layout: Layout) -> Column:
    """Central difference with unit step, one-sided at the two ends of the series."""
    w, here = layout.window, F.col(c)
    ahead, behind = F.lead(c).over(w), F.lag(c).over(w)
    middle = (ahead - behind) / 2.0
    return F.when(F.col(ROW) == 1, ahead - here).when(F.lead(ROW).over(w).isNull(), here - behind).otherwise(middle)


def gradient(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    name: str = "gradient",
    index: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    layout = lay_out(df, keys, t, before=1, after=1, index=index, block_rows=block_rows)
    return layout.add({name: gradient_column(c, layout)}).finish()


def shift(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    n: int,
    name: str | None = None,
    index: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Value ``n`` rows earlier (later when negative)."""
    layout = lay_out(df, keys, t, before=max(n, 0), after=max(-n, 0), index=index, block_rows=block_rows)
    return layout.add({name or f"{c}_shift": F.lag(c, n).over(layout.window)}).finish()


def sign_change(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    index: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Row difference ``d`` and a flag where its sign differs from the previous row's."""
    layout = lay_out(df, keys, t, before=2, index=index, block_rows=block_rows)
    layout = layout.add({"d": F.col(c) - F.lag(c).over(layout.window)})
    flip = F.signum("d") != F.lag(F.signum("d")).over(layout.window)
    return layout.add({"flag": flip}).finish()


def series_bounds(df: DataFrame, keys: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each column within the series, as columns of every row."""
    keys = keys_of(keys)
    bounds = [
        f(c).alias(f"{n}_{c}") for c in cols for n, f in (("max", F.max), ("min", F.min))
    ]
    return df.join(per_key(df.groupBy(*keys).agg(*bounds)), keys)


def _smooth_dense(
    df: DataFrame, keys: list[str], t: str, c: str, sd: float, reach: int, name: str, block_rows: int
) -> DataFrame:
    layout = lay_out(df, keys, t, before=reach, after=reach, index=t, block_rows=block_rows)
    top, bottom = [], []
    for step in range(-reach, reach + 1):
        weight = F.lit(math.exp(-0.5 * (step / sd) ** 2))
        value = F.lag(c, step).over(layout.window) if step else F.col(c)
        top.append(F.coalesce(value * weight, F.lit(0.0)))
        bottom.append(F.when(value.isNotNull(), weight).otherwise(F.lit(0.0)))
    return layout.add({name: F.try_divide(reduce(add, top), reduce(add, bottom))}).finish()


def kernel_smooth(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    c: str,
    bandwidth: float,
    name: str = "smooth",
    x_unit: str = "day",
    index: str | None = None,
    block_rows: int = BLOCK_ROWS,
    bin_reaches: int = 256,
) -> DataFrame:
    """Normal-kernel (Nadaraya-Watson) mean of ``c`` around each row, within 4 kernel sd.

    On a dense index (``index=t``) the kernel has the same few weights at every row, so the mean is
    a sum of shifted columns.  On any other axis rows are grouped by bins of the axis, many reaches
    wide, with the rows near a bin's edge copied to its neighbour; the frame is a range of the axis.
    """
    keys = keys_of(keys)
    sd = KERNEL_SD * bandwidth
    reach = KERNEL_REACH * sd
    if index is not None and index == t and reach <= MAX_SHIFTS:
        return _smooth_dense(df, keys, t, c, sd, int(reach), name, block_rows)
    width = reach * bin_reaches
    out = df.withColumn("_x", axis_value(df, t, x_unit))
    home = F.floor(F.col("_x") / width)
    offset = F.col("_x") - home * width
    copies = F.array(
        home,
        F.when(offset >= width - reach, home + 1),
        F.when(offset <= reach, home - 1),
    )
    out = out.withColumn("_bin", F.explode(F.array_compact(copies))).withColumn("_home", F.col("_bin") == home)
    out = out.withColumn("_pair", F.when(F.col(c).isNotNull(), F.struct("_x", F.col(c).cast("double").alias("_y"))))
    # A range frame with fractional bounds exists in SQL text only.
    place = ", ".join(f"`{k}`" for k in (*keys, "_bin"))
    near = f"RANGE BETWEEN {reach!r}D PRECEDING AND {reach!r}D FOLLOWING"
    out = out.withColumn("_near", F.expr(f"collect_list(_pair) OVER (PARTITION BY {place} ORDER BY _x {near})"))

    def weight(p: Column) -> Column:
        return F.exp(-0.5 * F.pow((p["_x"] - F.col("_x")) / F.lit(sd), F.lit(2.0)))

    sums = F.aggregate(
        "_near",
        F.struct(F.lit(0.0).alias("wy"), F.lit(0.0).alias("w")),
        lambda acc, p: F.struct(
            (acc["wy"] + weight(p) * p["_y"]).alias("wy"), (acc["w"] + weight(p)).alias("w")
        ),
        lambda acc: F.try_divide(acc["wy"], acc["w"]),
    )
    return out.filter("_home").withColumn(name, sums).drop("_x", "_bin", "_home", "_pair", "_near")
