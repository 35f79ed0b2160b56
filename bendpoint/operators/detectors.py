"""Change-point detectors built on rolling regression.

The chain is: rolling slope -> absolute numerical gradient of the slope (the second derivative) ->
a rule that turns it into flags.  All window lengths and noise levels of a sweep run over one shuffle
and one sort of the rows as they are; they become rows of their own after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import axis_key, uniform
from .frames import WIDTH, Fitted, Held, all_of, each_block, half_up, rolling_max
from .layout import BLOCK_ROWS, keys_of, lay_out
from .rolling import kernel_smooth


@dataclass(frozen=True)
class PeakRule:
    """Flag where the rolling maximum rises and then holds.

    ``plateau`` "equal" asks for the same maximum ``lead`` rows ahead, "sign" only for one of the
    same sign.  ``digits`` rounds the second derivative, ``slope_digits`` the slope before it.
    ``floor`` is the value the maximum must exceed; None asks for no such thing.
    """

    k: int
    lead: int | None = None
    plateau: str = "equal"
    digits: int | None = None
    slope_digits: int | None = None
    floor: float | None = None
    on: str = "gradient"

    @property
    def ahead(self) -> int:
        return self.k - 1 if self.lead is None else self.lead

    @property
    def reach(self) -> tuple[int, int]:
        return self.k + 1, self.ahead + 1

    def apply(self, signal: Held) -> dict[str, Held]:
        peak = rolling_max(signal, self.k)
        later = peak.at(self.ahead)
        if self.plateau == "equal":
            holds = peak.same(later)
        else:
            holds = Held(np.sign(peak.v), peak.ok).same(Held(np.sign(later.v), later.ok))
        floor = [] if self.floor is None else [peak.over(self.floor)]
        return {"rollmax": peak, "cp": all_of(peak.minus(peak.at(-1)).over(0.0), holds, *floor)}


@dataclass(frozen=True)
class RatioRule:
    """Flag where the second derivative is ``cp_factor`` times the previous one, itself above ``epsilon``.

    Written as a product, so a zero predecessor gives no flag and no division error.  ``rising``
    also asks for an increase (it only matters for factors below 1).
    """

    cp_factor: float
    epsilon: float
    rising: bool = False
    slope_digits: int | None = None
    digits: int | None = None
    on: str = "gradient"

    reach = (1, 1)

    def apply(self, signal: Held) -> dict[str, Held]:
        previous = signal.at(-1)
        rises = [signal.minus(previous).over(0.0)] if self.rising else []
        many = signal.over(Held(previous.v * float(self.cp_factor), previous.ok))
        return {"cp": all_of(many, previous.over(float(self.epsilon)), *rises)}


Rule = PeakRule | RatioRule


def _signals(fits: Fitted, rule: Rule) -> dict[str, Held]:
    slope = half_up(fits.slope(), rule.slope_digits)
    signal = fits.gradient(slope) if rule.on == "gradient" else slope
    signal = half_up(Held(np.abs(signal.v), signal.ok), rule.digits)
    return {"slope": slope, "second_derivative": signal, "r_squared": fits.r2(), **rule.apply(signal)}


def detect(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str | dict[float, Column],
    windows: Sequence[int],
    rule: Rule,
    x_unit: str = "s",
    index: str | None = None,
    fit: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Run one rule at several window lengths: one output row per input row and window.

    Columns: the keys, ``t``, ``value``, window_length_level, slope, second_derivative, cp, rollmax
    (peak rules), r_squared (with ``fit``).  Rows with a NULL value are left out first.  ``value`` may
    be noise levels (see ``noise_levels``), which are then rows too.

    Pass ``index=t`` when ``t`` is a dense row index 1..n; its rows all stay, and a frame that holds
    a NULL has no fit.
    """
    if index is None:
        known = [F.col(value)] if isinstance(value, str) else list(value.values())
        df = df.filter(reduce(and_, [c.isNotNull() for c in known]))
    names = ["slope", "second_derivative", "cp"]
    names += ["rollmax"] if isinstance(rule, PeakRule) else []
    names += ["r_squared"] if fit else []
    outputs = {n: "boolean" if n == "cp" else "double" for n in names}
    return each_block(
        df, keys, t, value, windows, rule.reach, outputs, lambda fits: _signals(fits, rule), x_unit, index, block_rows
    )


def gradient_peaks(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    w: int,
    k: int,
    plateau: str = "sign",
    lead: int | None = None,
    digits: int | None = None,
    floor: float | None = 0.0,
    on: str = "gradient",
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Peak detector: adds change_point (second derivative), rollmax and flag."""
    rule = PeakRule(k=k, lead=lead, plateau=plateau, digits=digits, floor=floor, on=on)
    out = detect(df, keys, t, value, [w], rule, x_unit, index, block_rows=block_rows)
    return out.withColumnsRenamed({"second_derivative": "change_point", "cp": "flag"}).drop("window_length_level")


def gradient_ratio(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    w: int,
    cp_factor: float,
    epsilon: float = 1e-9,
    rising: bool = False,
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Ratio detector: complete rows with slope, r_squared, second_derivative and cp."""
    rule = RatioRule(cp_factor=cp_factor, epsilon=epsilon, rising=rising)
    out = detect(df, keys, t, value, [w], rule, x_unit, index, fit=True, block_rows=block_rows)
    return out.na.drop("any", subset=["slope", "second_derivative", "r_squared", "cp"])


# Names of the signals in long detector output (fixed values).
SIGNAL_NAMES = {
    "value": "Test dataset",
    "slope": "Rolling gradient",
    "second_derivative": "2nd derivative",
    "rollmax": "Rollmax",
    "r_squared": "r.squareds",
}


def signals_long(
    df: DataFrame,
    ids: Sequence[str],
    value: str = "value",
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Complete detector rows, one output row per signal: ids, variables, variables_ord, value."""
    names = names or SIGNAL_NAMES
    source = {("value" if c == value else c): c for c in df.columns}
    present = [(label, source[c]) for c, label in names.items() if c in source]
    rows = df.na.drop("any", subset=[c for _, c in present] + ["cp"])
    signals = F.array(
        *[
            F.struct(F.lit(label).alias("variables"), F.lit(n).alias("variables_ord"), F.col(c).alias("value"))
            for n, (label, c) in enumerate(present, start=1)
        ]
    )
    return rows.select(*ids, F.inline(signals))


def gradient_peaks_long(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    w: int | Sequence[int],
    digits: int = 7,
    k: int = 7,
    lead: int = 4,
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Peak detector on a rounded slope, with every intermediate signal in long form."""
    windows = [w] if isinstance(w, int) else list(w)
    rule = PeakRule(k=k, lead=lead, slope_digits=digits)
    out = detect(df, keys, t, value, windows, rule, x_unit, index, fit=True, block_rows=block_rows)
    return signals_long(out, [*keys_of(keys), t, "window_length_level", "cp"], value)


def sweep_windows(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    windows: Sequence[int],
    rule: Rule | None = None,
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Complete detector rows at each window length, wide (see ``signals_long`` for long form)."""
    rule = rule or PeakRule(k=7, lead=4, slope_digits=7)
    out = detect(df, keys, t, value, windows, rule, x_unit, index, fit=True, block_rows=block_rows)
    signals = [c for c in ("slope", "second_derivative", "rollmax", "r_squared", "cp") if c in out.columns]
    return out.na.drop("any", subset=signals)


NOISE_RULE = PeakRule(k=7, lead=4, digits=4, floor=1e-5)


def noise_levels(
    df: DataFrame, keys: str | Sequence[str], t: str, value: str, levels: Sequence[float], seed: int = 0
) -> dict[float, Column]:
    """For each level ``value`` + level * U(0, 1), the draw fixed by row, level and seed; level 0 adds nothing."""
    draw = {float(s): uniform(*keys_of(keys), axis_key(df, t), F.lit(float(s)), F.lit(seed)) for s in levels}
    return {s: F.col(value) + F.lit(s) * u for s, u in draw.items()}


def with_percentage(df: DataFrame, percentages: dict[int, str]) -> DataFrame:
    """Add ``percentage_level``: the label of each window length, as a share of the signal's length."""
    labels = [F.when(F.col("window_length_level") == w, F.lit(text)) for w, text in percentages.items()]
    return df.withColumn("percentage_level", F.coalesce(*labels, F.lit(None).cast("string")))


def sweep_noise(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    levels: Sequence[float],
    windows: Sequence[int] | dict[int, str],
    seed: int = 0,
    rule: Rule = NOISE_RULE,
    fit: bool = False,
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Detector at every noise level and window length.

    Each row is repeated once per level with ``level * U(0, 1)`` added (level 0 adds nothing); the
    level joins the series key.  With ``fit`` the rolling r_squared is kept too.  ``windows`` that map
    to labels give their ``percentage_level`` beside the length.
    """
    noisy = noise_levels(df, keys, t, value, levels, seed)
    out = detect(df, keys, t, noisy, list(windows), rule, x_unit, index, fit, block_rows)
    signals = [c for c in ("slope", "second_derivative", "rollmax", "r_squared", "cp") if c in out.columns]
    out = out.na.drop("any", subset=signals)
    return with_percentage(out, windows) if isinstance(windows, dict) else out


# Labels of the noise sweep's signals, in order (fixed values).
NOISE_NAMES = {
    "noise": "Test dataset",
    "slope": "Rolling gradient",
    "second_derivative": "2nd derivative",
    "rollmax": "Applied rollmax",
}


def sweep_noise_long(
    df: DataFrame, keys: str | Sequence[str], t: str, value: str, levels: Sequence[float], windows: dict[int, str], **kw
) -> DataFrame:
    """``sweep_noise`` in long form: a row for each signal, the rolling maximum among them."""
    out = sweep_noise(df, keys, t, value, levels, windows, **kw)
    ids = [*keys_of(keys), "standard_deviation", t, "window_length_level", "percentage_level", "cp"]
    return signals_long(out, ids, "noise", {("value" if c == "noise" else c): n for c, n in NOISE_NAMES.items()})


def noise_fit_stats(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    levels: Sequence[float],
    windows: dict[int, str],
    seed: int = 0,
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Residual sd and r2 of the fits at every noise level and window length, long; NULL until full."""
    noisy = noise_levels(df, keys, t, value, levels, seed)
    return with_percentage(rolling_fit_stats(df, keys, t, noisy, list(windows), x_unit, index, block_rows), windows)


def multi_series_ratio(
    df: DataFrame,
    label: str,
    t: str,
    value: str,
    w: int,
    cp_factor: float,
    epsilon: float = 1e-9,
    x_unit: str = "s",
) -> DataFrame:
    """Ratio detector over all labelled series at once, long: df_label, t, variables, value, cp."""
    names = {**SIGNAL_NAMES, "value": "Input dataset"}
    out = gradient_ratio(df, label, t, value, w, cp_factor, epsilon, x_unit=x_unit)
    return signals_long(out, [F.col(label).alias("df_label"), t, "cp"], value, names)


def coinciding(
    df: DataFrame,
    series: str,
    day: str,
    flag: str = "cp",
    min_series: int = 2,
    tolerance_days: int = 0,
) -> DataFrame:
    """Days on which at least ``min_series`` series are flagged (within the tolerance)."""
    points = df.filter(F.col(flag)).select(F.col(series).alias("_series"), F.col(day).alias(day))
    if tolerance_days:
        near = F.sequence(F.date_sub(day, tolerance_days), F.date_add(day, tolerance_days))
        points = points.withColumn(day, F.explode(near))
    return (
        points.distinct()
        .groupBy(day)
        .agg(F.count(F.lit(1)).alias("n_series"))
        .filter(F.col("n_series") >= min_series)
    )


def rolling_fit_stats(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str | dict[float, Column],
    w: int | Sequence[int],
    x_unit: str = "s",
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Residual sd and r2 of the rolling fit, long: keys, t, statistics, value (NULL until full).

    Several window lengths give a row for each, with ``window_length_level``; noise levels (see
    ``noise_levels``) one for each too, with ``standard_deviation``.
    """
    windows = [w] if isinstance(w, int) else list(w)
    outputs = {"_sigma": "double", "_r2": "double"}
    rows = each_block(
        df, keys, t, value, windows, (0, 0), outputs, lambda fits: {"_sigma": fits.sigma(), "_r2": fits.r2()}, x_unit, index, block_rows
    )
    stats = F.array(
        F.struct(F.lit("sigmas").alias("statistics"), F.col("_sigma").alias("value")),
        F.struct(F.lit("r.squareds").alias("statistics"), F.col("_r2").alias("value")),
    )
    level = [*(["standard_deviation"] if isinstance(value, dict) else []), t, *([] if isinstance(w, int) else [WIDTH])]
    return rows.select(*keys_of(keys), *level, F.inline(stats))


def abs_slope_peaks(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    w: int = 10,
    k: int = 3,
    lead: int = 2,
    bandwidth: float | None = 20.0,
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Peaks of the absolute rolling slope, of the kernel-smoothed series unless bandwidth is None."""
    column = value
    if bandwidth is not None:
        df, column = kernel_smooth(df, keys, t, value, bandwidth, index=index), "smooth"
    return gradient_peaks(
        df, keys, t, column, w, k, "equal", lead, floor=None, on="slope", index=index, block_rows=block_rows
    ).withColumnRenamed("change_point", "abs_slope")


def sign_change_points(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    value: str,
    bandwidth: float = 10.0,
    index: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Rows where the sign of the kernel-smoothed series differs from the previous row's."""
    smooth = kernel_smooth(df, keys, t, value, bandwidth, index=index)
    layout = lay_out(smooth, keys, t, before=1, index=index, block_rows=block_rows or BLOCK_ROWS)
    flip = F.signum("smooth") != F.lag(F.signum("smooth")).over(layout.window)
    return layout.add({"flag": flip}).finish().filter("flag")
