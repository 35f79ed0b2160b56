"""The studies end to end, each as one distributed job over all its series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detectors import PeakRule, coinciding, gradient_peaks, multi_series_ratio, sweep_windows
from ..operators.joins import expand_horizons
from ..operators.layout import keys_of
from ..operators.reconstruct import reconstruct, score_reconstruction
from ..operators.shape import between_dates, to_series, union_labelled


def intervention_study(
    series: dict[str, DataFrame],
    a: str | None = None,
    b: str | None = None,
    w: int = 7,
    cp_factor: float = 2.0,
    epsilon: float = 1e-9,
) -> tuple[DataFrame, DataFrame]:
    """Change points of several labelled daily series (day, value) and the days they share."""
    rows = union_labelled(series, "df_header")
    points = multi_series_ratio(between_dates(rows, "day", a, b), "df_header", "day", "value", w, cp_factor, epsilon)
    inputs = points.filter(F.col("variables") == "Input dataset")
    return points, coinciding(inputs, "df_label", "day")


def horizon_study(
    daily: DataFrame,
    variable: str,
    horizons: Sequence[tuple[str, str]],
    w: int = 6,
    k: int = 2,
    keys: str | Sequence[str] = (),
) -> DataFrame:
    """What the peak detector would have flagged had the data ended at each horizon."""
    keys = keys_of(keys)
    rows = expand_horizons(to_series(daily, "day", variable, keys), "day", horizons)
    return gradient_peaks(rows, [*keys, "time_frame", "time_frame_ord"], "day", "value", w, k)


def window_study(
    rows: DataFrame,
    keys: str | Sequence[str],
    windows: Sequence[int] = (7, 14, 21, 28, 35, 42),
    rule: PeakRule = PeakRule(k=7, lead=4, slope_digits=7),
    x_unit: str = "s",
) -> tuple[DataFrame, DataFrame]:
    """Reconstruct each daily series through the points found at each window length, and score it."""
    by = [*keys_of(keys), "window_length_level"]
    lines = reconstruct(sweep_windows(rows, keys, "day", "value", windows, rule, x_unit), by, "day")
    return lines, score_reconstruction(lines, by)
