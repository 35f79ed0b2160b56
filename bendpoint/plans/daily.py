"""Daily products of modelled site series: pooled statistics, intervals and 7-row means.

Input tables have one row per site and hour: site, ``t``, ``value`` (observed), ``value_predict``
and, where the weather was averaged out, ``rm_normal_value``.  All sites are pooled, each row with
the same weight, unless ``keys`` names columns to keep apart.  7-row means count rows, not days;
``operators.calendar.fill_calendar`` pads missing days where that matters.  The names of the products'
columns are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import vector_mean_direction
from ..operators.calendar import add_delta, calendar_agg, ci_bounds
from ..operators.layout import keys_of
from ..operators.rolling import rolling_mean
from ..operators.shape import add_ordinal, between_dates, to_long

ROLL = 7


def _rolled(df: DataFrame, keys: list[str], cols: Sequence[str], w: int = ROLL) -> DataFrame:
    return rolling_mean(df, keys, "day", {c: f"d7_rollavg_{c}" for c in cols}, w)


def _pair_summary(df: DataFrame, keys: list[str], t: str, pairs: dict[str, str], counted: str) -> DataFrame:
    """Mean and sd of each named column, and the interval of the ``counted`` one."""
    stats: dict[str, tuple[str, str]] = {}
    for name, c in pairs.items():
        stats[f"{name}_mean"] = (c, "mean")
        stats[f"{name}_sd"] = (c, "sd")
    stats["_n"] = (pairs[counted], "frequency")
    out = calendar_agg(df, keys, t, stats)
    return ci_bounds(out, f"{counted}_mean", f"{counted}_sd", "_n").drop("_n")


def _with_deltas(df: DataFrame) -> DataFrame:
    df = add_delta(df, "observed_mean", "BAU_mean", "delta_BAU_predict_mean")
    return add_delta(df, "observed_sd", "BAU_sd", "delta_BAU_predict_sd", absolute=True)


def daily_summary(bau: DataFrame, keys: str | Sequence[str] = (), t: str = "date") -> DataFrame:
    """Observed, business-as-usual and normalised values per day, their differences and 7-row means."""
    keys = keys_of(keys)
    pairs = {"BAU": "value_predict", "rm_normal": "rm_normal_value", "observed": "value"}
    out = _with_deltas(_pair_summary(bau, keys, t, pairs, "observed"))
    rolled = [
        "delta_BAU_predict_mean",
        "delta_BAU_predict_sd",
        "observed_mean",
        "BAU_mean",
        "CI_lower",
        "CI_upper",
        "rm_normal_mean",
    ]
    return _rolled(out, keys, rolled)


def daily_summary_subset(
    df: DataFrame,
    mode: str = "bau",
    sites: Sequence[str] | DataFrame | None = None,
    keys: str | Sequence[str] = (),
    site: str = "site",
    t: str = "date",
) -> DataFrame:
    """Summary without the third series, of all sites or some.

    ``mode="normal"`` reads normalised output (``raw_value``, ``value_predict``), ``mode="bau"``
    reads counterfactual output (``value``, ``value_predict``) and adds the differences.
    """
    keys = keys_of(keys)
    if isinstance(sites, DataFrame):
        df = df.join(sites.select(site), site, "left_semi")
    elif sites is not None:
        df = df.filter(F.col(site).isin(list(sites)))
    if mode == "normal":
        pairs = {"normal": "value_predict", "observed": "raw_value"}
        out = _pair_summary(df, keys, t, pairs, "observed")
        rolled = ["normal_mean", "normal_sd", "observed_mean", "observed_sd", "CI_lower", "CI_upper"]
    else:
        pairs = {"BAU": "value_predict", "observed": "value"}
        out = _with_deltas(_pair_summary(df, keys, t, pairs, "observed"))
        rolled = [
            "delta_BAU_predict_mean",
            "delta_BAU_predict_sd",
            "observed_mean",
            "BAU_mean",
            "CI_lower",
            "CI_upper",
        ]
    return _rolled(out, keys, rolled)


def daily_delta_weather(
    bau: DataFrame,
    weather: DataFrame,
    keys: str | Sequence[str] = (),
    site: str = "site",
    t: str = "date",
    w: int = ROLL,
) -> DataFrame:
    """7-row means of the difference, both series and the weather, complete days, long.

    The daily wind direction is a vector mean, its 7-row mean is a plain mean of degrees.
    """
    keys = keys_of(keys)
    pairs = bau.select(*keys, site, t, "value", "value_predict")
    both = pairs.join(weather.select(site, t, "ws", "wd", "air_temp", "RH"), [t, site])
    both = add_delta(both, "value", "value_predict", "_delta")
    mean = {"_Delta": "_delta", "_BAU": "value_predict", "_observed": "value"}
    mean |= {"_WS": "ws", "_Temp": "air_temp", "_RelHum": "RH"}
    out = calendar_agg(
        both,
        keys,
        t,
        {name: (c, "mean") for name, c in mean.items()},
        extra={"_WD": vector_mean_direction("wd", "ws")},
    )
    levels = ["Delta", "BAU", "observed", "WS", "WD", "Temp", "RelHum"]
    out = rolling_mean(out, keys, "day", {f"_{c}": c for c in levels}, w)
    out = out.select(*keys, "day", *levels).na.drop("any")
    return add_ordinal(to_long(out, [*keys, "day"]), "variables", levels)


def daily_output_long(
    bau: DataFrame, keys: str | Sequence[str] = (), t: str = "date", w: int = ROLL
) -> DataFrame:
    """7-row means of the business-as-usual series, the observed one and the difference, long."""
    keys = keys_of(keys)
    rows = add_delta(bau, "value", "value_predict", "_delta")
    out = calendar_agg(
        rows, keys, t, {"_BAU": ("value_predict", "mean"), "_observed": ("value", "mean"), "_d": ("_delta", "mean")}
    )
    out = rolling_mean(out, keys, "day", {"_BAU": "BAU", "_observed": "observed", "_d": "delta"}, w)
    return to_long(out.select(*keys, "day", "BAU", "observed", "delta").na.drop("any"), [*keys, "day"])


def daily_observed(bau: DataFrame, keys: str | Sequence[str] = (), t: str = "date") -> DataFrame:
    """Median, maximum, minimum and sd of the observed values per day with 7-row means.

    The median is called ``observed_mean``, the name the study's consumers use.
    """
    keys = keys_of(keys)
    stats = {"mean": "median", "max": "max", "min": "min", "sd": "sd"}
    out = calendar_agg(bau, keys, t, {f"observed_{name}": ("value", s) for name, s in stats.items()})
    return rolling_mean(out, keys, "day", {f"observed_{s}": f"d7_rollavg_{s}" for s in stats}, ROLL)


def validation_slice(daily: DataFrame, a: str, b: str, keys: str | Sequence[str] = ()) -> DataFrame:
    """Days a..b with the rolled interval as ids and the rolled series under each other."""
    ids = [*keys_of(keys), "day", "d7_rollavg_CI_lower", "d7_rollavg_CI_upper"]
    series = ["d7_rollavg_observed_mean", "d7_rollavg_BAU_mean"]
    return to_long(between_dates(daily, "day", a, b).select(*ids, *series), ids, "model_output")


def compliance_series(compliance: DataFrame, label: str = "Compliance stats ULEZ") -> DataFrame:
    """The compliance share's 7-row mean in the common labelled form: day, value, df_header."""
    return compliance.na.drop("any").select(
        F.col("date").alias("day"),
        F.col("d7_rollavg_compliant_percentage").alias("value"),
        F.lit(label).alias("df_header"),
    )


def comparison_long(
    daily: DataFrame, series: dict[str, str], keys: str | Sequence[str] = (), names_to: str = "delta"
) -> DataFrame:
    """Days on which all the series exist, under their new names, long.  ``series``: label to column."""
    ids = [*keys_of(keys), "day"]
    columns = [F.col(c).alias(text) for text, c in series.items()]
    return to_long(daily.select(*ids, *columns).na.drop("any"), ids, names_to)
