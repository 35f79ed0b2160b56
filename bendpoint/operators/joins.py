"""Joins of readings, weather, sites, horizons and neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import keys_of, small
from .rolling import axis_value

# Weather columns a reading may carry itself; the station's values replace them (fixed values).
READING_WEATHER = ("ws", "wd", "air_temp", "latitude", "longitude")

def join_weather(
    readings: DataFrame,
    weather: DataFrame,
    site_map: DataFrame,
    keep: str = "weather",
    site: str = "code",
    t: str = "date",
) -> DataFrame:
    """Hourly readings with the weather of the site's station.

    ``keep="weather"`` gives every weather row of the station for each of its sites, with NULL
    readings where there are none; ``keep="readings"`` gives every reading, with NULL weather.
    """
    own = readings.drop(*READING_WEATHER)
    stations = small(site_map.select(site, "met_code"))
    if keep == "weather":
        return weather.join(stations, "met_code").join(own.drop("met_code"), [site, t], "left")
    return own.drop("met_code").join(stations, site, "left").join(weather, ["met_code", t], "left")


def inner_on(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return a.join(b, list(cols))


def keep_members(df: DataFrame, members: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(members, keys_of(on), "left_semi")


def mark_members(df: DataFrame, members: DataFrame, on: str | Sequence[str], name: str) -> DataFrame:
    on = keys_of(on)
    marks = members.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marks, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def attach(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left")


def align(a: DataFrame, b: DataFrame, keys: str | Sequence[str], index: str) -> DataFrame:
    """Put two tables side by side by row place within the series."""
    return a.join(b, [*keys_of(keys), index])


def expand_horizons(
    df: DataFrame, t: str, horizons: Sequence[tuple[str, str]], name: str = "time_frame"
) -> DataFrame:
    """Replay a series up to several end dates: each row once per horizon that reaches it.

    The label joins the series key, ``<name>_ord`` keeps the order of the horizons.
    """
    kind = df.schema[t].dataType.typeName()
    reached = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(t) <= F.lit(cutoff).cast(kind),
                    F.struct(F.lit(text).alias(name), F.lit(n).alias(f"{name}_ord")),
                )
                for n, (text, cutoff) in enumerate(horizons, start=1)
            ]
        )
    )
    return df.select("*", F.inline(reached))


def band_join(
    df: DataFrame,
    keys: str | Sequence[str],
    t: str,
    radius: float,
    cols: Sequence[str],
    x_unit: str = "day",
    bin_radii: int = 8,
) -> DataFrame:
    """Each row with the rows of its series within ``radius``: t, other_t and the others' columns.

    An equi-join on bins of the axis; rows within one radius of a bin's edge are copied across it.
    """
    keys = keys_of(keys)
    width = float(radius * bin_radii)
    x = axis_value(df, t, x_unit)
    near = df.select(
        *keys, F.col(t).alias(f"other_{t}"), *[F.col(c).alias(f"other_{c}") for c in cols], x.alias("_x2")
    )
    home = F.floor(F.col("_x2") / width)
    offset = F.col("_x2") - home * width
    copies = F.array(
        home,
        F.when(offset >= width - radius, home + 1),
        F.when(offset <= radius, home - 1),
    )
    near = near.withColumn("_bin", F.explode(F.array_compact(copies)))
    left = df.withColumn("_x1", x).withColumn("_bin", F.floor(F.col("_x1") / width))
    pairs = left.join(near, [*keys, "_bin"])
    return pairs.filter(F.abs(F.col("_x1") - F.col("_x2")) <= radius).drop("_bin", "_x1", "_x2")
