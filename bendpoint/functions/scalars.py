"""Scalar column helpers: parsing, calendar parts, repeatable noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_day(c: Column | str, fmt: str = "dd/MM/yyyy", skip: int = 4) -> Column:
    """Date from text after a prefix of ``skip`` characters ("Mon 08/04/2019"); NULL if unreadable."""
    text = as_column(c)
    return F.to_date(F.try_to_timestamp(F.substring(text, skip + 1, 64), F.lit(fmt)))


def parse_number(c: Column | str) -> Column:
    """Number from text with thousands separators; NULL if unreadable."""
    return F.replace(as_column(c), F.lit(","), F.lit("")).try_cast("double")


def percent(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(as_column(a), as_column(b)) * 100.0


def date_parts(c: Column | str) -> list[Column]:
    day = as_column(c)
    return [F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day")]


def hours_between(a: Column | str, b: Column | str, inclusive: bool = True) -> Column:
    """Hours from a to b; ``inclusive`` counts both end points as hourly rows."""
    seconds = F.unix_seconds(as_column(b).cast("timestamp")) - F.unix_seconds(
        as_column(a).cast("timestamp")
    )
    return seconds / F.lit(3600.0) + F.lit(1.0 if inclusive else 0.0)


def parse_ts(c: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(as_column(c), F.lit(fmt))


def null_if_nan(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def calendar_features(df: DataFrame, t: str) -> DataFrame:
    """Trend and calendar terms of the counterfactual model; Monday is weekday 1."""
    moment = F.col(t).cast("timestamp")
    return df.withColumns(
        {
            "date_unix": F.unix_seconds(moment),
            "day_julian": F.dayofyear(moment),
            "weekday": F.weekday(moment) + 1,
            "hour": F.hour(moment),
        }
    )


def axis_key(df: DataFrame, t: str) -> Column:
    """A text form of the axis that is the same in every engine: microseconds, a date or a number."""
    if isinstance(df.schema[t].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(t).cast("timestamp")).cast("string")
    return F.col(t).cast("string")


def uniform(*parts: Column | str) -> Column:
    """Uniform draw in [0, 1) fixed by the text of ``parts``: retried tasks draw the same numbers."""
    key = F.concat_ws("|", *[as_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gaussian(*parts: Column | str) -> Column:
    """Standard normal draw (Box-Muller on two uniform draws)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(*parts, F.lit("radius"))))
    return radius * F.cos(2.0 * math.pi * uniform(*parts, F.lit("angle")))
