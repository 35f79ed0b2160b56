"""Aggregate column expressions used inside ``groupBy(...).agg(...)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_column


def vector_mean_direction(wd: Column | str, ws: Column | str | None = None) -> Column:
    """Mean wind direction in degrees [0, 360), weighted by wind speed when it is given."""
    angle = F.radians(as_column(wd))
    weight = as_column(ws) if ws is not None else F.lit(1.0)
    degrees = F.degrees(F.atan2(F.avg(weight * F.sin(angle)), F.avg(weight * F.cos(angle))))
    return F.when(degrees < 0, degrees + 360.0).otherwise(degrees)


def mse(a: Column | str, b: Column | str) -> Column:
    return F.avg(F.pow(as_column(a) - as_column(b), F.lit(2.0)))


def rmse(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(mse(a, b))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation coefficient over complete pairs; NULL where either side is constant."""
    both = as_column(a).isNotNull() & as_column(b).isNotNull()
    x, y = F.when(both, as_column(a)), F.when(both, as_column(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
