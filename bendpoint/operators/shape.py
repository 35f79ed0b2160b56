"""Projections, filters, reshaping and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import keys_of


def pick(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Fixed columns plus one chosen at run time; an absent column is an error."""
    return df.select(*cols, name)


def pick_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def drop_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def to_series(df: DataFrame, t: str, variable: str, keys: str | Sequence[str] = ()) -> DataFrame:
    """The detector input: keys, axis and one variable as ``value``, complete rows only."""
    return df.select(*keys_of(keys), t, F.col(variable).alias("value")).na.drop("any")


def label(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def reorder(df: DataFrame, c: str, after: str) -> DataFrame:
    rest = [x for x in df.columns if x != c]
    at = rest.index(after) + 1
    return df.select(*rest[:at], c, *rest[at:])


def add_ordinal(df: DataFrame, c: str, levels: Sequence[str], name: str | None = None) -> DataFrame:
    """1-based place of a label among ordered levels; NULL for a label that is none of them."""
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(c))
    return df.withColumn(name or f"{c}_ord", F.when(place > 0, place.cast("int")))


def between_dates(df: DataFrame, t: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """Closed range; an end given as a date means its midnight when the axis holds time stamps."""
    kind = df.schema[t].dataType.typeName()
    if a is not None:
        df = df.filter(F.col(t) >= F.lit(a).cast(kind))
    if b is not None:
        df = df.filter(F.col(t) <= F.lit(b).cast(kind))
    return df


def where_eq(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def keep_not_null(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull())


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def keep_values(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(c).isin(list(values)))


def slice_index(df: DataFrame, index: str, a: int, b: int, renumber: bool = True) -> DataFrame:
    """Rows a..b of a dense index, counted anew from 1."""
    out = df.filter(F.col(index).between(a, b))
    return out.withColumn(index, F.col(index) - F.lit(a - 1)) if renumber else out


def flagged(df: DataFrame, flag: str, mag: str | None = None, min_mag: float | None = None) -> DataFrame:
    condition: Column = F.col(flag)
    if mag is not None and min_mag is not None:
        condition = condition & (F.col(mag) > min_mag)
    return df.filter(condition)


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    names_to: str = "variables",
    values_to: str = "value",
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """One row per id and remaining column."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, names_to, values_to)


def union_labelled(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of all tables with the table's label in column ``name``."""
    return reduce(DataFrame.unionByName, [label(df, name, key) for key, df in tables.items()])


def endpoints(df: DataFrame, keys: str | Sequence[str], t: str) -> DataFrame:
    return df.groupBy(*keys_of(keys)).agg(F.min(t).alias(f"first_{t}"), F.max(t).alias(f"last_{t}"))


def distinct_keys(df: DataFrame, c: str | Sequence[str]) -> DataFrame:
    return df.select(*keys_of(c)).distinct()


def summary_scalars(df: DataFrame, c: str, t: str) -> DataFrame:
    """Largest value, number of rows, first and last place: one row."""
    return df.agg(
        F.max(c).alias(f"max_{c}"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min(t).alias(f"first_{t}"),
        F.max(t).alias(f"last_{t}"),
    )
