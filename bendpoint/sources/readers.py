"""Readers for weather, readings, site maps, compliance counts and plain signals; file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import null_if_nan, parse_day, parse_number, parse_ts, percent
from ..operators.rolling import rolling_mean
from ..operators.shape import between_dates

# Columns of the hourly weather files (fixed values).
WEATHER_SCHEMA = (
    "code string, date string, ws double, wd double, air_temp double, atmos_pres double, RH double, cl double"
)

# Headers of the compliance file and the names used here (fixed values).
COMPLIANCE_COLUMNS = {
    "Date of Travel": "date",
    "Unique VRMs Captured in Charging Hours": "total_vehicle_number",
    "Unique VRMs Compliant with ULEZ": "compliant_number",
    "Unique VRMs Non-Compliant with ULEZ": "non_compliant_number",
}
NOT_COUNTED = "Not Yet Calculated"


def read_weather(
    spark: SparkSession, path: str | list[str], begin: str | None = None, end: str | None = None
) -> DataFrame:
    """Hourly weather of all stations from one glob of CSV files; ``code`` becomes ``met_code``.

    Columns are found by header; all files share one order, and a file that does not is refused, as are
    files without one of the columns.  Rows whose date cannot be read are kept with a NULL date unless
    a range is asked for; ``unread_dates`` counts them.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    fields = [f.strip().split(" ") for f in WEATHER_SCHEMA.split(",")]
    missing = [name for name, _ in fields if name not in raw.columns]
    if missing:
        raise ValueError(f"weather files lack the columns {missing}")
    typed = raw.select(
        *[
            F.col(name) if kind == "string" else null_if_nan(F.col(name).try_cast(kind)).alias(name)
            for name, kind in fields
        ]
    )
    return between_dates(
        typed.withColumn("date", parse_ts("date")).withColumnRenamed("code", "met_code"), "date", begin, end
    )


def unread_dates(df: DataFrame, t: str = "date") -> DataFrame:
    """Rows by station whose date could not be read: what a range leaves out."""
    return df.filter(F.col(t).isNull()).groupBy("met_code").agg(F.count(F.lit(1)).alias("n_unread"))


def read_readings(
    spark: SparkSession, path: str, sites: Sequence[str] | None, begin: str, end: str
) -> DataFrame:
    """Readings landed as parquet by year and site; whole years from begin's to end's are read.

    NaN, which some writers use for a missing reading, becomes NULL.
    """
    df = spark.read.parquet(path).filter(F.col("year").between(int(begin[:4]), int(end[:4])))
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    df = df.withColumns({c: null_if_nan(c) for c in doubles})
    return df if sites is None else df.filter(F.col("code").isin(list(sites)))


def write_readings(df: DataFrame, path: str, t: str = "date", mode: str = "overwrite") -> None:
    """Land readings in the layout ``read_readings`` prunes: folders by year, then by site."""
    df.withColumn("year", F.year(t)).write.mode(mode).partitionBy("year", "code").parquet(path)


def read_site_map(spark: SparkSession, path: str, site_types: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).na.drop("any")
    return df if site_types is None else df.filter(F.col("site_type").isin(list(site_types)))


def parse_compliance(raw: DataFrame) -> DataFrame:
    """Daily counts from the text columns of the compliance file, with the share and its 7-row mean."""
    df = raw.select(*[F.col(f"`{c}`").alias(name) for c, name in COMPLIANCE_COLUMNS.items()])
    counts = [c for c in COMPLIANCE_COLUMNS.values() if c != "date"]
    df = df.filter(F.col("total_vehicle_number") != NOT_COUNTED).select(
        parse_day("date").alias("date"), *[parse_number(c).alias(c) for c in counts]
    )
    df = df.withColumn("compliant_percentage", percent("compliant_number", "total_vehicle_number"))
    return rolling_mean(df, [], "date", {"compliant_percentage": "d7_rollavg_compliant_percentage"}, 7)


def read_compliance(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_compliance(spark.read.option("header", True).csv(path))


def read_signal(spark: SparkSession, path: str, drop_first: bool = False) -> DataFrame:
    """One number per line as (index, value), in line order.

    Lines are numbered from the row counts of the file's blocks; no sort and no shuffle of the
    lines.  ``drop_first`` loses the first sample, as a reader does that takes it for a header.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("_text"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    place = ["_file", "_start"]
    blocks = lines.groupBy(*place).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*place, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    skip = 1 if drop_first else 0
    index = F.col("_before") + F.col("_id") - F.col("_first") + F.lit(1 - skip)
    numbered = lines.join(blocks, place).select(
        index.alias("index"), F.trim("_text").try_cast("double").alias("value")
    )
    return numbered.filter(F.col("index") >= 1)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
