"""The given tables in the roles of readings, weather, sites, signals and model output.

Each role exists twice: as a DataFrame for the library and as a SQL subquery for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bendpoint.functions.aggregates import vector_mean_direction
from bendpoint.operators.calendar import calendar_agg
from bendpoint.operators.layout import add_index
from bendpoint.session import configure


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Round a result for comparison."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean order price per status: three long daily series with gaps."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "series")
    return calendar_agg(orders, "series", "o_orderdate", {"value": ("o_totalprice", "mean")})


ORDERS_DAILY = """
  SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value
  FROM orders GROUP BY ALL"""


def orders_daily_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the mean log price: unlike means of cents, its slopes have no rounding ties."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("series"), "o_orderdate", F.log("o_totalprice").alias("x")
    )
    return calendar_agg(orders, "series", "o_orderdate", {"value": ("x", "mean")})


ORDERS_DAILY_LOG = """
  SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS day, avg(ln(o_totalprice)) AS value
  FROM orders GROUP BY ALL"""


def lineitem_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means per flag and status: six daily series of four variables (log price)."""
    items = table(spark, sf, "lineitem").withColumns(
        {"series": F.concat("l_returnflag", "l_linestatus"), "x": F.log("l_extendedprice")}
    )
    variables = {"price": "x", "quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    return calendar_agg(items, "series", "l_shipdate", {n: (c, "mean") for n, c in variables.items()})


LINEITEM_DAILY = """
  SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS DATE) AS day,
         avg(ln(l_extendedprice)) AS price, avg(l_quantity) AS quantity, avg(l_discount) AS discount,
         avg(l_tax) AS tax
  FROM lineitem GROUP BY ALL"""


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a sample of its type's signal, by row index: five series that grow with the data."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", "event_id", "value")
    return add_index(events, "series", "ts", tie=["event_id"]).select("series", "index", "value")


SIGNAL = """
  SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS index, value
  FROM events"""


def bau(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as model output: observed log price, that expected from the quantity, the discounted one."""
    items = table(spark, sf, "lineitem").withColumn("site", F.concat("l_returnflag", "l_linestatus"))
    ratio = items.groupBy("site").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("_ratio"))
    return items.join(ratio, "site").select(
        "site",
        F.col("l_shipdate").alias("date"),
        F.log("l_extendedprice").alias("value"),
        F.log(F.col("l_quantity") * F.col("_ratio")).alias("value_predict"),
        F.log(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rm_normal_value"),
    )


BAU = """
  SELECT site, l_shipdate AS date, ln(l_extendedprice) AS value, ln(l_quantity * ratio) AS value_predict,
         ln(l_extendedprice * (1 - l_discount)) AS rm_normal_value
  FROM (SELECT *, l_returnflag || l_linestatus AS site FROM lineitem)
  JOIN (SELECT l_returnflag || l_linestatus AS site, sum(l_extendedprice) / sum(l_quantity) AS ratio
        FROM lineitem GROUP BY ALL) USING (site)"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly readings per event type, with two pollutants; ``ws`` is one the station's value replaces."""
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("code"), "ts", "value", F.sqrt("value").alias("x"), (F.col("user_id") % 7).alias("u")
    )
    stats = {"no2": ("x", "mean"), "o3": ("value", "max"), "ws": ("u", "mean")}
    return calendar_agg(events, "code", "ts", stats, unit="hour").select(
        "code",
        F.concat(F.lit("site "), "code").alias("station"),
        F.when(F.length("code") > 5, "Roadside").otherwise("Urban Background").alias("site_type"),
        F.col("hour").alias("date"),
        "no2",
        F.when(F.col("o3") < 300, F.col("o3")).alias("o3"),
        "ws",
    )


READINGS = """
  SELECT event_type AS code, 'site ' || event_type AS station,
         CASE WHEN length(event_type) > 5 THEN 'Roadside' ELSE 'Urban Background' END AS site_type,
         date_trunc('hour', ts) AS date, avg(sqrt(value)) AS no2,
         CASE WHEN max(value) < 300 THEN max(value) END AS o3
  FROM events GROUP BY ALL"""


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly weather per station; pressure is missing now and then."""
    events = table(spark, sf, "events").select(
        F.concat(F.lit("M"), (F.col("user_id") % 3).cast("string")).alias("met_code"),
        "ts",
        (F.col("user_id") % 10 + 1.0).alias("ws"),
        F.pmod("value", F.lit(360.0)).alias("wd"),
        "value",
        (F.col("event_id") % 100).cast("double").alias("e"),
    )
    stats = {"ws": ("ws", "mean"), "air_temp": ("value", "min"), "RH": ("e", "mean"), "cl": ("e", "max")}
    out = calendar_agg(
        events, "met_code", "ts", stats, unit="hour", extra={"wd": vector_mean_direction("wd", "ws")}
    )
    pressure = F.when(F.col("cl") < 90, 1000.0 + F.col("air_temp"))
    return out.withColumnRenamed("hour", "date").withColumn("atmos_pres", pressure)


WEATHER = """
  SELECT *, CASE WHEN cl < 90 THEN 1000.0 + air_temp END AS atmos_pres FROM (
    SELECT met_code, date, avg(ws) AS ws, min(value) AS air_temp, avg(e) AS RH, max(e) AS cl,
           CASE WHEN degrees(atan2(avg(ws * sin(radians(wd))), avg(ws * cos(radians(wd))))) < 0
                THEN degrees(atan2(avg(ws * sin(radians(wd))), avg(ws * cos(radians(wd))))) + 360.0
                ELSE degrees(atan2(avg(ws * sin(radians(wd))), avg(ws * cos(radians(wd))))) END AS wd
    FROM (SELECT 'M' || (user_id % 3) AS met_code, date_trunc('hour', ts) AS date, user_id % 10 + 1.0::DOUBLE AS ws,
                 value % 360.0::DOUBLE AS wd, value, (event_id % 100)::DOUBLE AS e FROM events)
    GROUP BY ALL)"""


def site_map(spark: SparkSession, sf: str) -> DataFrame:
    """Station of each site; several sites share one."""
    codes = table(spark, sf, "events").select(F.col("event_type").alias("code")).distinct()
    return codes.withColumn("met_code", F.concat(F.lit("M"), (F.length("code") % 3).cast("string")))


SITE_MAP = "SELECT DISTINCT event_type AS code, 'M' || (length(event_type) % 3) AS met_code FROM events"


def model_input(spark: SparkSession, sf: str) -> DataFrame:
    """Long prepared rows for the forests: hourly readings per event type with their station's weather."""
    from bendpoint.operators.joins import join_weather
    from bendpoint.plans.counterfactual import prepare

    joined = join_weather(readings(spark, sf), weather(spark, sf), site_map(spark, sf))
    return prepare(joined, "no2")


MODEL_INPUT = f"""
  SELECT m.code, w.met_code, r.station, w.date, w.ws, w.wd, w.air_temp, w.atmos_pres AS atmospheric_pressure,
         w.RH, w.cl, 'no2' AS pollutant, r.no2 AS value
  FROM ({WEATHER}) w JOIN ({SITE_MAP}) m USING (met_code)
  JOIN ({READINGS}) r ON r.code = m.code AND r.date = w.date
  WHERE r.no2 IS NOT NULL"""


def uniform_sql(*parts: str) -> str:
    """The repeatable uniform draw of ``functions.scalars.uniform``."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(concat('0x', substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
