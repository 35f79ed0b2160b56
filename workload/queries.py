"""Registered queries: each operator on whole given tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bendpoint.functions import scalars as X
from bendpoint.functions.aggregates import pearson, rmse, vector_mean_direction
from bendpoint.operators import calendar as C
from bendpoint.operators import detectors as D
from bendpoint.operators import joins as J
from bendpoint.operators import layout as L
from bendpoint.operators import perturb as N
from bendpoint.operators import reconstruct as E
from bendpoint.operators import rolling as W
from bendpoint.operators import segments as S
from bendpoint.operators import shape as P
from bendpoint.plans import counterfactual as M
from bendpoint.plans import daily as R
from bendpoint.plans import studies
from bendpoint.sources.readers import COMPLIANCE_COLUMNS, NOT_COUNTED, parse_compliance, read_site_map

from .roles import (
    BAU,
    LINEITEM_DAILY,
    MODEL_INPUT,
    ORDERS_DAILY,
    ORDERS_DAILY_LOG,
    READINGS,
    SIGNAL,
    SITE_MAP,
    WEATHER,
    bau,
    lineitem_daily,
    model_input,
    orders_daily,
    orders_daily_log,
    r,
    readings,
    signal,
    site_map,
    table,
    uniform_sql,
    weather,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: dict[str, int] | int = 6) -> DataFrame:
    """Round the double columns for comparison."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    places = digits if isinstance(digits, dict) else dict.fromkeys(names, digits)
    return df.withColumns({c: r(c, places.get(c, 6)) for c in names})


def roll_sql(c: str, w: int, part: str = "series", order: str = "day") -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {over} = {w} THEN avg({c}) {over} END"


def detect_sql(
    source: str,
    w: int,
    rule: str,
    k: int = 1,
    part: str = "series",
    order: str = "day",
    x: str = "epoch(day)",
    value: str = "value",
    slope: str = "slope",
    signal: str = "abs(grad)",
    name: str = "d",
) -> str:
    """CTEs from a series to flags; the last one is called ``name``."""
    over = f"(PARTITION BY {part} ORDER BY {order})"
    frame = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    peak = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    fit = f"regr_sxx({value}, {x}) OVER {frame} * regr_syy({value}, {x}) OVER {frame}"
    return f"""
  {name}1 AS (SELECT *, row_number() OVER {over} AS rn, count(*) OVER (PARTITION BY {part}) AS n,
    CASE WHEN count({value}) OVER {frame} = {w} THEN regr_slope({value}, {x}) OVER {frame} END AS slope0,
    CASE WHEN count({value}) OVER {frame} = {w} AND {fit} > 0
         THEN pow(regr_sxy({value}, {x}) OVER {frame}, 2) / ({fit}) END AS r_squared
    FROM ({source})),
  {name}2 AS (SELECT * EXCLUDE (slope0), {slope.replace('slope', 'slope0')} AS slope FROM {name}1),
  {name}3 AS (SELECT *, CASE WHEN rn = 1 THEN lead(slope) OVER {over} - slope
                             WHEN rn = n THEN slope - lag(slope) OVER {over}
                             ELSE (lead(slope) OVER {over} - lag(slope) OVER {over}) / 2 END AS grad FROM {name}2),
  {name}4 AS (SELECT *, {signal} AS d2 FROM {name}3),
  {name}5 AS (SELECT *, CASE WHEN count(d2) OVER {peak} = {k} THEN max(d2) OVER {peak} END AS rollmax FROM {name}4),
  {name} AS (SELECT * EXCLUDE (rn, n, grad), {rule.replace('{over}', over)} AS cp FROM {name}5)"""


# --------------------------------------------------------------------------- calendar aggregation


@query("""
  SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
         count(value) AS n, round(median(value), 6) AS median, max(value) AS max, min(value) AS min
  FROM events GROUP BY ALL""")
def daily_stats(spark, sf):
    stats = {"mean": "mean", "sd": "sd", "n": "frequency", "median": "median", "max": "max", "min": "min"}
    return rounded(
        C.calendar_agg(table(spark, sf, "events"), "event_type", "ts", {o: ("value", s) for o, s in stats.items()})
    )


@query("""
  SELECT event_type, day, round(m - 1.96 * s / sqrt(n), 6) AS "CI_lower", round(m + 1.96 * s / sqrt(n), 6) AS "CI_upper"
  FROM (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n
        FROM events GROUP BY ALL)""")
def daily_ci(spark, sf):
    stats = {"m": ("value", "mean"), "s": ("value", "sd"), "n": ("value", "frequency")}
    days = C.calendar_agg(table(spark, sf, "events"), "event_type", "ts", stats)
    return rounded(C.ci_bounds(days, "m", "s", "n").select("event_type", "day", "CI_lower", "CI_upper"))


@query(f"""
  SELECT site, day, round(m - p, 6) AS delta, round(abs(sm - sp), 6) AS delta_sd FROM (
    SELECT site, CAST(date AS DATE) AS day, avg(value) AS m, avg(value_predict) AS p,
           stddev_samp(value) AS sm, stddev_samp(value_predict) AS sp FROM ({BAU}) GROUP BY ALL)""")
def daily_delta(spark, sf):
    stats = {"m": ("value", "mean"), "p": ("value_predict", "mean"), "sm": ("value", "sd"), "sp": ("value_predict", "sd")}
    days = C.calendar_agg(bau(spark, sf), "site", "date", stats)
    out = C.add_delta(C.add_delta(days, "m", "p"), "sm", "sp", "delta_sd", absolute=True)
    return rounded(out.select("site", "day", "delta", "delta_sd"))


@query("""
  SELECT event_type, day, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS wd,
         round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS wd_unweighted
  FROM (SELECT event_type, CAST(ts AS DATE) AS day,
               degrees(atan2(avg(ws * sin(radians(wd))), avg(ws * cos(radians(wd))))) AS a,
               degrees(atan2(avg(sin(radians(wd))), avg(cos(radians(wd))))) AS b
        FROM (SELECT event_type, ts, value % 360.0::DOUBLE AS wd, 1.0::DOUBLE + user_id % 10 AS ws FROM events)
        GROUP BY ALL)""")
def wind_vector_mean(spark, sf):
    events = table(spark, sf, "events").withColumns(
        {"wd": F.pmod("value", F.lit(360.0)), "ws": 1.0 + F.col("user_id") % 10}
    )
    extra = {"wd": vector_mean_direction("wd", "ws"), "wd_unweighted": vector_mean_direction("wd")}
    return rounded(C.calendar_agg(events, "event_type", "ts", {}, extra=extra))


@query("""
  SELECT s.event_type, s.day, v.n, round(v.mean, 6) AS mean FROM (
    SELECT event_type, unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY))::DATE AS day
    FROM events GROUP BY event_type) s
  LEFT JOIN (SELECT event_type, CAST(ts AS DATE) AS day, count(value) AS n, avg(value) AS mean
             FROM events GROUP BY ALL) v USING (event_type, day)""")
def fill_calendar(spark, sf):
    days = C.calendar_agg(
        table(spark, sf, "events"), "event_type", "ts", {"n": ("value", "frequency"), "mean": ("value", "mean")}
    )
    return rounded(C.fill_calendar(days, "event_type", "day"))


# --------------------------------------------------------------------------- rolling operators


@query(f"SELECT series, day, round({roll_sql('value', 7)}, 8) AS roll FROM ({ORDERS_DAILY_LOG})")
def rolling_mean_7(spark, sf):
    out = W.rolling_mean(orders_daily_log(spark, sf), "series", "day", {"value": "roll"}, 7)
    return rounded(out.select("series", "day", "roll"), 8)


OLS_FRAME = "(PARTITION BY series ORDER BY {o} ROWS BETWEEN {p} PRECEDING AND CURRENT ROW)"


def ols_sql(source: str, w: int, order: str, x: str, out: str) -> str:
    f = OLS_FRAME.format(o=order, p=w - 1)
    full = f"CASE WHEN count(value) OVER {f} = {w} THEN"
    return f"""
  SELECT series, {order}, {out} FROM (SELECT *, lag(intercept) OVER o + lag(slope) OVER o * {x} AS forecast FROM (
    SELECT series, {order}, {full} regr_slope(value, {x}) OVER {f} END AS slope,
           {full} regr_intercept(value, {x}) OVER {f} END AS intercept,
           {full} regr_r2(value, {x}) OVER {f} END AS r2,
           {full} sqrt(greatest(regr_syy(value, {x}) OVER {f} - pow(regr_slope(value, {x}) OVER {f}, 2)
                  * regr_sxx(value, {x}) OVER {f}, 0) / {w - 2}) END AS sigma
    FROM ({source})) WINDOW o AS (PARTITION BY series ORDER BY {order}))"""


@query(ols_sql(ORDERS_DAILY, 14, "day", "epoch(day)", "round(slope, 8) AS slope, round(r2, 8) AS r2, round(sigma, 3) AS sigma"))
def rolling_ols(spark, sf):
    out = W.rolling_ols(orders_daily(spark, sf), "series", "day", "value", 14)
    return rounded(out.select("series", "day", "slope", "r2", "sigma"), {"slope": 8, "r2": 8, "sigma": 3})


OLS_ROUND = "round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(sigma, 4) AS sigma"


@query(ols_sql(SIGNAL, 140, "index", "index", OLS_ROUND))
def rolling_ols_wide(spark, sf):
    out = W.rolling_ols(signal(spark, sf), "series", "index", "value", 140, index="index")
    out = out.select("series", "index", "slope", "intercept", "r2", "sigma")
    return rounded(out, {"intercept": 4, "sigma": 4})


@query(ols_sql(SIGNAL, 40, "index", "index", "round(forecast, 6) AS forecast"))
def one_step_forecast(spark, sf):
    out = W.rolling_ols(signal(spark, sf), "series", "index", "value", 40, index="index")
    return rounded(out.select("series", "index", "forecast"))


@query(f"""
  SELECT series, day, unnest(['sigmas', 'r.squareds']) AS statistics, unnest([round(sigma, 3), round(r2, 3)]) AS value
  FROM ({ols_sql(ORDERS_DAILY, 14, "day", "epoch(day)", "sigma, r2")})""")
def rolling_fit_stats(spark, sf):
    return rounded(D.rolling_fit_stats(orders_daily(spark, sf), "series", "day", "value", 14), 3)


@query(f"""
  SELECT series, index, round(CASE WHEN lag(index) OVER o IS NULL THEN lead(value) OVER o - value
                                   WHEN lead(index) OVER o IS NULL THEN value - lag(value) OVER o
                                   ELSE (lead(value) OVER o - lag(value) OVER o) / 2 END, 6) AS gradient
  FROM ({SIGNAL}) WINDOW o AS (PARTITION BY series ORDER BY index)""")
def gradient(spark, sf):
    out = W.gradient(signal(spark, sf), "series", "index", "value", index="index")
    return rounded(out.select("series", "index", "gradient"))


@query(f"""
  SELECT series, index, CASE WHEN count(value) OVER f = 5 THEN max(value) OVER f END AS rollmax FROM ({SIGNAL})
  WINDOW f AS (PARTITION BY series ORDER BY index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_max(spark, sf):
    out = W.rolling_max(signal(spark, sf), "series", "index", "value", 5, index="index")
    return out.select("series", "index", "rollmax")


@query(f"""
  SELECT series, index, lag(value) OVER o AS lag_1, lead(value, 4) OVER o AS lead_4 FROM ({SIGNAL})
  WINDOW o AS (PARTITION BY series ORDER BY index)""")
def shift_rows(spark, sf):
    out = W.shift(signal(spark, sf), "series", "index", "value", 1, "lag_1", index="index")
    out = W.shift(out, "series", "index", "value", -4, "lead_4", index="index")
    return out.select("series", "index", "lag_1", "lead_4")


@query(f"""
  SELECT series, index, round(d, 6) AS d, sign(d) <> sign(lag(d) OVER o) AS flag
  FROM (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY index) AS d FROM ({SIGNAL}))
  WINDOW o AS (PARTITION BY series ORDER BY index)""")
def sign_change(spark, sf):
    out = W.sign_change(signal(spark, sf), "series", "index", "value", index="index")
    return rounded(out.select("series", "index", "d", "flag"))


@query(f"""
  SELECT series, index, max(value) OVER s AS max_value, min(value) OVER s AS min_value FROM ({SIGNAL})
  WINDOW s AS (PARTITION BY series)""")
def series_bounds(spark, sf):
    return W.series_bounds(signal(spark, sf), "series", ["value"]).select("series", "index", "max_value", "min_value")


def smooth_sql(source: str, bandwidth: float) -> str:
    sd = 0.3706506 * bandwidth  # quartiles of the kernel at a quarter of the bandwidth
    reach = int(4 * sd)
    weight = f"exp(-0.5 * pow((a.index - b.index) / {sd!r}::DOUBLE, 2))"
    return f"""
  SELECT a.series, a.index, any_value(a.value) AS value, sum({weight} * b.value) / sum({weight}) AS smooth
  FROM ({source}) a JOIN ({source}) b ON a.series = b.series AND b.index BETWEEN a.index - {reach} AND a.index + {reach}
  GROUP BY a.series, a.index"""


@query(f"SELECT series, index, round(smooth, 6) AS smooth FROM ({smooth_sql(SIGNAL, 10)})")
def kernel_smooth(spark, sf):
    out = W.kernel_smooth(signal(spark, sf), "series", "index", "value", 10, index="index")
    return rounded(out.select("series", "index", "smooth"))


@query(f"""
  SELECT a.series, a.index, b.index AS other_index, b.value AS other_value
  FROM ({SIGNAL}) a JOIN ({SIGNAL}) b ON a.series = b.series AND b.index BETWEEN a.index - 3 AND a.index + 3""")
def band_neighbours(spark, sf):
    out = J.band_join(signal(spark, sf), "series", "index", 3, ["value"])
    return out.select("series", "index", "other_index", "other_value")


# --------------------------------------------------------------------------- detectors

SIGN_RULE = "rollmax - lag(rollmax) OVER {over} > 0 AND sign(rollmax) = sign(lead(rollmax, %d) OVER {over}) AND rollmax > 0"
EQUAL_RULE = "rollmax - lag(rollmax) OVER {over} > 0 AND rollmax = lead(rollmax, %d) OVER {over}"
RATIO_RULE = "d2 > %s * lag(d2) OVER {over} AND lag(d2) OVER {over} > 1e-9"


@query(f"""WITH {detect_sql(ORDERS_DAILY, 14, SIGN_RULE % 13, 14)}
  SELECT series, day, round(d2, 8) AS change_point, round(rollmax, 8) AS rollmax, cp AS flag FROM d""")
def gradient_peaks_time(spark, sf):
    out = D.gradient_peaks(orders_daily(spark, sf), "series", "day", "value", 14, 14)
    return rounded(out.select("series", "day", "change_point", "rollmax", "flag"), 8)


@query(f"""WITH {detect_sql(f"SELECT code AS series, date, no2 AS value FROM ({READINGS})", 24, SIGN_RULE % 5, 6, order="date", x="epoch(date)")}
  SELECT series, date, round(3600 * d2, 8) AS change_point, cp AS flag FROM d""")
def gradient_peaks_hourly(spark, sf):
    hours = readings(spark, sf).select(F.col("code").alias("series"), "date", F.col("no2").alias("value"))
    out = D.gradient_peaks(hours, "series", "date", "value", 24, 6)
    out = out.withColumn("change_point", 3600 * F.col("change_point"))
    return rounded(out.select("series", "date", "change_point", "flag"), 8)


@query(f"""WITH {detect_sql(SIGNAL, 40, EQUAL_RULE % 4 + " AND rollmax > 0", 5, order="index", x="index", signal="round(abs(grad), 7)")}
  SELECT series, index, round(d2, 7) AS change_point, round(rollmax, 7) AS rollmax, cp AS flag FROM d""")
def gradient_peaks_index(spark, sf):
    out = D.gradient_peaks(signal(spark, sf), "series", "index", "value", 40, 5, "equal", digits=7, index="index")
    return rounded(out.select("series", "index", "change_point", "rollmax", "flag"), 7)


@query(f"""WITH {detect_sql(SIGNAL, 40, EQUAL_RULE % 4 + " AND rollmax > 0.001", 40, order="index", x="index", signal="round(abs(grad), 4)")}
  SELECT series, index, round(rollmax, 4) AS rollmax FROM d WHERE cp AND rollmax > 0.01""")
def gradient_peaks_floored(spark, sf):
    out = D.gradient_peaks(
        signal(spark, sf), "series", "index", "value", 40, 40, "equal", 4, digits=4, floor=0.001, index="index"
    )
    return rounded(P.flagged(out, "flag", "rollmax", 0.01).select("series", "index", "rollmax"), 4)


SIGNALS_LONG = """
  SELECT series, {t}, {w} AS window_length_level, cp, unnest([{names}]) AS variables,
         unnest([{ord}]) AS variables_ord, round(unnest([{cols}]), {digits}) + 0.0 AS value
  FROM d WHERE slope IS NOT NULL AND d2 IS NOT NULL AND r_squared IS NOT NULL AND cp IS NOT NULL{more}"""
DAY_NUMBER = "date_diff('day', DATE '1970-01-01', day)"
NAMES = "'Test dataset', 'Rolling gradient', '2nd derivative', 'Rollmax', 'r.squareds'"


@query(f"""WITH {detect_sql(ORDERS_DAILY_LOG, 21, EQUAL_RULE % 4, 7, x=DAY_NUMBER, slope="round(slope, 7)")}
  {SIGNALS_LONG.format(t="day", w=21, names=NAMES, ord="1, 2, 3, 4, 5", cols="value, slope, d2, rollmax, r_squared", digits=8, more=" AND rollmax IS NOT NULL")}""")
def gradient_peaks_long(spark, sf):
    daily = orders_daily_log(spark, sf)
    return rounded(D.gradient_peaks_long(daily, "series", "day", "value", 21, digits=7, k=7, x_unit="day"), 8)


@query(f"""WITH s AS ({smooth_sql(SIGNAL, 20)}),
  {detect_sql("SELECT * EXCLUDE (value), smooth AS value FROM s", 10, EQUAL_RULE % 2, 3, order="index", x="index", signal="abs(slope)")}
  SELECT series, index, round(d2, 6) AS abs_slope, round(rollmax, 6) AS rollmax, cp AS flag FROM d""")
def abs_slope_peaks(spark, sf):
    out = D.abs_slope_peaks(signal(spark, sf), "series", "index", "value", index="index")
    return rounded(out.select("series", "index", "abs_slope", "rollmax", "flag"))


@query(f"""
  WITH d0 AS (SELECT series, index, value - lag(value) OVER (PARTITION BY series ORDER BY index) AS value FROM ({SIGNAL})),
       s AS ({smooth_sql("SELECT * FROM d0 WHERE value IS NOT NULL", 10)}),
       f AS (SELECT *, sign(smooth) <> sign(lag(smooth) OVER (PARTITION BY series ORDER BY index)) AS flag FROM s)
  SELECT series, index, round(smooth, 6) AS smooth FROM f WHERE flag""")
def sign_change_points(spark, sf):
    steps = W.sign_change(signal(spark, sf), "series", "index", "value", index="index")
    steps = P.to_series(steps, "index", "d", "series").withColumn("index", F.col("index") - 1)
    out = D.sign_change_points(steps, "series", "index", "value", index="index")
    return rounded(out.select("series", (F.col("index") + 1).alias("index"), "smooth"))


@query(f"""WITH {detect_sql(ORDERS_DAILY, 7, RATIO_RULE % 2.5)}
  SELECT series, day, round(slope, 8) AS slope, round(r_squared, 8) AS r_squared, round(d2, 8) AS second_derivative, cp
  FROM d WHERE slope IS NOT NULL AND d2 IS NOT NULL AND r_squared IS NOT NULL AND cp IS NOT NULL""")
def gradient_ratio(spark, sf):
    out = D.gradient_ratio(orders_daily(spark, sf), "series", "day", "value", 7, 2.5)
    return rounded(out.select("series", "day", "slope", "r_squared", "second_derivative", "cp"), 8)


@query(f"""WITH {detect_sql(SIGNAL, 7, RATIO_RULE % 100 + " AND d2 - lag(d2) OVER {over} > 0", order="index", x="index")}
  SELECT series, index, round(d2, 8) AS second_derivative, cp
  FROM d WHERE slope IS NOT NULL AND d2 IS NOT NULL AND r_squared IS NOT NULL AND cp IS NOT NULL""")
def gradient_ratio_index(spark, sf):
    out = D.gradient_ratio(signal(spark, sf), "series", "index", "value", 7, 100, rising=True, index="index")
    return rounded(out.select("series", "index", "second_derivative", "cp"), 8)


def labelled(spark, sf) -> dict[str, DataFrame]:
    """Three labelled daily series: log order price, log line price and log quantity, 7-row means."""
    orders = table(spark, sf, "orders")
    items = table(spark, sf, "lineitem")
    series = {
        "Order price": C.calendar_agg(orders.withColumn("x", F.log("o_totalprice")), (), "o_orderdate", {"v": ("x", "mean")}),
        "Line price": C.calendar_agg(items.withColumn("x", F.log("l_extendedprice")), (), "l_shipdate", {"v": ("x", "mean")}),
        "Line quantity": C.calendar_agg(items.withColumn("x", F.log("l_quantity")), (), "l_shipdate", {"v": ("x", "mean")}),
    }
    return {
        text: P.to_series(W.rolling_mean(df, (), "day", {"v": "roll"}, 7), "day", "roll") for text, df in series.items()
    }


LABELLED = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT day, '{text}' AS df_header, CASE WHEN count(v) OVER f = 7 THEN avg(v) OVER f END AS value
    FROM (SELECT CAST({t} AS DATE) AS day, avg({c}) AS v FROM {source} GROUP BY ALL)
    WINDOW f AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) WHERE value IS NOT NULL"""
    for text, t, c, source in (
        ("Order price", "o_orderdate", "ln(o_totalprice)", "orders"),
        ("Line price", "l_shipdate", "ln(l_extendedprice)", "lineitem"),
        ("Line quantity", "l_shipdate", "ln(l_quantity)", "lineitem"),
    )
)
MULTI = detect_sql(LABELLED, 7, RATIO_RULE % 2, part="df_header")
MULTI_COMPLETE = "slope IS NOT NULL AND d2 IS NOT NULL AND r_squared IS NOT NULL AND cp IS NOT NULL"


@query(f"""WITH {MULTI}
  SELECT df_header AS df_label, day, cp, unnest(['Input dataset', 'Rolling gradient', '2nd derivative', 'r.squareds']) AS variables,
         unnest([1, 2, 3, 4]) AS variables_ord, round(unnest([value, 86400 * slope, 86400 * d2, r_squared]), 8) + 0.0 AS value
  FROM d WHERE {MULTI_COMPLETE}""")
def multi_series_ratio(spark, sf):
    out = studies.intervention_study(labelled(spark, sf))[0]
    per_day = F.when(F.col("variables").isin("Rolling gradient", "2nd derivative"), 86400.0).otherwise(1.0)
    return rounded(out.withColumn("value", F.col("value") * per_day), 8)


@query(f"""WITH {MULTI}
  SELECT day, count(DISTINCT df_header) AS n_series FROM d WHERE cp AND {MULTI_COMPLETE} GROUP BY day
  HAVING count(DISTINCT df_header) >= 2""")
def coinciding(spark, sf):
    return studies.intervention_study(labelled(spark, sf))[1]


def sweep_sql(source: str, windows: list[int], rule: str, k: int, signal: str = "abs(grad)", slope: str = "slope", **kw) -> str:
    parts = [detect_sql(source, w, rule, k, signal=signal, slope=slope, name=f"w{w}_", **kw) for w in windows]
    rows = " UNION ALL ".join(f"SELECT *, {w} AS window_length_level FROM w{w}_" for w in windows)
    return f"""{", ".join(parts)}, swept AS (SELECT * FROM ({rows}) WHERE slope IS NOT NULL AND d2 IS NOT NULL
      AND rollmax IS NOT NULL AND r_squared IS NOT NULL AND cp IS NOT NULL)"""


WINDOWS = [7, 14, 21, 28, 35, 42]
SWEEP = sweep_sql(ORDERS_DAILY_LOG, WINDOWS, EQUAL_RULE % 4, 7, x=DAY_NUMBER, slope="round(slope, 7)")


@query(f"""WITH {SWEEP}
  SELECT series, day, window_length_level, round(slope, 8) AS slope, round(d2, 8) AS second_derivative,
         round(rollmax, 8) AS rollmax, round(r_squared, 6) AS r_squared, cp FROM swept""")
def sweep_windows(spark, sf):
    out = D.sweep_windows(orders_daily_log(spark, sf), "series", "day", "value", WINDOWS, x_unit="day")
    out = out.drop("value")
    return rounded(out, {"slope": 8, "second_derivative": 8, "rollmax": 8})


NOISE_LEVELS, NOISE_WINDOWS = [0.0, 2.0, 5.0, 10.0], [35, 140, 280, 700]
NOISY = f"""SELECT series, index, sd AS standard_deviation,
    value + sd * {uniform_sql("series", "index", "CASE WHEN sd < 10 THEN sd::INT || '.0' ELSE '10.0' END", "0")} AS value
  FROM ({SIGNAL}), (SELECT unnest([0.0, 2.0, 5.0, 10.0]::DOUBLE[]) AS sd)"""
NOISE_SWEEP = sweep_sql(
    NOISY,
    NOISE_WINDOWS,
    EQUAL_RULE % 4 + " AND rollmax > 1e-5",
    7,
    signal="round(abs(grad), 4)",
    part="series, standard_deviation",
    order="index",
    x="index",
)


@query(f"""WITH {NOISE_SWEEP}
  SELECT series, standard_deviation, index, window_length_level, round(d2, 4) AS second_derivative,
         round(rollmax, 4) AS rollmax, cp FROM swept""")
def sweep_noise(spark, sf):
    out = D.sweep_noise(signal(spark, sf), "series", "index", "value", NOISE_LEVELS, NOISE_WINDOWS, index="index")
    keep = ["series", "standard_deviation", "index", "window_length_level", "second_derivative", "rollmax", "cp"]
    return rounded(out.select(*keep), 4)


@query(f"""WITH {NOISE_SWEEP}
  SELECT series, standard_deviation, window_length_level, count(*) AS n_rows, round(avg(r_squared), 8) AS mean_r_squared,
         round(max(r_squared), 8) AS max_r_squared FROM swept GROUP BY ALL""")
def sweep_noise_stats(spark, sf):
    out = D.sweep_noise(
        signal(spark, sf), "series", "index", "value", NOISE_LEVELS, NOISE_WINDOWS, fit=True, index="index"
    )
    return rounded(
        out.groupBy("series", "standard_deviation", "window_length_level").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg("r_squared").alias("mean_r_squared"),
            F.max("r_squared").alias("max_r_squared"),
        ),
        8,
    )


@query(f"""WITH {NOISE_SWEEP},
  g AS (SELECT standard_deviation, series, window_length_level, sum(cp::INT)::BIGINT AS n_cp, min(index) i0, max(index) i1,
               min(value) v0, max(value) v1 FROM swept GROUP BY ALL)
  SELECT standard_deviation, series, window_length_level, n_cp, 'n = ' || n_cp AS n_label,
         round(min(i0) OVER s + (max(i1) OVER s - min(i0) OVER s) * 0.2::DOUBLE, 4) AS x,
         round(min(v0) OVER s + (max(v1) OVER s - min(v0) OVER s) * 0.8::DOUBLE, 4) AS y
  FROM g WINDOW s AS (PARTITION BY standard_deviation, series)""")
def cp_counts(spark, sf):
    out = D.sweep_noise(signal(spark, sf), "series", "index", "value", NOISE_LEVELS, NOISE_WINDOWS, index="index")
    within = ["standard_deviation", "series"]
    return rounded(C.count_change_points(out, ["window_length_level"], "index", "noise", within=within), 4)


NOISE_PERCENTAGES = {35: "1.25%", 140: "5%", 280: "10%", 700: "25%"}
PERCENTAGE = "CASE window_length_level " + " ".join(f"WHEN {w} THEN '{p}'" for w, p in NOISE_PERCENTAGES.items()) + " END"


@query(f"""WITH {NOISE_SWEEP}
  SELECT series, standard_deviation, index, window_length_level, {PERCENTAGE} AS percentage_level, cp,
         unnest(['Test dataset', 'Rolling gradient', '2nd derivative', 'Applied rollmax']) AS variables,
         unnest([1, 2, 3, 4]) AS variables_ord,
         round(unnest([value, slope, d2, rollmax]), 4) + 0.0 AS value FROM swept""")
def sweep_noise_long(spark, sf):
    out = D.sweep_noise_long(
        signal(spark, sf), "series", "index", "value", NOISE_LEVELS, NOISE_PERCENTAGES, index="index"
    )
    return rounded(out, 4)


@query(f"""WITH {NOISE_SWEEP},
  g AS (SELECT standard_deviation, series, {PERCENTAGE} AS percentage_level, sum(cp::INT)::BIGINT AS n_cp, min(index) i0,
               max(index) i1, min(value) v0, max(value) v1 FROM swept GROUP BY ALL)
  SELECT standard_deviation, series, percentage_level, n_cp, 'n = ' || n_cp AS n_label,
         round(min(i0) OVER s + (max(i1) OVER s - min(i0) OVER s) * 0.2::DOUBLE, 4) AS x,
         round(min(v0) OVER s + (max(v1) OVER s - min(v0) OVER s) * 0.8::DOUBLE, 4) AS y
  FROM g WINDOW s AS (PARTITION BY standard_deviation, series)""")
def cp_counts_by_level(spark, sf):
    out = D.sweep_noise(signal(spark, sf), "series", "index", "value", NOISE_LEVELS, NOISE_PERCENTAGES, index="index")
    within = ["standard_deviation", "series"]
    return rounded(C.count_change_points(out, ["percentage_level"], "index", "noise", within=within), 4)


NOISE_FITS = " UNION ALL ".join(
    f"""SELECT series, standard_deviation, index, {w} AS window_length_level,
      CASE WHEN count(value) OVER f = {w} THEN regr_sxx(value, index) OVER f END AS xx,
      regr_syy(value, index) OVER f AS yy, regr_sxy(value, index) OVER f AS xy FROM ({NOISY})
      WINDOW f AS (PARTITION BY series, standard_deviation ORDER BY index ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"""
    for w in NOISE_WINDOWS
)


@query(f"""WITH s AS (
    SELECT series, standard_deviation, {PERCENTAGE} AS percentage_level, unnest(['sigmas', 'r.squareds']) AS statistics,
           unnest([CASE WHEN xx > 0 THEN sqrt(greatest(yy - xy * xy / xx, 0) / (window_length_level - 2)) END,
                   CASE WHEN xx * yy > 0 THEN xy * xy / (xx * yy) END]) AS value
    FROM ({NOISE_FITS}))
  SELECT series, standard_deviation, percentage_level, statistics, count(*) AS n_rows, count(value) AS n_values,
         round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min FROM s GROUP BY ALL""")
def noise_fit_stats(spark, sf):
    out = D.noise_fit_stats(
        signal(spark, sf), "series", "index", "value", NOISE_LEVELS, NOISE_PERCENTAGES, index="index"
    )
    return rounded(
        out.groupBy("series", "standard_deviation", "percentage_level", "statistics").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"),
            F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"),
        )
    )


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation
  WHERE n_nationkey IS NOT NULL AND n_name IS NOT NULL AND n_regionkey IS NOT NULL""")
def site_map_rows(spark, sf):
    return read_site_map(spark, f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


HORIZONS = [("One year", "1996-01-01"), ("Three years", "1998-01-01"), ("All", "2001-12-31")]
REPLAY = " UNION ALL ".join(
    f"SELECT *, '{text}' AS time_frame, {n} AS time_frame_ord FROM ({ORDERS_DAILY}) WHERE day <= DATE '{cutoff}'"
    for n, (text, cutoff) in enumerate(HORIZONS, start=1)
)


@query(f"""WITH {detect_sql(REPLAY, 6, SIGN_RULE % 1, 2, part="series, time_frame")}
  SELECT series, time_frame, time_frame_ord, day, round(rollmax, 8) AS rollmax, cp AS flag FROM d""")
def horizon_replay(spark, sf):
    out = studies.horizon_study(orders_daily(spark, sf), "value", HORIZONS, keys="series")
    return rounded(out.select("series", "time_frame", "time_frame_ord", "day", "rollmax", "flag"), 8)


# --------------------------------------------------------------------------- segmentation


@query(f"""
  WITH v AS (SELECT series, index, value - avg(value) OVER (PARTITION BY series) AS v FROM ({SIGNAL})),
  p AS (SELECT series, index AS i, count(*) OVER w AS n, sum(v) OVER (PARTITION BY series ORDER BY index) AS s1,
               sum(v * v) OVER (PARTITION BY series ORDER BY index) AS s2, sum(v) OVER w AS t1, sum(v * v) OVER w AS t2
        FROM v WINDOW w AS (PARTITION BY series)),
  c AS (SELECT *, n * ln(greatest(t2 / n - pow(t1 / n, 2), 1e-10)) AS null_cost,
          CASE WHEN i >= 2 AND n - i >= 2 THEN i * ln(greatest(s2 / i - pow(s1 / i, 2), 1e-10))
            + (n - i) * ln(greatest((t2 - s2) / (n - i) - pow((t1 - s1) / (n - i), 2), 1e-10)) + ln(i) + ln(n - i) END AS cost
        FROM p)
  SELECT series, any_value(n) AS n, arg_min(i, cost) AS tau, round(any_value(null_cost), 4) AS null_cost,
         round(min(cost), 4) AS cost, any_value(null_cost) - min(cost) > 4 * ln(any_value(n)) AS accepted
  FROM c GROUP BY series""")
def meanvar_split(spark, sf):
    out = S.meanvar_split(signal(spark, sf), "series", "index", "value", index="index")
    return rounded(out.drop("at"), 4)


# --------------------------------------------------------------------------- reconstruction

MONTHLY = f"SELECT * FROM ({ORDERS_DAILY_LOG}) WHERE day = date_trunc('month', day) OR (value > 12.1 AND value < 12.2)"


def month_knots(daily: DataFrame) -> DataFrame:
    return daily.filter((F.col("day") == F.trunc("day", "month")) | ((F.col("value") > 12.1) & (F.col("value") < 12.2)))


def line_sql(grid: str, knots: str, part: str) -> str:
    """Grid rows with the neighbouring knots and the line between them."""
    keys = ", ".join(f"g.{c.strip()}" for c in part.split(","))
    using = ", ".join(c.strip() for c in part.split(","))
    return f"""
  SELECT {keys}, g.day, a.day AS prev_t, a.value AS prev_value, b.day AS next_t, b.value AS next_value,
         CASE WHEN a.day = b.day THEN a.value
              WHEN a.day < b.day THEN a.value + (g.day - a.day) / (b.day - a.day)::DOUBLE * (b.value - a.value) END AS approx_value
  FROM ({grid}) g
  ASOF LEFT JOIN ({knots}) a ON {" AND ".join(f"g.{c.strip()} = a.{c.strip()}" for c in part.split(","))} AND g.day >= a.day
  ASOF LEFT JOIN ({knots}) b ON {" AND ".join(f"g.{c.strip()} = b.{c.strip()}" for c in part.split(","))} AND g.day <= b.day"""


GRID = f"""SELECT series, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day
  FROM ({ORDERS_DAILY}) GROUP BY series"""


@query(f"SELECT series, day, round(approx_value, 8) AS approx_value FROM ({line_sql(GRID, MONTHLY, 'series')})")
def interpolate_linear(spark, sf):
    daily = orders_daily_log(spark, sf)
    grid = C.day_grid(daily, "series", "day")
    return rounded(E.interpolate_linear(month_knots(daily), grid, "series", "day"), 8)


@query(f"""SELECT series, day, prev_t::VARCHAR AS prev_t, round(prev_value, 8) AS prev_value,
    next_t::VARCHAR AS next_t, round(next_value, 8) AS next_value
  FROM ({line_sql(GRID, MONTHLY, 'series')})""")
def knots_around(spark, sf):
    daily = orders_daily_log(spark, sf)
    grid = C.day_grid(daily, "series", "day")
    out = E.knots_around(grid, month_knots(daily), "series", "day")
    return rounded(out.withColumns({c: F.col(c).cast("string") for c in ("prev_t", "next_t")}), 8)


LINES = f"""lines AS (SELECT s.series, s.window_length_level, s.day, s.cp, s.value, l.approx_value FROM swept s LEFT JOIN (
  {line_sql("SELECT * FROM swept", "SELECT * FROM swept WHERE cp", "series, window_length_level")}) l
  USING (series, window_length_level, day))"""


@query(f"""WITH {SWEEP}, {LINES}
  SELECT series, window_length_level, round(sqrt(avg(pow(value - approx_value, 2))), 8) AS rmse,
         round(corr(value, approx_value), 8) AS rsquared
  FROM lines WHERE approx_value IS NOT NULL GROUP BY ALL""")
def score_reconstruction(spark, sf):
    return rounded(studies.window_study(orders_daily_log(spark, sf), "series", WINDOWS, x_unit="day")[1], 8)


@query(f"""WITH {SWEEP}, {LINES}
  SELECT series, window_length_level, day, cp, unnest(['f(x)', 'Approxed f(x)']) AS variables,
         round(unnest([value, approx_value]), 8) AS value
  FROM lines WHERE approx_value IS NOT NULL""")
def reconstruction_long(spark, sf):
    lines = studies.window_study(orders_daily_log(spark, sf), "series", WINDOWS, x_unit="day")[0]
    return rounded(E.reconstruction_long(lines, ["series", "window_length_level", "day", "cp"]), 8)


# --------------------------------------------------------------------------- joins

JOINED_COLS = ["code", "met_code", "date", "station", "no2", "o3", "ws", "wd", "air_temp", "atmos_pres", "RH", "cl"]
JOINED_SQL = """code, met_code, date, station, round(no2, 6) AS no2, o3, round(w.ws, 6) AS ws, round(wd, 4) AS wd,
  air_temp, atmos_pres, round("RH", 6) AS "RH", cl"""


@query(f"""SELECT {JOINED_SQL} FROM ({WEATHER}) w JOIN ({SITE_MAP}) m USING (met_code)
  LEFT JOIN ({READINGS}) r USING (code, date)""")
def met_join_left(spark, sf):
    out = J.join_weather(readings(spark, sf), weather(spark, sf), site_map(spark, sf))
    return rounded(out.select(*JOINED_COLS), {"wd": 4})


@query(f"""SELECT {JOINED_SQL} FROM ({READINGS}) r LEFT JOIN ({SITE_MAP}) m USING (code)
  LEFT JOIN ({WEATHER}) w USING (met_code, date)""")
def readings_join_left(spark, sf):
    out = J.join_weather(readings(spark, sf), weather(spark, sf), site_map(spark, sf), keep="readings")
    return rounded(out.select(*JOINED_COLS), {"wd": 4})


@query(f"""SELECT a.day, a.series AS status, b.series AS line, round(a.value, 8) AS value, round(b.price, 8) AS price
  FROM ({ORDERS_DAILY_LOG}) a JOIN ({LINEITEM_DAILY}) b ON a.day = b.day AND a.series = right(b.series, 1)""")
def inner_merge(spark, sf):
    lines = lineitem_daily(spark, sf).select("day", F.col("series").alias("line"), F.right("series", F.lit(1)).alias("status"), "price")
    orders = orders_daily_log(spark, sf).withColumnRenamed("series", "status")
    return rounded(J.inner_on(orders, lines, ["day", "status"]), 8)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09)""")
def semi_subset(spark, sf):
    members = table(spark, sf, "lineitem").filter(F.col("l_discount") >= 0.09).select(F.col("l_orderkey").alias("o_orderkey"))
    return J.keep_members(table(spark, sf, "orders"), members, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09) AS cp FROM orders""")
def mark_members(spark, sf):
    members = table(spark, sf, "lineitem").filter(F.col("l_discount") >= 0.09).select(F.col("l_orderkey").alias("o_orderkey"))
    return J.mark_members(table(spark, sf, "orders").select("o_orderkey"), members, "o_orderkey", "cp")


@query("""SELECT event_type AS series, index, a.value AS value, b.value AS largest FROM (
    SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS index FROM events) a
  JOIN (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS index FROM events) b
  USING (event_type, index)""")
def align_positions(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("series"), (-F.col("event_id")).alias("down"), "value")
    other = L.add_index(events, "series", "down").select("series", "index", F.col("value").alias("largest"))
    return J.align(signal(spark, sf), other, "series", "index").select("series", "index", "value", "largest")


@query(f"""SELECT a.series, a.day, round(a.value, 8) AS value, round(b.quantity, 6) AS quantity FROM ({ORDERS_DAILY_LOG}) a
  LEFT JOIN (SELECT l_linestatus AS series, CAST(l_shipdate AS DATE) AS day, avg(sqrt(l_quantity)) AS quantity
             FROM lineitem GROUP BY ALL) b USING (series, day)""")
def attach_columns(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("series"), "l_shipdate", F.sqrt("l_quantity").alias("x")
    )
    other = C.calendar_agg(items, "series", "l_shipdate", {"quantity": ("x", "mean")})
    return rounded(J.attach(orders_daily_log(spark, sf), other, ["series", "day"]), {"value": 8})


# --------------------------------------------------------------------------- shape and scalars


@query(f"SELECT series, day, unnest(['price', 'quantity', 'discount', 'tax']) AS variables, round(unnest([price, quantity, discount, tax]), 7) AS value FROM ({LINEITEM_DAILY})")
def unpivot_long(spark, sf):
    return rounded(P.to_long(lineitem_daily(spark, sf), ["series", "day"]), 7)


@query("""SELECT 'orders' AS df_header, CAST(o_orderdate AS DATE) AS day, o_totalprice AS value FROM orders
  UNION ALL SELECT 'lines', CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem""")
def union_labelled(spark, sf):
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))
    lines = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("value"))
    return P.union_labelled({"orders": orders, "lines": lines}, "df_header").select("df_header", "day", "value")


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct_keys(spark, sf):
    return P.distinct_keys(table(spark, sf, "orders"), "o_custkey")


@query("""SELECT max(o_totalprice) AS max_o_totalprice, count(*) AS n_rows, min(o_orderdate)::DATE AS first_day,
  max(o_orderdate)::DATE AS last_day FROM orders""")
def summary_scalars(spark, sf):
    orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return P.summary_scalars(orders, "o_totalprice", "day")


@query("SELECT o_custkey, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1")
def endpoints(spark, sf):
    return P.endpoints(table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS index FROM events")
def add_index(spark, sf):
    out = L.add_index(table(spark, sf, "events"), "event_type", "ts", tie=["event_id"])
    return out.select("event_id", "index")


@query(f"SELECT series, index - 99 AS index, value FROM ({SIGNAL}) WHERE index BETWEEN 100 AND 1500")
def slice_index(spark, sf):
    return P.slice_index(signal(spark, sf), "index", 100, 1500).select("series", "index", "value")


@query(f"SELECT series, day, round(price, 8) AS value FROM ({LINEITEM_DAILY}) WHERE price IS NOT NULL")
def to_series(spark, sf):
    return rounded(P.to_series(lineitem_daily(spark, sf), "day", "price", "series"), 8)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice, 'study' AS time_frame,
  list_position(['O', 'F'], o_orderstatus)::INT AS o_orderstatus_ord FROM orders""")
def ordinal_labels(spark, sf):
    orders = P.pick(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"], "o_totalprice")
    return P.add_ordinal(P.label(orders, "time_frame", "study"), "o_orderstatus", ["O", "F"])


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice IS NOT NULL
    AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31'""")
def filtered_rows(spark, sf):
    df = P.between_dates(table(spark, sf, "orders"), "o_orderdate", "1996-01-01", "1999-12-31")
    df = P.keep_values(P.where_eq(df, o_orderstatus="F"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    df = P.keep_not_null(P.complete_rows(df), "o_totalprice")
    df = P.reorder(P.drop_existing(df, ["o_custkey", "latitude"]), "o_totalprice", "o_orderpriority")
    return P.pick_existing(df, ["o_orderkey", "o_orderpriority", "o_totalprice", "longitude"])


COMPLIANCE = f"""
  SELECT strftime(day, '%a %d/%m/%Y') AS date, CASE WHEN n % 23 = 0 THEN '{NOT_COUNTED}' ELSE format('{{:,}}', n) END AS total,
         CASE WHEN n % 23 = 0 THEN '{NOT_COUNTED}' ELSE format('{{:,}}', c) END AS compliant,
         CASE WHEN n % 23 = 0 THEN '{NOT_COUNTED}' ELSE format('{{:,}}', n - c) END AS other
  FROM (SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) AS BIGINT) AS n,
               CAST(sum(CASE WHEN l_discount < 0.05 THEN l_quantity ELSE 0 END) AS BIGINT) AS c FROM lineitem GROUP BY ALL)"""


def compliance_text(spark, sf) -> DataFrame:
    """Daily quantities as the text columns of the compliance file."""
    days = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").cast("long").alias("n"),
        F.sum(F.when(F.col("l_discount") < 0.05, F.col("l_quantity")).otherwise(0.0)).cast("long").alias("c"),
    )
    counts = {"n": F.col("n"), "c": F.col("c"), "o": F.col("n") - F.col("c")}
    text = [F.when(F.col("n") % 23 == 0, NOT_COUNTED).otherwise(F.format_number(c, 0)) for c in counts.values()]
    columns = [F.date_format("day", "EEE dd/MM/yyyy"), *text]
    return days.select(*[c.alias(name) for c, name in zip(columns, COMPLIANCE_COLUMNS)])


COMPLIANCE_PARSED = f"""
  SELECT date, total_vehicle_number, compliant_number, non_compliant_number, share AS compliant_percentage,
         CASE WHEN count(share) OVER f = 7 THEN avg(share) OVER f END AS d7_rollavg_compliant_percentage
  FROM (SELECT strptime(substr(date, 5), '%d/%m/%Y')::DATE AS date, replace(total, ',', '')::DOUBLE AS total_vehicle_number,
               replace(compliant, ',', '')::DOUBLE AS compliant_number, replace(other, ',', '')::DOUBLE AS non_compliant_number,
               replace(compliant, ',', '')::DOUBLE / replace(total, ',', '')::DOUBLE * 100 AS share
        FROM ({COMPLIANCE}) WHERE total <> '{NOT_COUNTED}')
  WINDOW f AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


@query(f"""SELECT * REPLACE (round(compliant_percentage, 6) AS compliant_percentage,
  round(d7_rollavg_compliant_percentage, 6) AS d7_rollavg_compliant_percentage) FROM ({COMPLIANCE_PARSED})""")
def compliance_parse(spark, sf):
    return rounded(parse_compliance(compliance_text(spark, sf)))


# The label is a fixed value.
@query(f"""SELECT date AS day, round(d7_rollavg_compliant_percentage, 6) AS value, 'Compliance stats ULEZ' AS df_header
  FROM ({COMPLIANCE_PARSED}) WHERE d7_rollavg_compliant_percentage IS NOT NULL""")
def compliance_series(spark, sf):
    return rounded(R.compliance_series(parse_compliance(compliance_text(spark, sf))))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day,
  (epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 3600 + 1 AS hours, o_totalprice / nullif(o_custkey % 10, 0) * 100 AS share
  FROM orders""")
def scalar_parts(spark, sf):
    orders = table(spark, sf, "orders")
    hours = X.hours_between("o_orderdate", X.parse_ts(F.lit("2002-01-01 00:00:00")))
    share = X.percent("o_totalprice", F.col("o_custkey") % 10)
    return orders.select("o_orderkey", *X.date_parts("o_orderdate"), hours.alias("hours"), share.alias("share"))


# --------------------------------------------------------------------------- daily products

PAIR = "avg(value_predict) AS bm, stddev_samp(value_predict) AS bs, avg(value) AS om, stddev_samp(value) AS os, count(value) AS n"


def summary_sql(source: str, first: str, rolled: list[str], deltas: bool, extra: str = "", where: str = "") -> str:
    named = f'bm AS "{first}_mean", bs AS "{first}_sd", om AS observed_mean, os AS observed_sd'
    if deltas:
        named += ', om - bm AS "delta_BAU_predict_mean", abs(os - bs) AS "delta_BAU_predict_sd"'
    if extra:
        named += ", nm AS rm_normal_mean, ns AS rm_normal_sd"
    out = [f'"{first}_mean"', f'"{first}_sd"', "observed_mean", "observed_sd", '"CI_lower"', '"CI_upper"']
    out += ['"delta_BAU_predict_mean"', '"delta_BAU_predict_sd"'] if deltas else []
    out += ["rm_normal_mean", "rm_normal_sd"] if extra else []
    frame = "(ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    rolls = [
        f'round(CASE WHEN count("{c}") OVER {frame} = 7 THEN avg("{c}") OVER {frame} END, 6) AS "d7_rollavg_{c}"'
        for c in rolled
    ]
    return f"""
  SELECT day, {", ".join(f"round({c}, 6) AS {c}" for c in out)}, {", ".join(rolls)}
  FROM (SELECT day, {named}, om - 1.96 * os / sqrt(n) AS "CI_lower", om + 1.96 * os / sqrt(n) AS "CI_upper"
        FROM (SELECT CAST(date AS DATE) AS day, {PAIR}{extra} FROM ({source}) {where} GROUP BY ALL))"""


BAU_ROLLED = ["delta_BAU_predict_mean", "delta_BAU_predict_sd", "observed_mean", "BAU_mean", "CI_lower", "CI_upper"]
DAILY_SQL = summary_sql(
    BAU,
    "BAU",
    [*BAU_ROLLED, "rm_normal_mean"],
    True,
    ", avg(rm_normal_value) AS nm, stddev_samp(rm_normal_value) AS ns",
)


@query(DAILY_SQL)
def daily_summary(spark, sf):
    return rounded(R.daily_summary(bau(spark, sf)))


@query(summary_sql(BAU, "BAU", BAU_ROLLED, True))
def reshape_bau_subset(spark, sf):
    return rounded(R.daily_summary_subset(bau(spark, sf), "bau"))


NORMAL = f"SELECT site, date, value, rm_normal_value AS value_predict FROM ({BAU})"
SUBSET_SITES = ["AF", "NO", "RO"]


@query(
    summary_sql(
        NORMAL,
        "normal",
        ["normal_mean", "normal_sd", "observed_mean", "observed_sd", "CI_lower", "CI_upper"],
        False,
        where="WHERE site IN ('AF', 'NO', 'RO')",
    )
)
def reshape_normal_subset(spark, sf):
    normal = bau(spark, sf).select(
        "site", "date", F.col("value").alias("raw_value"), F.col("rm_normal_value").alias("value_predict")
    )
    return rounded(R.daily_summary_subset(normal, "normal", SUBSET_SITES))


def roll7(c: str) -> str:
    return f"CASE WHEN count({c}) OVER f = 7 THEN avg({c}) OVER f END"


ROLL7 = "WINDOW f AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(f"""SELECT day, round(m, 6) AS observed_mean, round(hi, 6) AS observed_max, round(lo, 6) AS observed_min,
    round(s, 6) AS observed_sd, round({roll7("m")}, 6) AS d7_rollavg_mean, round({roll7("hi")}, 6) AS d7_rollavg_max,
    round({roll7("lo")}, 6) AS d7_rollavg_min, round({roll7("s")}, 6) AS d7_rollavg_sd
  FROM (SELECT CAST(date AS DATE) AS day, median(value) AS m, max(value) AS hi, min(value) AS lo, stddev_samp(value) AS s
        FROM ({BAU}) GROUP BY ALL) {ROLL7}""")
def reshape_observed(spark, sf):
    return rounded(R.daily_observed(bau(spark, sf)))


@query(f"""SELECT day, unnest(['BAU', 'observed', 'delta']) AS variables, round(unnest([b, o, d]), 6) AS value
  FROM (SELECT day, {roll7("b")} AS b, {roll7("o")} AS o, {roll7("d")} AS d
        FROM (SELECT CAST(date AS DATE) AS day, avg(value_predict) AS b, avg(value) AS o, avg(value - value_predict) AS d
              FROM ({BAU}) GROUP BY ALL) {ROLL7})
  WHERE b IS NOT NULL AND o IS NOT NULL AND d IS NOT NULL""")
def reshape_bau_output(spark, sf):
    return rounded(R.daily_output_long(bau(spark, sf)))


SITE_WEATHER = """
  SELECT l_returnflag || l_linestatus AS site, l_shipdate AS date, avg(l_quantity) AS ws,
         sum(l_partkey)::DOUBLE % 360.0::DOUBLE AS wd, avg(l_discount) AS air_temp, avg(l_tax) AS RH
  FROM lineitem GROUP BY ALL"""


def site_weather(spark, sf) -> DataFrame:
    items = table(spark, sf, "lineitem")
    return items.groupBy(F.concat("l_returnflag", "l_linestatus").alias("site"), F.col("l_shipdate").alias("date")).agg(
        F.avg("l_quantity").alias("ws"),
        F.pmod(F.sum("l_partkey").cast("double"), F.lit(360.0)).alias("wd"),
        F.avg("l_discount").alias("air_temp"),
        F.avg("l_tax").alias("RH"),
    )


@query(f"""
  WITH p AS (SELECT CAST(date AS DATE) AS day, avg(value - value_predict) AS d, avg(value_predict) AS b, avg(value) AS o,
      avg(ws) AS ws, avg(air_temp) AS t, avg(RH) AS h,
      degrees(atan2(avg(ws * sin(radians(wd))), avg(ws * cos(radians(wd))))) AS a
    FROM ({BAU}) JOIN ({SITE_WEATHER}) USING (site, date) GROUP BY ALL),
  q AS (SELECT * EXCLUDE (a), CASE WHEN a < 0 THEN a + 360 ELSE a END AS wd FROM p),
  z AS (SELECT day, {roll7("d")} AS d, {roll7("b")} AS b, {roll7("o")} AS o, {roll7("ws")} AS ws, {roll7("wd")} AS wd,
          {roll7("t")} AS t, {roll7("h")} AS h FROM q {ROLL7})
  SELECT day, unnest(['Delta', 'BAU', 'observed', 'WS', 'WD', 'Temp', 'RelHum']) AS variables,
         unnest([1, 2, 3, 4, 5, 6, 7]) AS variables_ord, round(unnest([d, b, o, ws, wd, t, h]), 6) AS value
  FROM z WHERE d IS NOT NULL AND b IS NOT NULL AND o IS NOT NULL AND ws IS NOT NULL AND wd IS NOT NULL
    AND t IS NOT NULL AND h IS NOT NULL""")
def reshape_delta_weather(spark, sf):
    return rounded(R.daily_delta_weather(bau(spark, sf), site_weather(spark, sf)))


@query(f"""SELECT day, "d7_rollavg_CI_lower", "d7_rollavg_CI_upper",
    unnest(['d7_rollavg_observed_mean', 'd7_rollavg_BAU_mean']) AS model_output,
    unnest([d7_rollavg_observed_mean, "d7_rollavg_BAU_mean"]) AS value
  FROM ({DAILY_SQL}) WHERE day BETWEEN DATE '1998-02-01' AND DATE '1998-02-28'""")
def validation_slice(spark, sf):
    return rounded(R.validation_slice(R.daily_summary(bau(spark, sf)), "1998-02-01", "1998-02-28"))


@query(f"""SELECT day, unnest(['BAU - observed (delta)', 'weather normalised']) AS delta, unnest([d, m]) AS value
  FROM (SELECT day, "d7_rollavg_delta_BAU_predict_mean" AS d, d7_rollavg_rm_normal_mean AS m FROM ({DAILY_SQL}))
  WHERE d IS NOT NULL AND m IS NOT NULL""")
def comparison_long(spark, sf):
    series = {
        "BAU - observed (delta)": "d7_rollavg_delta_BAU_predict_mean",
        "weather normalised": "d7_rollavg_rm_normal_mean",
    }
    return rounded(R.comparison_long(R.daily_summary(bau(spark, sf)), series))


# --------------------------------------------------------------------------- modelling inputs

COVERED = f"""SELECT code, count(*) AS n_rows, count(*) / (19 * 24 + 1.0::DOUBLE) AS coverage
  FROM ({READINGS}) WHERE date >= TIMESTAMP '2024-01-02' GROUP BY ALL"""


@query(f"SELECT code, n_rows, round(coverage, 8) AS coverage, coverage >= 0.85 AS passes FROM ({COVERED})")
def coverage_ratio(spark, sf):
    cov = C.coverage(readings(spark, sf), "code", "date", "2024-01-02", "2024-01-21")
    return rounded(cov.withColumn("passes", F.col("coverage") >= 0.85), 8)


@query(f"""SELECT code, date, round(no2, 6) AS no2 FROM ({READINGS})
  WHERE code IN (SELECT code FROM ({COVERED}) WHERE coverage >= 0.85)""")
def coverage_gate(spark, sf):
    df = readings(spark, sf)
    cov = C.coverage(df, "code", "date", "2024-01-02", "2024-01-21")
    return rounded(C.gate(df, cov, "code").select("code", "date", "no2"))


@query(f"SELECT met_code, sum(atmos_pres) > 0 AS has_atmos_pres FROM ({WEATHER}) GROUP BY ALL")
def has_signal(spark, sf):
    return C.has_signal(weather(spark, sf), "met_code", "atmos_pres")


@query("""SELECT event_id, epoch(ts)::BIGINT - CASE WHEN epoch(ts) < epoch(ts)::BIGINT THEN 1 ELSE 0 END AS date_unix,
  dayofyear(ts)::INT AS day_julian, isodow(ts)::INT AS weekday, hour(ts)::INT AS hour FROM events""")
def feature_calendar(spark, sf):
    out = X.calendar_features(table(spark, sf, "events"), "ts")
    return out.select("event_id", "date_unix", "day_julian", "weekday", "hour")


FILLED = f"""
  SELECT i.*, coalesce(i.atmospheric_pressure, m.p) AS pressure
  FROM ({MODEL_INPUT}) i JOIN (SELECT code, median(atmospheric_pressure) AS p FROM ({MODEL_INPUT}) GROUP BY ALL) m USING (code)"""


@query(f"SELECT code, date, round(pressure, 6) AS atmospheric_pressure FROM ({FILLED})")
def impute_median(spark, sf):
    out = M.fill_medians(model_input(spark, sf), "code", ["atmospheric_pressure"])
    return rounded(out.select("code", "date", "atmospheric_pressure"))


@query(f"""SELECT code, date, CASE WHEN {uniform_sql("code", "epoch_us(date)", "'set'", "0")} < 0.8 THEN 'training' ELSE 'testing' END AS set
  FROM ({MODEL_INPUT})""")
def hash_split(spark, sf):
    return M.split_sets(model_input(spark, sf), "code", "date").select("code", "date", "set")


PREPARED = """code, met_code, station, date, round(ws, 6) AS ws, round(wd, 4) AS wd, air_temp, {p}, round("RH", 6) AS "RH", cl, {v}"""


@query(f"""SELECT {PREPARED.format(p="atmos_pres AS atmospheric_pressure", v="pollutant, round(value, 6) AS value")} FROM (
    SELECT r.code, met_code, station, r.date, w.ws, w.wd, air_temp, atmos_pres, w.RH, cl, unnest(['no2', 'o3']) AS pollutant,
           unnest([no2, o3]) AS value
    FROM ({READINGS}) r JOIN ({SITE_MAP}) m ON r.code = m.code
    JOIN ({WEATHER}) w USING (met_code, date) WHERE site_type = 'Urban Background') WHERE value IS NOT NULL""")
def prepare_long(spark, sf):
    joined = J.join_weather(readings(spark, sf), weather(spark, sf), site_map(spark, sf))
    return rounded(M.prepare(joined, ["no2", "o3"], "Urban Background"), {"wd": 4})


@query(f"""SELECT {PREPARED.format(p="atmos_pres", v="o3")} FROM (
    SELECT r.code, met_code, station, r.date, w.ws, w.wd, air_temp, atmos_pres, w.RH, cl, o3
    FROM ({READINGS}) r JOIN ({SITE_MAP}) m ON r.code = m.code
    JOIN ({WEATHER}) w USING (met_code, date)) WHERE o3 IS NOT NULL""")
def prepare_wide(spark, sf):
    joined = J.join_weather(readings(spark, sf), weather(spark, sf), site_map(spark, sf))
    return rounded(M.prepare(joined, "o3", long=False), {"wd": 4})


SAMPLES = 300  # draws a row, as in the study
RESAMPLED = f"""
  WITH i AS (SELECT code, date, ws, air_temp, row_number() OVER (PARTITION BY code ORDER BY date) AS rn,
                    count(*) OVER (PARTITION BY code) AS n FROM ({MODEL_INPUT})),
  d AS (SELECT code, date, sample, 1 + floor({uniform_sql("code", "epoch_us(date)", "'resample'", "sample", "0")} * n)::BIGINT AS rn
        FROM i, (SELECT unnest(generate_series(1, {SAMPLES})) AS sample))
  SELECT d.code, d.date, d.sample, i.ws, i.air_temp FROM d JOIN i ON d.code = i.code AND d.rn = i.rn"""


@query(f"""SELECT code, date, count(*) AS n, round(avg(ws), 6) AS ws, round(avg(air_temp), 6) AS air_temp
  FROM ({RESAMPLED}) GROUP BY ALL""")
def normalise_resample(spark, sf):
    rows = model_input(spark, sf).select("code", "date", "ws", "air_temp")
    drawn = M.resample(rows, "code", "date", ["ws", "air_temp"], SAMPLES)
    means = [F.avg(c).alias(c) for c in ("ws", "air_temp")]
    return rounded(drawn.groupBy("code", "date").agg(F.count(F.lit(1)).alias("n"), *means))


PREDICTED = f"""SELECT site, date, value, value_predict,
  CASE WHEN month(date) < 10 THEN 'training' ELSE 'testing' END AS set FROM ({BAU})"""
MODEL_STATS = f"""SELECT site,
    pow(corr(value, value_predict) FILTER (set = 'training'), 2) AS training_rsquared,
    avg(pow(value - value_predict, 2)) FILTER (set = 'training') AS training_mse,
    pow(corr(value, value_predict) FILTER (set = 'testing'), 2) AS testing_rsquared,
    avg(pow(value - value_predict, 2)) FILTER (set = 'testing') AS testing_mse
  FROM ({PREDICTED}) GROUP BY ALL"""


def predicted(spark, sf) -> DataFrame:
    return bau(spark, sf).withColumn("set", F.when(F.month("date") < 10, "training").otherwise("testing"))


@query(f"""SELECT site, count(*) AS n, round(any_value(training_rsquared), 8) AS training_rsquared,
    round(any_value(training_mse), 6) AS training_mse, round(any_value(testing_rsquared), 8) AS testing_rsquared,
    round(any_value(testing_mse), 6) AS testing_mse
  FROM ({PREDICTED}) JOIN ({MODEL_STATS}) USING (site) GROUP BY ALL""")
def model_stats(spark, sf):
    out = M.model_stats(predicted(spark, sf), "site")
    stats = [F.max(c).alias(c) for c in M.STATS]
    per_site = out.groupBy("site").agg(F.count(F.lit(1)).alias("n"), *stats)
    return rounded(per_site, {"training_rsquared": 8, "testing_rsquared": 8})


SITE_STATISTICS = f"""
  SELECT site AS sites, unnest(['rsquared', 'mse', 'rsquared', 'mse']) AS stat,
         unnest(['training', 'training', 'testing', 'testing']) AS "Data",
         unnest([training_rsquared, training_mse, testing_rsquared, testing_mse]) AS value FROM ({MODEL_STATS})"""


@query(f"""SELECT sites, stat, "Data", round(value, 6) AS value
  FROM ({SITE_STATISTICS})""")
def site_statistics(spark, sf):
    return rounded(M.site_statistics(M.model_stats(predicted(spark, sf), "site"), "site"))


@query(f"""SELECT stat, "Data", round(a, 6) AS avg, round(s, 6) AS sd, round(a - s, 6) + 0.0 AS lower_sd,
    round(a + s, 6) AS upper_sd, round(a - 2 * s, 6) + 0.0 AS lower_2_sd, round(a + 2 * s, 6) AS upper_2_sd
  FROM (SELECT stat, "Data", avg(value) AS a, stddev_samp(value) AS s
        FROM ({SITE_STATISTICS}) GROUP BY ALL)""")
def site_stats_bands(spark, sf):
    stats = M.site_statistics(M.model_stats(predicted(spark, sf), "site"), "site")
    return rounded(C.stat_bands(stats, ["stat", "Data"], "value"))


@query(f"""SELECT site, round(sqrt(avg(pow(value - value_predict, 2))), 4) AS rmse,
    round(corr(value, value_predict), 8) AS rsquared FROM ({BAU}) GROUP BY ALL""")
def fit_errors(spark, sf):
    out = bau(spark, sf).groupBy("site").agg(
        rmse("value", "value_predict").alias("rmse"), pearson("value", "value_predict").alias("rsquared")
    )
    return rounded(out, {"rmse": 4, "rsquared": 8})


STUDY_FOREST = M.Forest(n_trees=300, max_depth=12, seed=7)


@query()
def bau_forest(spark, sf):
    return M.run_bau(model_input(spark, sf), "2024-01-01", "2024-01-20", "2024-01-30", STUDY_FOREST, threshold=0.85)


@query()
def counterfactual_peaks(spark, sf):
    """One study end to end: coverage gate, forecast, daily difference, 7-row mean, peaks."""
    model = M.run_bau(model_input(spark, sf), "2024-01-01", "2024-01-20", "2024-01-30", STUDY_FOREST, threshold=0.85)
    days = R.daily_summary_subset(model.withColumnRenamed("code", "site"), "bau", keys="site")
    rows = P.to_series(days, "day", "d7_rollavg_delta_BAU_predict_mean", "site")
    return D.gradient_peaks(rows, "site", "day", "value", 6, 2)


@query()
def normalised_forest(spark, sf):
    return M.run_normalised(
        model_input(spark, sf), "2024-01-01", "2024-01-30", STUDY_FOREST, n_samples=300
    )


# --------------------------------------------------------------------------- perturbation


@query(f"SELECT series, index, round(value + 5 * {uniform_sql('series', 'index', chr(39) + '5.0' + chr(39), '0')}, 8) AS noise FROM ({SIGNAL})")
def add_noise(spark, sf):
    return rounded(N.add_noise(signal(spark, sf), "series", "index", "value", 5).select("series", "index", "noise"), 8)


@query(f"""SELECT series, index, round(value + 5 * sqrt(-2 * ln(1 - {uniform_sql("series", "index", "0", "'radius'")}))
  * cos(2 * pi() * {uniform_sql("series", "index", "0", "'angle'")}), 8) AS noise FROM ({SIGNAL})""")
def white_noise(spark, sf):
    return rounded(N.add_white_noise(signal(spark, sf), "series", "index", "value", 5).select("series", "index", "noise"), 8)


@query(f"""
  WITH v AS (SELECT * FROM ({SIGNAL})),
  z AS (SELECT series, max(value) - min(value) AS z, pow(10.0, 3 - floor(log10(max(value) - min(value)))) AS p FROM v GROUP BY 1),
  k AS (SELECT DISTINCT series, p, round_even(value * p, 0) AS k FROM v JOIN z USING (series)),
  g AS (SELECT series, min(gap) / any_value(p) AS gap FROM (
          SELECT series, p, k - lag(k) OVER (PARTITION BY series ORDER BY k) AS gap FROM k) GROUP BY 1)
  SELECT series, index, round(value + 0.01 / 5 * gap * (2 * {uniform_sql("series", "index", "'jitter'", "0")} - 1), 10) AS jittered
  FROM v JOIN g USING (series)""")
def jitter(spark, sf):
    out = N.jitter(signal(spark, sf), "series", "index", "value", 0.01)
    return rounded(out.select("series", "index", "jittered"), 10)


@query(f"""
  WITH v AS (SELECT *, substr(md5(series || '|' || index || '|permute|0'), 1, 8) AS h FROM ({SIGNAL}))
  SELECT a.series, a.index, b.value AS sample FROM v a
  JOIN (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY h, index) AS place FROM v) b
  ON a.series = b.series AND a.index = b.place""")
def permute_series(spark, sf):
    return N.permute(signal(spark, sf), "series", "index", "value").select("series", "index", "sample")
