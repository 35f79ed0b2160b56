"""Readers on small files written by the tests."""

import pytest
from pyspark.sql import functions as F

from bendpoint.plans.daily import compliance_series
from bendpoint.sources import readers as S

# The header line of the compliance format (fixed value).
HEADER = (
    "Date of Travel,Unique VRMs Captured in Charging Hours,Unique VRMs Compliant with ULEZ,"
    "Unique VRMs Non-Compliant with ULEZ,Total Valid ULEZ Charges,Total ULEZ PCs Raised,Total Exempt/100% Discount"
)


def test_compliance_file(spark, tmp_path):
    lines = [HEADER]
    for day in range(1, 11):
        counts = '"100,000","{0},000","{1},000"'.format(70 + day, 30 - day)
        if day == 10:
            counts = ",".join([S.NOT_COUNTED] * 3)
        lines.append(f'Mon {day:02d}/04/2019,{counts},"1","2","3"')
    path = tmp_path / "compliance.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = S.read_compliance(spark, str(path)).orderBy("date").collect()
    assert len(rows) == 9
    assert str(rows[0]["date"]) == "2019-04-01"
    assert rows[0]["total_vehicle_number"] == 100000.0
    assert rows[0]["compliant_percentage"] == pytest.approx(71.0)
    rolled = [r["d7_rollavg_compliant_percentage"] for r in rows]
    assert rolled[:6] == [None] * 6 and rolled[6:] == pytest.approx([74.0, 75.0, 76.0])
    assert compliance_series(S.read_compliance(spark, str(path))).count() == 3


def test_weather_files(spark, tmp_path):
    (tmp_path / "m1.csv").write_text(
        "code,date,ws,wd,air_temp,atmos_pres,RH,cl\nM1,2016-01-01 00:00:00,1,350,4,1000,80,2\n"
        "M1,2015-12-31 23:00:00,1,350,4,1000,80,2\nM1,2016-01-02 00:00:00,NA,350,4,NaN,80,2\n"
    )
    (tmp_path / "m2.csv").write_text("code,date,ws,wd,air_temp,atmos_pres,RH,cl\nM2,2016-01-01 05:00:00,2,90,3,1001,70,1\n")
    df = S.read_weather(spark, str(tmp_path / "*.csv"), "2016-01-01", "2016-01-02")
    rows = {(r["met_code"], str(r["date"])): r for r in df.collect()}
    assert set(rows) == {
        ("M1", "2016-01-01 00:00:00"),
        ("M1", "2016-01-02 00:00:00"),
        ("M2", "2016-01-01 05:00:00"),
    }
    assert rows["M1", "2016-01-02 00:00:00"]["ws"] is None
    assert rows["M1", "2016-01-02 00:00:00"]["atmos_pres"] is None
    assert rows["M2", "2016-01-01 05:00:00"]["ws"] == 2.0
    (tmp_path / "m3.csv").write_text("date,code,wd,ws,air_temp,atmos_pres,RH,cl\n2016-01-01 05:00:00,M2,90,2,3,1001,70,1\n")
    with pytest.raises(Exception):
        S.read_weather(spark, str(tmp_path / "*.csv")).collect()


def test_readings_prune_years(spark, tmp_path):
    df = spark.createDataFrame(
        [("A", "2016-05-01"), ("A", "2018-05-01"), ("B", "2017-05-01")], "code string, d string"
    ).select("code", F.to_timestamp("d").alias("date"), F.lit(1.0).alias("no2"))
    path = str(tmp_path / "readings")
    S.write_readings(df, path)
    out = S.read_readings(spark, path, ["A"], "2016-06-01", "2017-01-01")
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "year" in filters and "code" in filters
    assert S.read_readings(spark, path, None, "2016-06-01", "2018-01-01").count() == 3


@pytest.mark.parametrize("split", [None, "64"])
def test_signal_keeps_line_order(spark, tmp_path, split):
    path = tmp_path / "signal.txt"
    path.write_text("\n".join(f"{i / 8:.18e}" for i in range(200)) + "\n")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = S.read_signal(spark, str(path)).orderBy("index").collect()
        assert [r["index"] for r in rows] == list(range(1, 201))
        assert [r["value"] for r in rows] == [i / 8 for i in range(200)]
        lost = S.read_signal(spark, str(path), drop_first=True).orderBy("index").collect()
        assert (lost[0]["index"], lost[0]["value"], len(lost)) == (1, 1 / 8, 199)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_site_map_and_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("A", "M", "Roadside"), ("B", None, "Roadside"), ("C", "M", "Rural")],
        "code string, met_code string, site_type string",
    )
    S.write_parquet(df, str(tmp_path / "map"))
    assert [r["code"] for r in S.read_site_map(spark, str(tmp_path / "map"), ["Roadside"]).collect()] == ["A"]
    S.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
