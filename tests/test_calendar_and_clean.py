import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltlake.functions import calendar as cal
from voltlake.functions import numbers as nu
from voltlake.operators import clean


def test_half_hours_to_blocks(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), sp) for sp in (47, 1, 6, 7, 46)], "d date, sp int")
    got = [(r.ed, r.e) for r in rows.select(cal.efa_date_of_period(F.col("d"), F.col("sp")).alias("ed"), cal.efa_of_period(F.col("sp")).alias("e")).collect()]
    assert got == [(dt.date(2024, 1, 2), 1), (dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 1), 6)]


def test_times_to_blocks(spark):
    times = ["2024-01-01 23:30:00", "2024-01-01 02:59:00", "2024-01-01 03:00:00", "2024-01-01 22:59:00"]
    t = F.to_timestamp("t")
    rows = spark.createDataFrame([(x,) for x in times], "t string").select(cal.efa_of_time(t).alias("e"), F.dayofmonth(cal.efa_date_of_time(t)).alias("d"), cal.period_of(t).alias("p"), cal.period_from_23(t).alias("q"))
    assert [tuple(r) for r in rows.collect()] == [(1, 2, 48, 2), (1, 1, 6, 8), (2, 1, 7, 9), (6, 1, 46, 48)]


def test_numbers(spark):
    r = spark.sql("select 'abc' a, ' 1.5' b, 'NaN' c, 0.0D z, -(exp(1) - 1) e").select(nu.number("a"), nu.number("b"), nu.number("c"), nu.ratio(F.lit(1.0), F.col("z")), F.round(nu.signed_log(F.col("e")), 9), F.round(nu.signed_exp(nu.signed_log(F.col("e"))) - F.col("e"), 9)).first()
    assert tuple(r) == (None, 1.5, None, None, -1.0, 0.0)


def test_dates(spark):
    d = spark.createDataFrame([("01/02/2024",), ("2024-02-01",), ("x",), (None,)], "d string")
    assert [r[0] for r in d.select(cal.parse_day("d")).collect()] == [dt.date(2024, 2, 1), dt.date(2024, 2, 1), None, None]
    with pytest.raises(Exception, match="no date"):
        d.select(cal.strict_day("d")).collect()


def test_first_wins_takes_the_first_source(spark):
    df = spark.createDataFrame([("DCH", 1, 5.0, 1), ("DCH", 1, 7.0, 0), (None, 1, 1.0, 0)], "service string, efa int, price double, source_rank int")
    assert {(r.service, r.price) for r in clean.first_wins(df, ["service", "efa"], ["source_rank"]).collect()} == {("DCH", 7.0), (None, 1.0)}


def test_volume_weighted_blocks(spark):
    t = "2024-01-01T03:{:02}:00"
    rows = [("A", t.format(0), "1", "10"), ("A", t.format(30), "3", "20"), ("B", t.format(0), "0", "5"), ("C", t.format(0), "2", None), ("C", t.format(30), "2", "10"), (None, t.format(0), "1", "1")]
    df = spark.createDataFrame(rows, "auctionProduct string, deliveryStart string, clearedVolume string, clearingPrice string")
    got = {r.service: (r.volume, r.price, r.efa) for r in clean.block_auctions(df).collect()}
    assert got == {"A": (2.0, 17.5, 2), "B": (0.0, None, 2), "C": (2.0, 5.0, 2)}


def test_nan_is_not_a_price(spark):
    df = spark.createDataFrame([("DCH", float("nan")), ("DCH", -1.0), ("DCH", 0.0), ("DCH", None), (None, 2.0)], "service string, price double")
    assert clean.of_services(df, None, 0.0).count() == 1
    assert clean.of_services(nu.clean_doubles(df), None, 0.0).count() == 1


def test_projects(spark):
    rows = [(" Battery ", 5.0, "Operational", dt.date(2020, 1, 1)), ("battery", 0.0, "Operational", dt.date(2020, 1, 1)), ("Battery", 5.0, "Planned", dt.date(2020, 1, 1)), ("Battery", 5.0, "Now operational", None), ("BESS thing", 1.0, None, None)]
    df = spark.createDataFrame(rows, "technology_type string, installed_capacity_mw double, development_status string, operational_date date")
    assert clean.battery_projects(df).count() == 1
    assert sorted(map(tuple, clean.project_audit(df).collect())) == [("no date", "1"), ("unknown technology", "BESS thing")]
    with pytest.raises(ValueError, match="missing"):
        clean.battery_projects(df.drop("development_status"))
    assert clean.fuel_group(F.lit("CCGT")) is not None
    assert [r[0] for r in spark.createDataFrame([("CCGT",), ("XX",), (None,)], "f string").select(clean.fuel_group(F.col("f"))).collect()] == ["Gas", "Other", "Other"]
