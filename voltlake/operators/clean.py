"""Cleaning: unions, first-wins dedup, filters, half-hours to blocks, wide to long."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.constants import BATTERY_TECHNOLOGIES, FUEL_GROUPS, PROVIDER, SERVICES
from ..functions.numbers import clean_doubles, number, ratio


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, by name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of the rows of each key the first in a total order: sources, files and rows ranked by
    the caller. One shuffle; Spark limits each partition's window to its first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive; either bound may be missing."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def month_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Whole months: from the start's first day to the end's last."""
    if start is not None:
        df = df.where(F.col(column) >= F.trunc(F.lit(start).cast("date"), "MM"))
    if end is not None:
        df = df.where(F.col(column) <= F.last_day(F.lit(end).cast("date")))
    return df


def of_provider(market_index: DataFrame, provider: str = PROVIDER) -> DataFrame:
    return market_index.where(F.col("provider") == provider)


def of_services(auctions: DataFrame, services: list[str] | None = None, min_price: float | None = None) -> DataFrame:
    df = auctions.where(F.col("service").isin(services or SERVICES))
    return df if min_price is None else df.where((F.col("price") >= min_price) & ~F.isnan("price"))


def without_services(auctions: DataFrame, services: list[str]) -> DataFrame:
    """The services that are not listed."""
    return auctions.where(~F.col("service").isin(services))


def drop_extra_periods(df: DataFrame, column: str = "settlement_period") -> DataFrame:
    """Clock-change days have periods 49 and 50."""
    return df.where(F.col(column) <= 48)


def fuel_group(fuel: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in FUEL_GROUPS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, fuel), F.lit("Other"))


def daily_generation(half_hourly: DataFrame) -> DataFrame:
    """settlement_date, fuel_group, generation; rows without a date are left out."""
    rows = half_hourly.where("settlement_date is not null")
    return rows.groupBy("settlement_date", fuel_group(F.col("fuel_type")).alias("fuel_group")).agg(F.sum("generation").alias("generation"))


def block_auctions(eac: DataFrame) -> DataFrame:
    """Half-hourly auction rows to EFA blocks: mean volume and volume-weighted price. A missing
    price leaves the weighted sum but not the volume; no volume gives no price."""
    ts = F.to_timestamp_ntz("deliveryStart")
    rows = eac.withColumns({"v": number("clearedVolume"), "p": number("clearingPrice"), "service": F.col("auctionProduct"), "efa_date": cal.efa_date_of_time(ts), "efa": cal.efa_of_time(ts)})
    out = rows.where("service is not null and efa_date is not null").groupBy("service", "efa_date", "efa").agg(
        F.min("deliveryStart").alias("delivery_start"), F.max("deliveryStart").alias("delivery_end"),
        F.avg("v").alias("volume"), ratio(F.coalesce(F.sum(F.col("p") * F.col("v")), F.lit(0.0)), F.coalesce(F.sum("v"), F.lit(0.0))).alias("price"),
    )
    return out.select("service", "efa_date", "efa", F.to_timestamp_ntz("delivery_start").alias("delivery_start"), F.to_timestamp_ntz("delivery_end").alias("delivery_end"), "volume", "price")


def embedded_generation(demand: DataFrame) -> DataFrame:
    """Wide solar and wind columns to long rows; headers in any case and spacing."""
    d = demand.toDF(*(c.strip().upper() for c in demand.columns))
    long = d.unpivot(["SETTLEMENT_DATE", "SETTLEMENT_PERIOD"], ["EMBEDDED_SOLAR_GENERATION", "EMBEDDED_WIND_GENERATION"], "kind", "value")
    return long.select(
        cal.parse_day("SETTLEMENT_DATE").alias("settlement_date"), F.col("SETTLEMENT_PERIOD").cast("int").alias("settlement_period"),
        number("value").alias("generation"), F.when(F.col("kind") == "EMBEDDED_SOLAR_GENERATION", "SOLAR").otherwise("EMBEDDED_WIND").alias("fuel_type"),
    )


def battery_projects(raw: DataFrame, technologies: list[str] | None = None) -> DataFrame:
    """Operational battery projects with a capacity and a date."""
    need = {"technology_type", "installed_capacity_mw", "development_status", "operational_date"}
    if need - set(raw.columns):
        raise ValueError(f"missing columns: {sorted(need - set(raw.columns))}")
    return raw.where(
        F.lower(F.trim("technology_type")).isin(technologies or BATTERY_TECHNOLOGIES)
        & F.contains(F.lower("development_status"), F.lit("operational"))
        & (F.col("installed_capacity_mw") > 0) & F.col("operational_date").isNotNull()
    ).select("technology_type", "installed_capacity_mw", "development_status", "operational_date")


def project_audit(raw: DataFrame, technologies: list[str] | None = None) -> DataFrame:
    """What the project filter may have missed: battery-like technologies that it does not
    know (the first ten), and how many projects lack a date."""
    known = F.lower(F.trim("technology_type")).isin(technologies or BATTERY_TECHNOLOGIES)
    odd = raw.where(~known & F.lower("technology_type").rlike("battery|storage|bess")).select(F.lit("unknown technology").alias("finding"), F.col("technology_type").alias("what")).distinct().orderBy("what").limit(10)
    late = raw.where(known & F.contains(F.lower("development_status"), F.lit("operational")) & (F.col("installed_capacity_mw") > 0) & F.col("operational_date").isNull())
    return odd.unionAll(late.agg(F.lit("no date").alias("finding"), F.count("*").cast("string").alias("what")))


def prepared(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The common preparation of a table: NaN to null, first row of each key."""
    return first_wins(clean_doubles(df), keys, order)
