"""Splitting a battery's power between frequency response and spot trading, block by block.

Everything here is relational and runs for any number of scenarios at once: prices are bridged
to EFA blocks, ranked inside them, and averaged at both ends; no day is looped over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.constants import BLOCK_HOURS, SERVICES
from .clean import date_range, drop_extra_periods, of_provider, of_services


@dataclass(frozen=True)
class Battery:
    power_mw: float = 50.0
    duration_h: float = 2.0
    efficiency: float = 0.90
    wear: float = 3.0
    availability: float = 0.95
    initial_soc: float = 0.5

    @property
    def energy_mwh(self) -> float:
        return self.power_mw * self.duration_h


def scenarios(spark: SparkSession, batteries: dict[str, Battery]) -> DataFrame:
    rows = [(k, b.power_mw, b.duration_h, b.efficiency, b.wear, b.availability, b.initial_soc) for k, b in batteries.items()]
    return spark.createDataFrame(rows, "scenario string, power_mw double, duration_h double, efficiency double, wear double, availability double, initial_soc double")


def spot_prices(market_index: DataFrame, start=None, end=None) -> DataFrame:
    """day, sp, price of the reference provider, without missing prices or extra periods."""
    p = drop_extra_periods(of_provider(market_index)).where("price is not null")
    p = date_range(p, "settlement_date", start, end)
    return p.select(F.col("settlement_date").alias("day"), F.col("settlement_period").alias("sp"), "price")


def in_blocks(prices: DataFrame) -> DataFrame:
    """Adds the EFA block of each half-hour: the last two of a day open the next day's first."""
    return prices.withColumns({"efa_date": cal.efa_date_of_period(F.col("day"), F.col("sp")), "efa": cal.efa_of_period(F.col("sp"))})


def block_ends(prices: DataFrame, cells: DataFrame) -> DataFrame:
    """For each scenario and block with at least 2n prices (n half-hours of the duration, one
    at least): the means of the n lowest and the n highest; ties go to the earlier half-hour.
    The two ranks share one shuffle with the means."""
    b = in_blocks(prices)
    w = lambda *o: Window.partitionBy("efa_date", "efa").orderBy(*o)
    b = b.withColumns({"low": F.row_number().over(w("price", "day", "sp")), "high": F.row_number().over(w(F.desc("price"), "day", "sp")), "n_prices": F.count("*").over(Window.partitionBy("efa_date", "efa"))})
    n = F.greatest(F.lit(1), F.floor(F.col("duration_h") * 2).cast("int"))
    b = b.join(F.broadcast(cells.select("duration_h").distinct().withColumn("n", n)), F.col("n_prices") >= 2 * F.col("n"))  # a few durations
    ends = b.groupBy("duration_h", "efa_date", "efa").agg(F.avg(F.when(F.col("low") <= F.col("n"), F.col("price"))).alias("buy"), F.avg(F.when(F.col("high") <= F.col("n"), F.col("price"))).alias("sell"))
    return ends.join(F.broadcast(cells), "duration_h")


def response_value(auctions: DataFrame, services: list[str] | None = None) -> DataFrame:
    """Income of a MW for each block: all services' prices that are not negative, four hours."""
    a = of_services(auctions, services or SERVICES, 0.0)
    return a.groupBy("efa_date", "efa").agg(F.sum(F.col("price") * BLOCK_HOURS).alias("response"))


def schedule(auctions: DataFrame, prices: DataFrame, cells: DataFrame, services: list[str] | None = None, start=None, end=None) -> DataFrame:
    """scenario, efa_date, efa, fr_mw, arb_mw for every block of the days that have prices:
    power in proportion to what a MW earns either way, all of it to response if neither pays."""
    days = prices.select(F.col("day").alias("efa_date")).distinct()
    blocks = days.select("efa_date", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("efa"))
    grid = blocks.join(F.broadcast(cells))  # scenarios, not rows
    ends = block_ends(prices, cells).select("scenario", "efa_date", "efa", "buy", "sell")
    value = response_value(date_range(auctions, "efa_date", start, end), services)
    out = grid.join(ends, ["scenario", "efa_date", "efa"], "left").join(value, ["efa_date", "efa"], "left")
    trade = F.greatest(F.lit(0.0), (F.col("sell") - F.col("buy") / F.col("efficiency") - F.col("wear")) * F.col("duration_h"))
    out = out.withColumns({"trade": F.when(F.col("sell").isNull(), 0.0).otherwise(trade), "response": F.coalesce("response", F.lit(0.0))})
    both = F.col("response") + F.col("trade")
    out = out.withColumn("fr_mw", F.when(both > 0, F.col("power_mw") * F.col("response") / F.when(both > 0, both)).otherwise(F.col("power_mw")))
    return out.withColumn("arb_mw", F.greatest(F.col("power_mw") - F.col("fr_mw"), F.lit(0.0))).select("scenario", "efa_date", "efa", "response", "trade", "fr_mw", "arb_mw")


def fixed_schedule(prices: DataFrame, cells: DataFrame, fr_mw: float) -> DataFrame:
    """A constant split, within 0 and the power."""
    days = prices.select(F.col("day").alias("efa_date")).distinct()
    grid = days.select("efa_date", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("efa")).join(F.broadcast(cells))
    mw = F.least(F.greatest(F.lit(float(fr_mw)), F.lit(0.0)), F.col("power_mw"))
    return grid.select("scenario", "efa_date", "efa", F.lit(0.0).alias("response"), F.lit(0.0).alias("trade"), mw.alias("fr_mw"), (F.col("power_mw") - mw).alias("arb_mw"))


def response_revenue(auctions: DataFrame, plan: DataFrame | None, cells: DataFrame, services: list[str] | None = None, start=None, end=None, min_price: float = 0.0) -> DataFrame:
    """scenario, month, service, revenue_gbp. A block that the plan lacks earns at full power. A
    plan without blocks (scenario, efa_date, fr_mw) holds for all of a day's."""
    a = date_range(of_services(auctions, services, min_price), "efa_date", start, end)
    rows = a.join(F.broadcast(cells.select("scenario", "power_mw")))  # scenarios, not rows
    if plan is None:
        rows = rows.withColumn("mw", F.col("power_mw"))
    else:
        keys = [c for c in ("scenario", "efa_date", "efa") if c in plan.columns]
        rows = rows.join(plan.select(*keys, "fr_mw"), keys, "left").withColumn("mw", F.coalesce("fr_mw", "power_mw"))
    return rows.groupBy("scenario", cal.month(F.col("efa_date")).alias("month"), "service").agg(F.sum(F.col("price") * F.col("mw") * BLOCK_HOURS).alias("revenue_gbp"))


def period_power(prices: DataFrame, plan: DataFrame) -> DataFrame:
    """scenario, day, sp, price, arb_mw: the plan's blocks on half-hours; none gives no power."""
    scenarios_ = plan.select("scenario").distinct()
    b = in_blocks(prices).join(F.broadcast(scenarios_))
    return b.join(plan.select("scenario", "efa_date", "efa", "arb_mw"), ["scenario", "efa_date", "efa"], "left").select("scenario", "day", "sp", "price", F.coalesce("arb_mw", F.lit(0.0)).alias("arb_mw"))
