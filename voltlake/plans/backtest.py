"""Back-tests: plans that put allocation, dispatch and results together, for many scenarios."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation as al
from ..operators import dispatch as di
from ..operators import results as re
from ..operators.allocation import Battery
from ..operators.clean import date_range
from ..operators.forecast import naive


@dataclass
class Result:
    monthly: DataFrame
    summary: DataFrame
    plan: DataFrame
    trades: DataFrame
    soc: DataFrame | None


def _result(auctions, plan, trades, cells, services, start, end, with_mwh, soc) -> Result:
    response = al.response_revenue(auctions, plan, cells, services, start, end)
    monthly = re.monthly_table(response, di.monthly(trades, with_mwh), cells)
    return Result(monthly, re.with_mean_power(re.summary(monthly, cells), plan), plan, trades, soc)


def _soc(steps: DataFrame) -> DataFrame:
    return steps.select("scenario", F.col("day").alias("date"), "sp", "soc_frac")


def perfect_foresight(auctions: DataFrame, market_index: DataFrame, cells: DataFrame, services=None, start=None, end=None, fr_mw: float | None = None, method: str = "greedy", horizon: int = 96) -> Result:
    """Allocation and dispatch on actual prices. Allocation sees the prices of the range alone,
    so that the first day's first block has six; greedy dispatch sees all."""
    if method not in ("greedy", "mpc"):
        raise ValueError(f"unknown method {method}")
    all_prices, prices = al.spot_prices(market_index), al.spot_prices(market_index, start, end)
    plan = al.schedule(auctions, prices, cells, services, start, end) if fr_mw is None else al.fixed_schedule(prices, cells, fr_mw)
    plan = plan.persist()  # six rows a day and scenario, read by income, dispatch and summary
    if method == "greedy":
        days = plan.select("efa_date").distinct()
        trades = di.greedy(al.block_ends(all_prices, cells).join(days, "efa_date", "left_semi"), plan, cells)
        return _result(auctions, plan, trades, cells, services, start, end, False, None)
    steps = di.rolling(al.period_power(prices, plan).withColumn("forecast", F.col("price")), cells, horizon)
    return _result(auctions, plan, steps.where("revenue_gbp <> 0 or mwh > 0"), cells, services, start, end, False, _soc(steps))


def forecast_driven(auctions: DataFrame, market_index: DataFrame, cells: DataFrame, strategy: str = "naive", forecast: DataFrame | None = None, services=None, start=None, end=None, method: str = "greedy", horizon: int = 96) -> Result:
    """Allocation and dispatch on a forecast (day, sp, price), settled at actual prices."""
    actual = al.spot_prices(market_index)
    if strategy == "naive":
        forecast = naive(actual)
    elif strategy != "ml" or forecast is None:
        raise ValueError(f"unknown strategy {strategy}, or no forecast")
    forecast = date_range(forecast, "day", start, end).join(actual.select("day").distinct(), "day", "left_semi")
    plan = al.schedule(auctions, forecast, cells, services, start, end).persist()
    if method == "greedy":
        trades = di.greedy(di.forecast_ends(forecast, actual, cells), plan, cells, "discharged")
        return _result(auctions, plan, trades, cells, services, start, end, True, None)
    seen = al.period_power(forecast, plan).withColumnRenamed("price", "forecast")
    periods = seen.join(actual.select("day", "sp", "price"), ["day", "sp"], "left")
    steps = di.rolling(periods, cells, horizon)
    return _result(auctions, plan, steps.where("revenue_gbp <> 0 or mwh > 0"), cells, services, start, end, True, _soc(steps))


def size_sensitivity(auctions: DataFrame, market_index: DataFrame, sizes=(10.0, 25.0, 50.0, 100.0, 200.0), base: Battery | None = None, **options) -> Result:
    """One back-test over several powers: the scenarios run side by side in one job."""
    b = base or Battery()
    cells = al.scenarios(auctions.sparkSession, {f"{s:g} MW": replace(b, power_mw=s) for s in sizes})
    return perfect_foresight(auctions, market_index, cells, **options)


def reference_cells(spark: SparkSession, **changes) -> DataFrame:
    return al.scenarios(spark, {"reference": Battery(**changes)})


def strategies(auctions: DataFrame, market_index: DataFrame, cells: DataFrame, forecast: DataFrame | None = None, **options) -> DataFrame:
    """Perfect foresight, the naive forecast and, if given, a model's, with the revenue gap."""
    runs = {"perfect": perfect_foresight(auctions, market_index, cells, **options), "naive": forecast_driven(auctions, market_index, cells, **options)}
    if forecast is not None:
        runs["ml"] = forecast_driven(auctions, market_index, cells, "ml", forecast, **options)
    return re.compare({k: r.summary for k, r in runs.items()})
