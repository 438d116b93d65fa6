"""Market overview: the data behind each chart, as one DataFrame function each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.constants import MARKETS
from ..functions.numbers import correlation as pearson
from ..functions.ranks import percentile_columns, percentiles, ranked


def clearing_trend(auctions: DataFrame, days: int = 28) -> DataFrame:
    """Daily mean price of each service and its trailing mean over calendar days."""
    daily = auctions.where("service is not null").groupBy("service", "efa_date").agg(F.avg("price").alias("daily_price"))
    w = Window.partitionBy("service").orderBy(F.datediff("efa_date", F.lit("1970-01-01").cast("date"))).rangeBetween(1 - days, 0)
    return daily.withColumn("trend", F.avg("daily_price").over(w))


def service_summary(auctions: DataFrame) -> DataFrame:
    rows = auctions.where("service is not null")
    plain = rows.groupBy("service").agg(F.avg("price").alias("mean_price"), F.max("price").alias("max_price"), F.avg("volume").alias("mean_volume"), F.count("price").alias("n"))
    middle = percentiles(rows, ["service"], "price", {"median_price": 0.5})
    return _beside(plain, middle, ["service"]).select("service", "mean_price", "median_price", "max_price", "mean_volume", "n")


def _beside(plain: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """A row a group on either side, joined also where a key is null."""
    more = more.withColumnsRenamed({k: f"_{k}" for k in keys})
    return plain.join(F.broadcast(more), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))


def service_order(auctions: DataFrame) -> DataFrame:
    """Services by falling mean price."""
    return auctions.where("service is not null").groupBy("service").agg(F.avg("price").alias("mean_price")).orderBy(F.desc("mean_price"), "service")


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, quartiles and greatest value of each group."""
    out = ranked(df, keys, value).groupBy(*keys).agg(F.min(value).alias("low"), *percentile_columns(value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}), F.max(value).alias("high"))
    return _beside(df.select(*keys).distinct(), out, keys)


def spreads(auctions: DataFrame) -> DataFrame:
    """market, efa_date, efa, h, l, spread where both sides cleared: an inner join of the
    high and low service of each market on their block."""
    side = {s: m for m, (h, l) in MARKETS.items() for s in (h, l)}
    market = F.create_map(*(F.lit(x) for kv in side.items() for x in kv))
    rows = auctions.where(F.col("service").isin(list(side))).withColumn("market", market[F.col("service")])
    high = rows.where(F.col("service").isin([h for h, _ in MARKETS.values()])).select("market", "efa_date", "efa", F.col("price").alias("h"))
    low = rows.where(F.col("service").isin([l for _, l in MARKETS.values()])).select("market", "efa_date", "efa", F.col("price").alias("l"))
    return high.join(low, ["market", "efa_date", "efa"]).withColumn("spread", F.col("h") - F.col("l"))


def spread_daily(s: DataFrame) -> DataFrame:
    return s.groupBy("efa_date", "market").agg(F.avg("spread").alias("mean_spread"))


def spread_by_block(s: DataFrame) -> DataFrame:
    return s.groupBy("efa", "market").agg(F.avg("spread").alias("mean_spread"))


def spread_heat_map(s: DataFrame, market: str) -> DataFrame:
    """Month by block, the blocks as columns efa_1 to efa_6."""
    out = s.where(F.col("market") == market).groupBy(F.date_format("efa_date", "yyyy-MM").alias("month")).pivot("efa", [1, 2, 3, 4, 5, 6]).agg(F.avg("spread"))
    return out.withColumnsRenamed({str(i): f"efa_{i}" for i in range(1, 7)})


def spread_summary(s: DataFrame) -> DataFrame:
    """A missing spread counts as not positive."""
    plain = s.groupBy("market").agg(
        F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("std"), F.min("spread").alias("min"), F.max("spread").alias("max"),
        (F.avg(F.when(F.col("spread") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_positive"))
    middle = percentiles(s, ["market"], "spread", {"median": 0.5})
    return _beside(plain, middle, ["market"]).select("market", "mean", "median", "std", "min", "max", "pct_positive")


def system_daily(prices: DataFrame) -> DataFrame:
    return prices.groupBy("settlement_date").agg(F.avg("sell_price").alias("sell"), F.avg("buy_price").alias("buy"))


def price_against_service(prices: DataFrame, auctions: DataFrame, service: str = "DCH") -> DataFrame:
    """day, sell price and the service's price, daily means, where there are both."""
    a = prices.groupBy(F.col("settlement_date").alias("day")).agg(F.avg("sell_price").alias("sell"))
    b = auctions.where(F.col("service") == service).groupBy(F.col("efa_date").alias("day")).agg(F.avg("price").alias("service_price"))
    return a.join(b, "day")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(pearson(a, b).alias("corr"), F.count("*").alias("n"))


def dense_generation(generation: DataFrame) -> DataFrame:
    """Every fuel on every day that has any; what is missing is 0."""
    g = generation.where("settlement_date is not null and fuel_group is not null").groupBy("settlement_date", "fuel_group").agg(F.avg("generation").alias("generation"))
    days, fuels = g.select("settlement_date").distinct(), g.select("fuel_group").distinct()
    fuels = fuels.agg(F.sort_array(F.collect_set("fuel_group")).alias("fuels"))  # the groups of a code list
    grid = days.join(F.broadcast(fuels)).select("settlement_date", F.explode("fuels").alias("fuel_group"))
    return grid.join(g, ["settlement_date", "fuel_group"], "left").na.fill({"generation": 0.0})


def generation_trend(generation: DataFrame, rows: int = 14, least: int = 7) -> DataFrame:
    w = Window.partitionBy("fuel_group").orderBy("settlement_date").rowsBetween(1 - rows, 0)
    return dense_generation(generation).withColumn("trend", F.when(F.count("generation").over(w) >= least, F.avg("generation").over(w)))


def fuel_share(generation: DataFrame) -> DataFrame:
    """Mean daily generation of each fuel and its share, the positive ones."""
    g = dense_generation(generation).groupBy("fuel_group").agg(F.avg("generation").alias("mean_generation")).where("mean_generation > 0")
    return g.withColumn("share", F.col("mean_generation") / F.sum("mean_generation").over(Window.partitionBy(F.lit(1))))  # a row a fuel


def fuel_buckets(generation: DataFrame) -> DataFrame:
    fuel = F.upper("fuel_group")
    bucket = F.when(fuel.isin("WIND", "HYDRO", "BIOMASS", "SOLAR"), "Renewables").when(fuel.isin("GAS", "COAL", "OIL"), "Fossil Fuels").otherwise("Other")
    return fuel_share(generation).groupBy(bucket.alias("bucket")).agg(F.sum("mean_generation").alias("mean_generation"))


def date_bounds(auctions: DataFrame, market_index: DataFrame) -> DataFrame:
    """First and last day of both tables, and of their overlap."""
    a = auctions.agg(F.min("efa_date").alias("auction_from"), F.max("efa_date").alias("auction_to"), F.count("*").alias("auction_rows"))
    m = market_index.agg(F.min("settlement_date").alias("price_from"), F.max("settlement_date").alias("price_to"), F.count("*").alias("price_rows"))
    return a.join(F.broadcast(m)).withColumns({"start": F.greatest("auction_from", "price_from"), "end": F.least("auction_to", "price_to")})  # one row each


def soc_profile(soc: DataFrame) -> DataFrame:
    """Mean and spread of the state of charge by half-hour of the week, the band within 0 and 1."""
    p = soc.groupBy(cal.slot_of_week(F.col("date"), F.col("sp")).alias("slot")).agg(F.avg("soc_frac").alias("mean"), F.stddev_samp("soc_frac").alias("std"))
    return p.withColumns({"low": F.greatest(F.col("mean") - F.col("std"), F.lit(0.0)), "high": F.least(F.col("mean") + F.col("std"), F.lit(1.0))})
