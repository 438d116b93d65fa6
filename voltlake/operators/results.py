"""Back-test results: the monthly table, its summary, and what the user's filters make of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SERVICES, WEAR_STEPS
from ..functions.numbers import ratio, total
from .clean import month_range

REVENUES = [f"{s}_rev" for s in SERVICES] + ["imbalance_revenue_gbp"]


def monthly_table(response: DataFrame, trading: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each scenario and month of either stream; what one lacks is 0. Availability
    scales revenues, wear and throughput."""
    wide = response.groupBy("scenario", "month").pivot("service", SERVICES).agg(F.sum("revenue_gbp")).withColumnsRenamed({s: f"{s}_rev" for s in SERVICES})
    out = wide.join(trading, ["scenario", "month"], "full_outer").join(F.broadcast(cells.select("scenario", "availability")), "scenario")
    scaled = {c: F.coalesce(F.col(c), F.lit(0.0)) * F.col("availability") for c in [*REVENUES, "cycling_cost_gbp"]}
    out = out.withColumns(scaled | {"mwh_cycled": F.col("mwh_cycled") * F.col("availability")})
    return with_totals(out).drop("availability")


def with_totals(df: DataFrame) -> DataFrame:
    out = df.withColumns({"gross_revenue": total([c for c in REVENUES if c in df.columns]), "cycling_cost": F.col("cycling_cost_gbp")})
    return out.withColumn("net_revenue", F.col("gross_revenue") - F.col("cycling_cost"))


def summary(monthly: DataFrame, cells: DataFrame, positive_only: bool = False) -> DataFrame:
    """Totals of each scenario over its months, a year being twelve of them however full."""
    rev = [c for c in REVENUES if c in monthly.columns]
    label = lambda c: F.lit("Arbitrage" if c == "imbalance_revenue_gbp" else c.removesuffix("_rev"))
    s = monthly.groupBy("scenario").agg(
        F.sum("gross_revenue").alias("total_gross"), F.sum("cycling_cost").alias("total_cycling_cost"), F.sum("net_revenue").alias("total_net"),
        (F.count("*") / 12).alias("years_covered"), F.sum("mwh_cycled").alias("total_mwh_cycled"), *(F.sum(c).alias(c) for c in rev))
    s = s.join(F.broadcast(cells.select("scenario", "power_mw")), "scenario")
    breakdown = F.create_map(*(x for c in rev for x in (label(c), F.col(c))))
    s = s.withColumn("breakdown", F.map_filter(breakdown, lambda _, v: v > 0) if positive_only else breakdown)
    best = F.get(F.array_sort(F.transform(F.map_entries("breakdown"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), F.lit(0))["k"]
    s = s.withColumns({"annualised_net": ratio(F.col("total_net"), F.col("years_covered")), "top_service": F.coalesce(best, F.lit("N/A"))})
    s = s.withColumn("annualised_per_mw", F.coalesce(ratio(F.col("annualised_net"), F.col("power_mw")), F.lit(0.0)))
    return s.select("scenario", "total_gross", "total_cycling_cost", "total_net", "years_covered", "annualised_net", "annualised_per_mw", "top_service", "total_mwh_cycled", "breakdown")


def rounded(s: DataFrame) -> DataFrame:
    """Half-even, as published: whole pounds, years to two places, throughput to one."""
    pounds = ("total_gross", "total_cycling_cost", "total_net", "annualised_net", "annualised_per_mw")
    return s.withColumns({c: F.bround(c, 0) for c in pounds} | {"years_covered": F.bround("years_covered", 2), "total_mwh_cycled": F.bround("total_mwh_cycled", 1), "breakdown": F.transform_values("breakdown", lambda _, v: F.bround(v, 0))})


def with_mean_power(s: DataFrame, plan: DataFrame) -> DataFrame:
    return s.join(plan.groupBy("scenario").agg(F.avg("fr_mw").alias("fr_mw"), F.avg("arb_mw").alias("arb_mw")), "scenario", "left")


def filtered(monthly: DataFrame, start=None, end=None, services: list[str] | None = None, power_mw: float = 50.0, arbitrage: bool = True, base_mw: float = 50.0) -> DataFrame:
    """A user's view: whole months of a range, services left out as 0, revenues and wear scaled
    to another power. Totals and throughput are not rescaled; they are as computed before."""
    out = month_range(monthly, "month", start, end)
    gone = [f"{s}_rev" for s in SERVICES if services is not None and s not in services]
    out = out.withColumns({c: F.lit(0.0) for c in gone if c in out.columns})
    if not arbitrage:
        out = out.withColumns({c: F.lit(0.0) for c in ("imbalance_revenue_gbp", "cycling_cost_gbp")})
    scale = power_mw / base_mw
    return out.withColumns({c: F.col(c) * scale for c in [*REVENUES, "cycling_cost_gbp"] if c in out.columns})


def long(monthly: DataFrame) -> DataFrame:
    """scenario, month, stream, revenue_gbp."""
    return monthly.unpivot(["scenario", "month"], [c for c in REVENUES if c in monthly.columns], "stream", "revenue_gbp")


def cumulative(monthly: DataFrame) -> DataFrame:
    w = Window.partitionBy("scenario", "stream").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return long(monthly).withColumn("cumulative_gbp", F.sum("revenue_gbp").over(w))


def wear_sensitivity(s: DataFrame, power_mw: float = 50.0, base: float = 3.0) -> DataFrame:
    """Net revenue at other wear costs, the trades as they are."""
    steps = F.explode(F.array(*(F.lit(c) for c in WEAR_STEPS))).alias("wear")
    net = F.col("total_gross") - F.col("total_cycling_cost") / base * F.col("wear")
    return s.select("scenario", "total_gross", "total_cycling_cost", "years_covered", steps).select("scenario", "wear", net.alias("net"), (ratio(net, F.col("years_covered")) / power_mw).alias("net_per_mw_year"))


def service_mix(monthly: DataFrame, cells: DataFrame) -> DataFrame:
    """Summaries of response alone, trading alone, and both."""
    mixes = monthly.sparkSession.createDataFrame([("FR only", True, False), ("Arbitrage only", False, True), ("FR + Arbitrage", True, True)], "mix string, with_fr boolean, with_arb boolean")
    m = monthly.join(F.broadcast(mixes))  # three rows
    keep = lambda c, flag: F.when(F.col(flag), F.col(c)).otherwise(0.0)
    m = m.withColumns({f"{x}_rev": keep(f"{x}_rev", "with_fr") for x in SERVICES} | {c: keep(c, "with_arb") for c in ("imbalance_revenue_gbp", "cycling_cost_gbp")})
    m = with_totals(m.withColumn("scenario", F.concat_ws("|", "scenario", "mix")))
    c = cells.join(F.broadcast(mixes)).withColumn("scenario", F.concat_ws("|", "scenario", "mix"))
    return summary(m, c, positive_only=True)


def revenue_gap(net: dict[str, Column]) -> Column:
    """(model - naive) / (perfect - naive); null where the difference is under a pound."""
    d = net["perfect"] - net["naive"]
    return F.when(F.abs(d) >= 1.0, (net["model"] - net["naive"]) / F.when(F.abs(d) >= 1.0, d))


def compare(strategies: dict[str, DataFrame]) -> DataFrame:
    """The summaries of strategies under one another, and each one's gap."""
    s = reduce(lambda a, b: a.unionByName(b), (x.select(F.lit(k).alias("strategy"), "scenario", "total_net", "total_gross", "total_cycling_cost", "annualised_per_mw") for k, x in strategies.items()))
    nets = s.groupBy("scenario").pivot("strategy", list(strategies)).agg(F.first("total_net"))
    gap = revenue_gap({"model": F.col("total_net"), "naive": F.col("naive"), "perfect": F.col("perfect")})
    return s.join(nets.select("scenario", "naive", "perfect"), "scenario").withColumn("gap", gap).drop("naive", "perfect")


def trading_gap(monthly: dict[str, DataFrame]) -> DataFrame:
    """What each strategy nets from trading alone, income less wear, and its gap."""
    s = reduce(lambda a, b: a.unionByName(b), (m.groupBy("scenario").agg((F.sum("imbalance_revenue_gbp") - F.sum("cycling_cost_gbp")).alias("trading_net")).select(F.lit(k).alias("strategy"), "scenario", "trading_net") for k, m in monthly.items()))
    nets = s.groupBy("scenario").pivot("strategy", list(monthly)).agg(F.first("trading_net"))
    gap = revenue_gap({"model": F.col("trading_net"), "naive": F.col("naive"), "perfect": F.col("perfect")})
    return s.join(nets.select("scenario", "naive", "perfect"), "scenario").withColumn("gap", gap).drop("naive", "perfect")


def ranked_models(table: DataFrame, metric: str, least: bool = True) -> DataFrame:
    """A comparison table with its best rows by a metric marked, ties all of them."""
    best = table.agg((F.min if least else F.max)(metric).alias("_best"))  # one row
    return table.join(F.broadcast(best)).withColumn("best", F.coalesce(F.col(metric) == F.col("_best"), F.lit(False))).drop("_best")


def best_of(table: DataFrame, metric: str, label: str, least: bool = True) -> DataFrame:
    return table.agg((F.min_by if least else F.max_by)(label, metric).alias(label), (F.min if least else F.max)(metric).alias(metric))
