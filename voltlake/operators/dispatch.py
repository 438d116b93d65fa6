"""Dispatch: the state of charge is a recurrence over time, so one group is one scenario's
ordered blocks or half-hours (bounded by the years simulated); scenarios run in parallel. All
inputs of the recurrence are computed relationally before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.constants import SOC_LOWER, SOC_UPPER
from ..session import ship
from .allocation import block_ends, in_blocks
from .lp import solve

TRADES = "scenario string, day date, efa int, revenue_gbp double, wear_gbp double, mwh double, soc double"
STEPS = "scenario string, day date, sp int, revenue_gbp double, wear_gbp double, mwh double, soc_frac double"


def _greedy(soc_rule: str):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["efa_date", "efa"])
        first = b.iloc[0]
        energy = first.power_mw * first.duration_h
        soc, rows = first.initial_soc * energy, []
        for r in b.itertuples():
            out = min(r.arb_mw * r.duration_h, max(0.0, soc - SOC_LOWER * energy))
            into = min(out / r.efficiency, max(0.0, SOC_UPPER * energy - soc))
            if out <= 0 or into <= 0:
                continue
            profit, wear = r.sell * out - r.buy * into, r.wear * out
            if profit > wear:
                gained = into * r.efficiency if soc_rule == "charged" else out / r.efficiency
                soc = min(max(soc - out + gained, 0.0), energy)
                rows.append((r.scenario, r.efa_date, r.efa, profit, wear, out, soc))
        return pd.DataFrame(rows, columns=["scenario", "day", "efa", "revenue_gbp", "wear_gbp", "mwh", "soc"])

    return run


def greedy(ends: DataFrame, plan: DataFrame, cells: DataFrame, soc_rule: str = "charged") -> DataFrame:
    """Block trades. ends: scenario, efa_date, efa, buy, sell. soc_rule: "charged" adds what was
    charged at the efficiency; "discharged" adds what was discharged over the efficiency, as the
    forecast-driven variant does."""
    if soc_rule not in ("charged", "discharged"):
        raise ValueError(f"unknown soc_rule {soc_rule}")
    use = ends.select("scenario", "efa_date", "efa", "buy", "sell").where("buy is not null and sell is not null")
    rows = use.join(plan.where("arb_mw > 0").select("scenario", "efa_date", "efa", "arb_mw"), ["scenario", "efa_date", "efa"])
    rows = rows.join(F.broadcast(cells), "scenario")
    ship(rows.sparkSession)
    return rows.groupBy("scenario").applyInPandas(_greedy(soc_rule), TRADES)


def forecast_ends(forecast: DataFrame, actual: DataFrame, cells: DataFrame, bridge_first_block: bool = False) -> DataFrame:
    """Blocks ranked by forecast and settled at actual prices. As in the reference behaviour a
    day's first block sees the forecast of its own day alone, six half-hours; with
    bridge_first_block it sees all eight. A block with under 2n actual prices is left out."""
    f = in_blocks(forecast.select("day", "sp", F.col("price").alias("forecast")))
    if not bridge_first_block:
        f = f.where(F.col("efa_date") == F.col("day"))
    a = in_blocks(actual)
    counts = a.groupBy("efa_date", "efa").agg(F.count("*").alias("n_actual"))
    both = f.join(a.select("efa_date", "efa", "day", "sp", "price"), ["efa_date", "efa", "day", "sp"], "left").join(counts, ["efa_date", "efa"])


    w = lambda *o: Window.partitionBy("efa_date", "efa").orderBy(*o)
    both = both.withColumns({"low": F.row_number().over(w("forecast", "day", "sp")), "high": F.row_number().over(w(F.desc("forecast"), "day", "sp")), "n_forecast": F.count("*").over(Window.partitionBy("efa_date", "efa"))})
    n = F.greatest(F.lit(1), F.floor(F.col("duration_h") * 2).cast("int"))
    both = both.join(F.broadcast(cells.select("duration_h").distinct().withColumn("n", n)), (F.col("n_forecast") >= 2 * F.col("n")) & (F.col("n_actual") >= 2 * F.col("n")))
    e = both.groupBy("duration_h", "efa_date", "efa").agg(F.avg(F.when(F.col("low") <= F.col("n"), F.col("price"))).alias("buy"), F.avg(F.when(F.col("high") <= F.col("n"), F.col("price"))).alias("sell"))
    return e.join(F.broadcast(cells.select("scenario", "duration_h")), "duration_h")


def greedy_foresight(prices: DataFrame, plan: DataFrame, cells: DataFrame) -> DataFrame:
    return greedy(block_ends(prices, cells), plan, cells)


def _rolling(horizon: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["day", "sp"])
        c = p.iloc[0]
        energy = c.power_mw * c.duration_h
        low, high, soc, rows = SOC_LOWER * energy, SOC_UPPER * energy, c.initial_soc * energy, []
        seen = p.forecast.fillna(0.0).tolist()
        mw = p.arb_mw.fillna(0.0).tolist()
        for i, (day, sp, actual) in enumerate(zip(p.day, p.sp, p.price)):
            revenue = wear = out = 0.0
            if actual == actual and actual is not None:
                out, into, _ = solve(soc, seen[i : i + horizon], mw[i : i + horizon], low, high, c.efficiency, c.wear)
                revenue, wear = actual * (out - into), c.wear * out
                if out > 0 or into > 0:
                    soc = min(max(soc - out + into * c.efficiency, 0.0), energy)
            rows.append((c.scenario, day, sp, revenue, wear, out, soc / energy))
        return pd.DataFrame(rows, columns=["scenario", "day", "sp", "revenue_gbp", "wear_gbp", "mwh", "soc_frac"])

    return run


def rolling(periods: DataFrame, cells: DataFrame, horizon: int = 96) -> DataFrame:
    """Model-predictive dispatch: every half-hour solves the horizon ahead and does its first
    step. periods: scenario, day, sp, price, forecast, arb_mw. A missing actual price skips the
    half-hour, a missing forecast counts 0."""
    rows = periods.join(F.broadcast(cells), "scenario")
    ship(rows.sparkSession)
    return rows.groupBy("scenario").applyInPandas(_rolling(horizon), STEPS)


def monthly(trades: DataFrame, with_mwh: bool = True) -> DataFrame:
    mwh = F.sum("mwh") if with_mwh else F.lit(None).cast("double")
    return trades.groupBy("scenario", cal.month(F.col("day")).alias("month")).agg(F.sum("revenue_gbp").alias("imbalance_revenue_gbp"), F.sum("wear_gbp").alias("cycling_cost_gbp"), mwh.alias("mwh_cycled"))
