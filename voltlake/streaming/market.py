"""The batch operators' nearest streaming forms: half-hour buckets, sliding means, first-wins
dedup and a running state of charge, with watermarks so that state is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import SOC_LOWER, SOC_UPPER


def half_hours(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling half-hours of (ts, value): count and mean."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "30 minutes").alias("w")).agg(F.count("value").alias("n"), F.avg("value").alias("price"))
    return w.select(F.col("w.start").alias("start"), "n", "price")


def sliding_mean(prices: DataFrame, days: int = 28, late: str = "1 day") -> DataFrame:
    """Trailing mean of (ts, service, price), a value a day."""
    w = prices.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), "service").agg(F.avg("price").alias("trend"))
    return w.select("service", F.to_date(F.col("w.end") - F.expr("interval 1 day")).alias("day"), "trend")


def first_of_key(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _charge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    energy = 100.0
    soc = state.get[0] if state.exists else 0.5 * energy
    out = []
    for r in pd.concat(list(batches)).sort_values("ts").itertuples():
        soc = min(max(soc + r.mwh, SOC_LOWER * energy), SOC_UPPER * energy)
        out.append((key[0], r.ts, soc / energy))
    state.update((soc,))
    yield pd.DataFrame(out, columns=["unit", "ts", "soc_frac"])


def state_of_charge(flows: DataFrame) -> DataFrame:
    """(unit, ts, mwh, charging positive) to a state of charge kept in its band; in each
    micro-batch a unit's flows are taken in time order."""
    return flows.groupBy("unit").applyInPandasWithState(_charge, "unit string, ts timestamp, soc_frac double", "soc double", "append", GroupStateTimeout.NoTimeout)
