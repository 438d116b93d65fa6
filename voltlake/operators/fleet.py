"""Monthly battery fleet: running sum over a month spine, extended by a straight line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month, months
from ..functions.constants import FLEET_MILESTONES


def cumulative(projects: DataFrame, start: str, end: str) -> DataFrame:
    """month, fleet_mw: capacity with a date up to the month's end. The <= join is a sum by
    month and a running sum, with what came before the spine in its first month."""
    spine = months(projects.sparkSession, start, end)
    first = F.trunc(F.lit(start).cast("date"), "MM")
    added = projects.groupBy(F.greatest(month(F.col("operational_date")), first).alias("month")).agg(F.sum("installed_capacity_mw").alias("added"))
    w = Window.partitionBy(F.lit(1)).orderBy("month")  # a row a month
    return spine.join(added, "month", "left").select("month", F.sum(F.coalesce("added", F.lit(0.0))).over(w).alias("fleet_mw"))


def series(projects: DataFrame, start: str, end: str, fit_months: int = 12) -> DataFrame:
    """As `cumulative`, with the months after the last project on the least-squares line
    through the last `fit_months` known ones, 0 at least."""
    last = projects.agg(month(F.max("operational_date")).alias("last"))
    c = cumulative(projects, start, end).join(F.broadcast(last))  # one row
    c = c.withColumn("known", F.col("month") <= F.col("last"))
    back = F.row_number().over(Window.partitionBy("known").orderBy(F.desc("month")))
    ahead = F.row_number().over(Window.partitionBy("known").orderBy("month"))
    n = F.count("*").over(Window.partitionBy("known"))
    c = c.withColumns({"back": back, "ahead": ahead, "n": n})
    used = c.where(f"known and back <= {fit_months}").withColumn("x", (F.least("n", F.lit(fit_months)) - F.col("back")).cast("double"))
    fit = used.agg(F.regr_slope("fleet_mw", "x").alias("slope"), F.regr_intercept("fleet_mw", "x").alias("intercept"), F.count("*").alias("k"))
    line = F.greatest(F.col("slope") * (F.col("k") + F.col("ahead") - 1) + F.col("intercept"), F.lit(0.0))
    return c.join(F.broadcast(fit)).select("month", F.when(F.col("known"), F.col("fleet_mw")).otherwise(line).alias("fleet_mw"))


def milestones(fleet: DataFrame, expected: dict[int, float] | None = None) -> DataFrame:
    """The year's last value against what is expected; off if over a fifth away."""
    e = fleet.sparkSession.createDataFrame(list((expected or FLEET_MILESTONES).items()), "year int, expected double")
    y = fleet.groupBy(F.year("month").alias("year")).agg(F.max_by("fleet_mw", "month").alias("fleet_mw"))
    out = y.join(F.broadcast(e), "year").withColumn("delta_pct", (F.col("fleet_mw") / F.col("expected") - 1) * 100)
    return out.withColumn("off", F.abs("delta_pct") > 20)
