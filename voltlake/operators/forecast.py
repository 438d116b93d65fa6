"""Forecasts for whole ranges of days at once, and their error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import correlation
from ..functions.ranks import average_ranks, percentiles
from ..session import cut
from .features import columns_for, curve_features
from .models import build


def naive(prices: DataFrame) -> DataFrame:
    """day, sp, price: the day before's price of the same half-hour."""
    return prices.select(F.date_add("day", 1).alias("day"), "sp", "price")


def split(features: DataFrame, test_start: str) -> tuple[DataFrame, DataFrame]:
    at = F.lit(test_start).cast("date")
    return features.where(F.col("settlement_date") < at), features.where(F.col("settlement_date") >= at)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of the ranks, those of ties at their mean."""
    both = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c, name in ((a, "_ra"), (b, "_rb")):
        both = both.join(average_ranks(both, c).withColumnRenamed("rank", name), c)
    return both.agg(correlation("_ra", "_rb").alias("rho"))


def metrics(scored: DataFrame, actual: str = "spot", predicted: str = "prediction", least_spikes: int = 10) -> DataFrame:
    """n, rmse, mae, rho and the root mean square error of the top tenth of prices, if there
    are `least_spikes` of them. Not rounded."""
    s = scored.select(F.col(actual).alias("y"), F.col(predicted).alias("p")).where("y is not null and p is not null")
    s = cut(s, "scored")  # two columns that are read several times; what made them may be a long plan
    high = percentiles(s, [], "y", {"limit": 0.9})
    e = s.join(F.broadcast(high)).withColumn("e", F.col("y") - F.col("p"))  # one row
    spike = F.col("y") >= F.col("limit")
    out = e.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"),
        F.when(F.count(F.when(spike, 1)) >= least_spikes, F.sqrt(F.avg(F.when(spike, F.col("e") * F.col("e"))))).alias("spike_rmse"))
    return out.join(F.broadcast(spearman(s, "y", "p")))


def rounded_metrics(m: DataFrame) -> DataFrame:
    return m.withColumns({"rmse": F.bround("rmse", 2), "mae": F.bround("mae", 2), "rho": F.bround("rho", 3), "spike_rmse": F.bround("spike_rmse", 2)})


def train(features: DataFrame, kind: str, test_start: str, **options):
    """A fitted model, and metrics of both sides of the split (part: train or test). The
    per-period and neural models also see whole price curves."""
    data = features
    if kind in ("lear", "dnn"):
        data = features.join(curve_features(features), ["settlement_date", "settlement_period"])
    columns = columns_for(features) + [c for c in data.columns if c.startswith(("curve_", "dow_")) and c not in features.columns]
    before, after = split(data, test_start)
    model = build(kind, columns, **options).fit(before)
    parts = [metrics(model.predict(d)).withColumn("part", F.lit(n)) for n, d in (("train", before), ("test", after))]
    return model, parts[0].unionByName(parts[1]), data


def predict_prices(model, features: DataFrame) -> DataFrame:
    """day, sp, price for every row of a feature table: one pass for all days."""
    return model.predict(features).select(F.col("settlement_date").alias("day"), F.col("settlement_period").alias("sp"), F.col("prediction").alias("price"))


def importance_table(model, spark, top: int | None = None) -> DataFrame:
    rows = [(i + 1, c, float(v)) for i, (c, v) in enumerate(model.importances())]
    return spark.createDataFrame(rows[:top], "rank int, feature string, importance double")


def overfit_ratio(m: DataFrame) -> DataFrame:
    """Test error over training error."""
    return m.agg((F.max(F.when(F.col("part") == "test", F.col("rmse"))) / F.nullif(F.max(F.when(F.col("part") == "train", F.col("rmse"))), F.lit(0.0))).alias("overfit"))
