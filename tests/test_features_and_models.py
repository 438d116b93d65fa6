import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.functions import holidays, numbers, ranks
from voltlake.operators import features, fleet, forecast, market, models, results
from voltlake.plans import jobs

D = dt.date(2024, 1, 1)


def index(spark, days=24, gap=None, seed=1):
    r = random.Random(seed)
    rows = [(D + dt.timedelta(days=i), sp, "APXMIDP", 50 + 20 * math.sin(sp / 7) + r.gauss(0, 2) + i) for i in range(days) if i != gap for sp in range(1, 49)]
    return spark.createDataFrame(rows + [(D, 1, "OTHER", 1.0)], "settlement_date date, settlement_period int, provider string, price double")


def generation(spark, days=24):
    rows = [(D + dt.timedelta(days=i), g, 10.0 * (i + 1)) for i in range(days) for g in ("Wind", "Gas")] + [(None, "Gas", 5.0)]
    return spark.createDataFrame(rows, "settlement_date date, fuel_group string, generation double")


def test_row_lag_and_calendar_lag_differ_over_a_gap(spark):
    p = features.spot(index(spark, 12, gap=5))
    lag = features.period_lags(p).where("settlement_period = 1 and settlement_date = date '2024-01-07'").first()
    assert lag.lag_1d == p.where("settlement_period = 1 and settlement_date = date '2024-01-05'").first().spot
    days = {r.settlement_date for r in features.daily_stats(p).collect()}
    assert dt.date(2024, 1, 7) not in days and dt.date(2024, 1, 6) in days
    rolled = {r.settlement_date: r.rolling_7d_mean for r in features.daily_stats(p).collect()}
    assert rolled[dt.date(2024, 1, 7) + dt.timedelta(days=1)] is None and rolled[dt.date(2024, 1, 9)] is not None


def test_matrix(spark):
    f = spark.createDataFrame([(dt.date(2024, 1, 1), 40.0)], "month date, fleet_mw double")
    m = features.feature_matrix(index(spark), generation(spark), f, ["2024-01-20"])
    rows = {(r.settlement_date, r.settlement_period): r for r in m.collect()}
    assert len(rows) == 10 * 48
    r = rows[dt.date(2024, 1, 20), 48]
    assert (r.gen_wind, r.gen_total, r.gen_renewable_frac, r.is_weekend, r.is_bank_holiday) == (190.0, 380.0, 0.5, 1, 1)
    assert r.fleet_suppression == pytest.approx(40 / 380) and r.sp_sin == pytest.approx(0, abs=1e-9)
    assert features.columns_for(m)[:2] == ["lag_1d", "lag_2d"] and "gen_wind" in features.columns_for(m)
    curve = features.curve_features(m)
    assert len([c for c in curve.columns if c.startswith("curve_")]) == 144
    assert curve.where("settlement_date = date '2024-01-20'").first().dow_5 == 1
    assert features.feature_matrix(index(spark, 1).where("false"), generation(spark)).count() == 0


def test_zero_generation_has_no_fraction(spark):
    g = spark.createDataFrame([(D, "Gas", 0.0)], "settlement_date date, fuel_group string, generation double")
    assert features.generation_mix(g).first().gen_renewable_frac is None


def test_trailing_mean_is_28_calendar_days(spark):
    rows = [("DCH", D + dt.timedelta(days=k), 1, v, 1.0) for k, v in ((0, 1.0), (27, 3.0), (28, 5.0))]
    a = spark.createDataFrame(rows, "service string, efa_date date, efa int, price double, volume double")
    got = [r.trend for r in market.clearing_trend(a).orderBy("efa_date").collect()]
    assert got == [1.0, 2.0, 4.0]


def test_share_positive_counts_missing_as_no(spark):
    rows = [("DC", v) for v in (1.0, -1.0, 0.0, 2.0)]
    s = spark.createDataFrame([*rows, ("DC", None)], "market string, spread double")
    assert market.spread_summary(s.where("spread is not null")).first().pct_positive == 50
    assert market.spread_summary(s).first().pct_positive == 40


def test_fleet(spark):
    p = spark.createDataFrame([(100.0, dt.date(2024, 1, 15)), (50.0, dt.date(2024, 2, 10))], "installed_capacity_mw double, operational_date date")
    assert [r.fleet_mw for r in fleet.series(p, "2024-01-01", "2024-03-31").orderBy("month").collect()] == [100, 150, 200]
    assert [r.fleet_mw for r in fleet.cumulative(p, "2024-02-01", "2024-03-31").orderBy("month").collect()] == [150, 150]


def test_metrics(spark):
    s = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (3.0, 4.0)], "spot double, prediction double")
    m = forecast.metrics(s).first()
    assert m.rho == pytest.approx(0.948683, abs=1e-6) and m.spike_rmse is None and m.mae == 0.5
    ten = spark.createDataFrame([(float(i), 0.0) for i in range(1, 101)], "spot double, prediction double")
    assert forecast.metrics(ten).first().spike_rmse == pytest.approx(math.sqrt(sum(i * i for i in range(91, 101)) / 10))


def test_lasso_path_finds_the_columns():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8))
    y = 3 * x[:, 1] - 2 * x[:, 4] + 0.1 * r.normal(size=200) + 7
    w, b = models.fit_lasso(x, y)
    assert w[1] == pytest.approx(3, abs=0.1) and w[4] == pytest.approx(-2, abs=0.1) and b == pytest.approx(7, abs=0.1)
    assert np.abs(np.delete(w, [1, 4])).max() < 0.05


@pytest.mark.parametrize(("kind", "options"), [("rf", {"numTrees": 5, "maxDepth": 5}), ("lgb", {"maxIter": 3}), ("lear", {"least": 3}), ("dnn", {"layers": (16, 8), "epochs": 10})])
def test_models(spark, kind, options):
    m = features.feature_matrix(index(spark), generation(spark)).persist()
    model, scores, data = forecast.train(m, kind, "2024-01-22", **options)
    assert {r.part: r.n for r in scores.collect()} == {"train": 7 * 48, "test": 3 * 48}
    assert forecast.predict_prices(model, data).where("price is not null").count() == 10 * 48
    assert len(model.importances()) >= len(features.columns_for(m)) and forecast.importance_table(model, spark, 10).count() == 10


def test_unknown_model():
    with pytest.raises(ValueError):
        models.build("arima", [])


def test_average_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "v double")
    assert sorted((r.v or 0, r.k) for r in forecast.average_ranks(df, "v").withColumnRenamed("rank", "k").collect()) == [(1.0, 1.0), (2.0, 2.5), (5.0, 4.0)]
    

def test_network_over_shards(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 3))
    y = 2 * x[:, 0] - x[:, 1] + 1
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i // 30) for i in range(3000)]
    rows = [(d, float(np.sign(v) * np.expm1(abs(v))), *map(float, a)) for d, v, a in zip(days, y, x)]
    df = spark.createDataFrame(rows, "settlement_date date, spot double, a double, b double, c double")
    error = {}
    for shard_rows in (10_000, 800):
        m = models.NeuralModel(["a", "b", "c"], layers=(32,), epochs=25, dropout=0.0, rate=0.01, batch=64, shard_rows=shard_rows).fit(df)
        error[shard_rows] = m.predict(df).selectExpr("avg(abs(log1p(abs(prediction)) * sign(prediction) - log1p(abs(spot)) * sign(spot)))").first()[0]
    assert max(error.values()) < 0.35 and float(np.abs(y - y.mean()).mean()) > 1.5


@pytest.mark.parametrize("seed", range(3))
def test_ranks_and_percentiles(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(k, None if r.random() < 0.05 else float(r.choice([-1.0, 0.0, 2.5, r.normal(), float(r.integers(40))]))) for k in ("a", "b", None) for _ in range(int(r.integers(1, 400)))]
    df = spark.createDataFrame([*rows, ("one", 3.0), ("none", None)], "k string, v double")
    got = {x.k: x for x in ranks.percentiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k in ("a", "b", None):
        own = [v for g, v in rows if g == k and v is not None]
        assert (got[k].low, got[k].mid, got[k].top) == pytest.approx((np.percentile(own, 10), np.percentile(own, 50), max(own)))
        for x in ranks.ranked(df, ["k"], "v", buckets=8).where(F.col("k").eqNullSafe(F.lit(k))).collect():
            assert (x.n, x.before, x.total) == (own.count(x.v), sum(v < x.v for v in own), len(own))
    assert ranks.percentiles(df.where("false"), [], "v", {"mid": 0.5}).first().mid is None


def test_holidays():
    assert [holidays.easter(y).isoformat() for y in (1999, 2008, 2011, 2024, 2038)] == ["1999-04-04", "2008-03-23", "2011-04-24", "2024-03-31", "2038-04-25"]
    days = set(holidays.between(2011, 2024))
    assert {"2011-04-29", "2011-12-27", "2012-06-04", "2020-05-08", "2020-12-28", "2021-12-28", "2022-01-03", "2022-09-19", "2023-05-08", "2024-08-26"} <= days
    assert not {"2012-05-28", "2020-05-04", "2022-05-30", "2024-12-27"} & days


def test_benchmarks(spark):
    m = features.feature_matrix(index(spark), generation(spark)).persist()
    small = {"rf": {"numTrees": 3, "maxDepth": 3}, "lear": {"least": 3}}
    table = jobs.model_benchmark(m, "2024-01-22", tuple(small), small).persist()
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == set(small) and all(r.part == "test" and r.overfit > 0 for r in rows.values())
    least = min(rows, key=lambda k: rows[k].rmse)
    assert jobs.best_model(table).first().model == least
    assert [r.model for r in results.ranked_models(table, "rmse").where("best").collect()] == [least]
    auctions = spark.createDataFrame([("DCH", dt.date(2024, 1, 22), 2, 1.0, 5.0)], "service string, efa_date date, efa int, volume double, price double")
    gaps = {r.strategy: r.gap for r in jobs.revenue_benchmark(auctions, index(spark), m, "2024-01-22", ("lear",), small).collect()}
    assert set(gaps) == {"perfect", "naive", "lear"}


def test_money(spark):
    df = spark.createDataFrame([(2_345_678.0,), (-1_500_000.0,), (12_345.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.money(F.col("x"))).collect()] == ["£2.35M", "£-1.50M", "£12k", "£0k", None]
