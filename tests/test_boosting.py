import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators import boosting, features, forecast, models

D = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def matrix(spark):
    r = np.random.default_rng(1)
    rows = [(D + dt.timedelta(days=i), sp, "APXMIDP", float(50 + 20 * math.sin(sp / 7) + r.normal(0, 2) + i)) for i in range(24) for sp in range(1, 49)]
    gen = [(D + dt.timedelta(days=i), g, 10.0 * (i + 1)) for i in range(24) for g in ("Wind", "Gas")]
    prices = spark.createDataFrame(rows, "settlement_date date, settlement_period int, provider string, price double")
    return features.feature_matrix(prices, spark.createDataFrame(gen, "settlement_date date, fuel_group string, generation double")).persist()


def table(spark, n, seed, kinds=12):
    r = np.random.default_rng(seed)
    x = r.integers(0, kinds, (n, 4)) / 2.0
    y = 2 * x[:, 0] - x[:, 1] * (x[:, 2] > 2) + r.normal(size=n)
    return spark.createDataFrame([(float(v), *map(float, a)) for v, a in zip(y, x)], "spot double, a double, b double, c double, d double")


@pytest.mark.parametrize(("kind", "rounds"), [("xgb", 300), ("lgb", 500)])
def test_all_rounds_in_few_jobs(spark, matrix, kind, rounds):
    matrix.count()
    spark.sparkContext.setJobGroup(f"boosted {kind}", "")
    model, scores, _ = forecast.train(matrix, kind, "2024-01-22")
    fitted = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosted {kind}"))
    spark.sparkContext.setJobGroup("others", "")
    assert max((t.column < 0).sum() for t in model.trees) <= {"xgb": 64, "lgb": 63}[kind]
    assert len(model.trees) == rounds and fitted < 60  # pyspark.ml's took 76 for 12 rounds
    by = {r.part: r for r in scores.collect()}
    assert (by["train"].n, by["test"].n) == (7 * 48, 3 * 48) and by["train"].rmse < 3


def exhaustive(x, y, rounds, rate, depth, leaves, least, l1, l2):
    """Plain boosting: every split of every leaf is tried."""
    strength = lambda g: (lambda s: (-s / (len(g) + l2), s * s / (len(g) + l2)))(np.sign(g.sum()) * max(abs(g.sum()) - l1, 0))
    score = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = score - y
        ends = [(np.arange(len(y)), 0)]

        def best(rows, d):
            tries = [(0.0, None, None)]
            for j in range(x.shape[1]):
                for v in np.unique(x[rows, j])[:-1] if d != depth else []:
                    low, high = rows[x[rows, j] <= v], rows[x[rows, j] > v]
                    if min(len(low), len(high)) >= least:
                        tries.append((strength(g[low])[1] + strength(g[high])[1] - strength(g[rows])[1], low, high))
            return max(tries, key=lambda t: t[0])

        while len(ends) < (leaves or 10**9):
            gains = [best(*e) for e in ends]
            k = max(range(len(ends)), key=lambda i: gains[i][0])
            if gains[k][0] <= 1e-6:
                break
            d = ends.pop(k)[1] + 1
            ends += [(gains[k][1], d), (gains[k][2], d)]
        for rows, _ in ends:
            score[rows] += rate * strength(g[rows])[0]
    return score


@pytest.mark.parametrize(("depth", "leaves", "least", "l1", "l2"), [(3, None, 3, 0.05, 1.0), (None, 9, 5, 0.5, 0.0), (2, 3, 1, 0.0, 0.0), (None, None, 20, 0.05, 0.0)])
def test_trees_are_those_of_exhaustive_search(spark, depth, leaves, least, l1, l2):
    df = table(spark, 150, 3, kinds=40)
    m = boosting.BoostedModel(list("abcd"), maxIter=4, stepSize=0.3, maxDepth=depth, leaves=leaves, minInstancesPerNode=least, subsamplingRate=1.0, featureSubsetStrategy="1.0", l1=l1, l2=l2)
    got = m.fit(df).predict(df).toPandas()
    y = np.sign(got["spot"]) * np.log1p(np.abs(got["spot"]))
    want = exhaustive(got[list("abcd")].to_numpy(), y.to_numpy(), 4, 0.3, depth, leaves, least, l1, l2)
    assert (np.sign(got["prediction"]) * np.log1p(np.abs(got["prediction"]))).to_numpy() == pytest.approx(want, abs=1e-5)


def test_many_tasks_give_the_trees_of_one_process(spark):
    df = table(spark, 3000, 5).unionByName(table(spark, 20, 6).withColumn("spot", F.lit(None).cast("double")))
    got = []
    for rows, data in ((10_000, df), (500, df), (10_000, df.orderBy("d", "a"))):
        m = boosting.BoostedModel(list("abcd"), maxIter=27, maxDepth=None, leaves=12, l1=0.05, here_rows=rows).fit(data)
        got.append([(t.column.tolist(), t.upto.tolist(), t.value.tolist()) for t in m.trees])
        assert max((t.column < 0).sum() for t in m.trees) == 12
    assert got[0] == got[1] == got[2]


def test_odd_training_sets(spark):
    df = spark.createDataFrame([(3.0, None, 1.0), (3.0, 2.0, float("nan"))], "spot double, a double, b double")
    for data, price in ((df, 3.0), (df.where("false"), 0.0), (df.withColumn("spot", F.lit(None).cast("double")), 0.0)):
        m = models.build("xgb", ["a", "b"], maxIter=3).fit(data)
        assert [r.prediction for r in m.predict(df).collect()] == pytest.approx([price] * 2, abs=1e-6)
        assert len(m.importances()) == 2
