import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from voltlake.operators import allocation as al
from voltlake.operators import dispatch as di
from voltlake.operators import results as re
from voltlake.operators.lp import Value, solve
from voltlake.plans import backtest as bt

D = dt.date(2024, 1, 1)


def day_prices(spark, rows):
    return spark.createDataFrame([(D + dt.timedelta(days=i), sp, p) for i, sp, p in rows], "day date, sp int, price double")


def block(spark):
    """Prices 10 to 80 in block 2 of the day."""
    return day_prices(spark, [(0, 7 + k, 10.0 * (k + 1)) for k in range(8)])


def auctions(spark, price=10.0):
    return spark.createDataFrame([("DCH", D, 2, price, 1.0)], "service string, efa_date date, efa int, price double, volume double")


def test_allocation(spark):
    cells = bt.reference_cells(spark)
    p = al.schedule(auctions(spark), block(spark), cells).where("efa = 2").first()
    assert p.response == 40 and p.trade == pytest.approx(68.4444, abs=1e-4) and p.fr_mw == pytest.approx(18.4426, abs=1e-4)
    assert p.fr_mw + p.arb_mw == pytest.approx(50)
    long = al.schedule(auctions(spark), block(spark), bt.reference_cells(spark, duration_h=4.0))
    assert {r.fr_mw for r in long.collect()} == {50.0}


@pytest.mark.parametrize(("rule", "soc"), [("charged", 46.0), ("discharged", 54.4444)])
def test_greedy(spark, rule, soc):
    cells = bt.reference_cells(spark)
    plan = al.schedule(auctions(spark), block(spark), cells)
    t = di.greedy(al.block_ends(block(spark), cells), plan, cells, rule).first()
    assert (t.revenue_gbp, t.wear_gbp) == (pytest.approx(1600), pytest.approx(120)) and t.soc == pytest.approx(soc, abs=1e-4)


def test_forecast_first_block_has_six(spark):
    cells = bt.reference_cells(spark)
    rows = day_prices(spark, [(0, 47, 1.0), (0, 48, 2.0)] + [(1, k, 10.0 * k) for k in range(1, 7)])
    assert di.forecast_ends(rows, rows, cells).count() == 0
    assert di.forecast_ends(rows, rows, cells, bridge_first_block=True).count() == 1


def test_income(spark):
    cells = bt.reference_cells(spark)
    plan = spark.createDataFrame([("reference", D, 2, 20.0)], "scenario string, efa_date date, efa int, fr_mw double")
    a = auctions(spark, 5.0).unionAll(spark.createDataFrame([("DCH", D, 2, -1.0, 1.0), ("DCL", D, 3, 1.0, 1.0), ("DCL", D, 3, None, 1.0)], "service string, efa_date date, efa int, price double, volume double"))
    assert {r.service: r.revenue_gbp for r in al.response_revenue(a, plan, cells).collect()} == {"DCH": 400.0, "DCL": 200.0}


def test_program_goldens():
    out, into, gain = solve(50, [10, 100], [50, 50], 10, 90, 0.9, 3)
    assert (out, into, gain) == (pytest.approx(15), 0, pytest.approx(2530))
    out, into, gain = solve(90, [-40], [50], 10, 90, 0.9, 3)
    assert (out, into, gain) == (pytest.approx(22.5), pytest.approx(25), pytest.approx(32.5))
    assert solve(90, [-20], [50], 10, 90, 0.9, 3)[:2] == (0, 0)


def lattice(soc, prices, mw, low, high, eff, wear, step=1):
    """Best value over whole MWh of discharge and twice whole MWh of charge, at efficiency 0.5."""
    best = {soc: 0.0}
    for p, m in zip(prices, mw):
        new = {}
        for s, v in best.items():
            for d, c in itertools.product(range(int(m / 2) + 1), range(0, int(m / 2) + 1, 2)):
                t = s - d + eff * c
                if low <= t <= high:
                    new[t] = max(new.get(t, -1e9), v + p * (d - c) - wear * d)
        best = new
    return max(best.values())


def test_program_against_a_lattice():
    r = random.Random(4)
    for _ in range(60):
        n = r.randrange(1, 5)
        prices, mw = [r.randrange(-60, 120) for _ in range(n)], [4 * r.randrange(0, 4) for _ in range(n)]
        soc = r.randrange(2, 11)
        out, into, gain = solve(soc, prices, mw, 2, 10, 0.5, 3)
        assert gain == pytest.approx(lattice(soc, prices, mw, 2, 10, 0.5, 3))
        rest = Value(2, 10)
        for p, m in zip(prices[:0:-1], mw[:0:-1]):
            rest.add(p, m / 2, 3, 0.5)
        after = soc - out + 0.5 * into
        assert prices[0] * (out - into) - 3 * out + rest(after) == pytest.approx(gain)
        assert 2 - 1e-9 <= after <= 10 + 1e-9


def test_rolling_keeps_the_band_and_beats_greedy(spark):
    r = random.Random(1)
    prices = day_prices(spark, [(i, sp, float(r.randrange(-50, 200))) for i in range(3) for sp in range(1, 49)])
    cells = bt.reference_cells(spark)
    plan = al.fixed_schedule(prices, cells, 20.0)
    steps = di.rolling(al.period_power(prices, plan).withColumn("forecast", F.col("price")), cells, 48).collect()
    assert len(steps) == 144 and all(0.1 - 1e-9 <= x.soc_frac <= 0.9 + 1e-9 for x in steps)
    assert sum(x.revenue_gbp - x.wear_gbp for x in steps) > 0


def test_months_of_one_stream_and_summary(spark):
    cells = bt.reference_cells(spark)
    response = spark.createDataFrame([("reference", D, "DCH", 100.0)], "scenario string, month date, service string, revenue_gbp double")
    trade = spark.createDataFrame([("reference", dt.date(2024, 2, 1), 50.0, 10.0, None)], "scenario string, month date, imbalance_revenue_gbp double, cycling_cost_gbp double, mwh_cycled double")
    m = re.monthly_table(response, trade, cells)
    assert {(r.month, round(r.net_revenue, 6)) for r in m.collect()} == {(D, 95.0), (dt.date(2024, 2, 1), 38.0)}
    s = re.summary(m, cells).first()
    assert s.years_covered == pytest.approx(2 / 12) and s.top_service == "DCH" and s.total_mwh_cycled is None
    assert {r.mix for r in re.service_mix(m, cells).select(F.element_at(F.split("scenario", r"\|"), 2).alias("mix")).collect()} == {"FR only", "Arbitrage only", "FR + Arbitrage"}
    view = re.filtered(m, "2024-02-10", "2024-02-11", ["DCL"], 100.0)
    assert [(r.DCH_rev, r.imbalance_revenue_gbp) for r in view.collect()] == [(0.0, 95.0)]


def test_gap(spark):
    g = lambda *x: spark.range(1).select(re.revenue_gap({k: F.lit(float(v)) for k, v in zip(("model", "naive", "perfect"), x)})).first()[0]
    assert g(90, 80, 100) == 0.5 and g(1, 0, 0.5) is None


def test_unknown_choices(spark):
    with pytest.raises(ValueError):
        di.greedy(None, None, None, "other")
    with pytest.raises(ValueError):
        bt.perfect_foresight(None, None, None, method="x")


def test_empty_tables(spark):
    prices = spark.createDataFrame([], "settlement_date date, settlement_period int, provider string, price double")
    run = bt.perfect_foresight(auctions(spark), prices, bt.reference_cells(spark))
    assert run.monthly.first().DCH_rev == pytest.approx(10 * 50 * 4 * 0.95)
