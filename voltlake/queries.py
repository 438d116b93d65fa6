"""Registered queries over the driver's tables, each with its DuckDB equivalent where SQL can
say it. Doubles that come of averages are rounded to six places on both sides, as engines add in
different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import ctes, view
from .functions import calendar as cal
from .functions import numbers as nu
from .functions.constants import GROUPS, SERVICES
from .operators import allocation as al
from .operators import clean, features, fleet, forecast, market
from .operators import dispatch as di
from .operators import results as re
from .plans import backtest as bt
from .session import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The battery of the back-test queries.
HALF = al.Battery()


def register(name: str, sql: str | None = None, views: str = ""):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = f"with {ctes(*views.split())} {sql}" if views and not sql.lstrip().startswith("with") else sql
        return f

    return add


def rounded(df: DataFrame, *skip: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


# Filters, projections, unions

register("flt_service_date", "select service, efa_date, efa, price, volume from auctions_long where service in ('DCH', 'DCL') and efa_date between date '1996-01-01' and date '1996-12-31'", "auctions_long")(
    lambda s, d: clean.of_services(clean.date_range(view(s, d, "auctions_long"), "efa_date", "1996-01-01", "1996-12-31"), ["DCH", "DCL"])
)
register("flt_price_floor", "select service, efa_date, efa, price, volume from auctions_long where price >= 0.0 and service in ('DCH','DCL','DRH','DRL','DMH','DML')", "auctions_long")(
    lambda s, d: clean.of_services(view(s, d, "auctions_long"), None, 0.0)
)
register("flt_without_services", "select service, efa_date, efa, price, volume from auctions where service not in ('DCH', 'DRL')", "auctions")(
    lambda s, d: rounded(clean.without_services(view(s, d, "auctions"), ["DCH", "DRL"]).select("service", "efa_date", "efa", "price", "volume"))
)
SQL["flt_without_services"] = f"with {ctes('auctions')} select service, efa_date, efa, round(price, 6) as price, round(volume, 6) as volume from auctions where service not in ('DCH', 'DRL')"
register("flt_provider", "select settlement_date, settlement_period, provider, round(price, 6) as price from market_index_multi where provider = 'purchase'", "market_index_multi")(
    lambda s, d: rounded(clean.of_provider(view(s, d, "market_index_multi"), "purchase"))
)
register("flt_extra_periods", "select settlement_date, settlement_period, provider, round(price, 6) as price from market_index_long_day where settlement_period <= 48", "market_index_long_day")(
    lambda s, d: rounded(clean.drop_extra_periods(view(s, d, "market_index_long_day")))
)
register("flt_month_range", "select settlement_date, fuel_group, round(generation, 6) as generation from generation_long where settlement_date between date '1997-03-01' and date '1997-05-31'", "generation_long")(
    lambda s, d: rounded(clean.month_range(view(s, d, "generation_long"), "settlement_date", "1997-03-15", "1997-05-02"))
)
register("prj_lenient_numbers", "select event_id, try_cast(props as double) as n, cast(try_cast(cast(value as varchar) as double) as double) as v, signed, case when signed = 0 then null else 1 / signed end as inverse from (select *, cast(cast(user_id as bigint) % 3 - 1 as double) as signed from events)")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").withColumn("signed", (F.col("user_id") % 3 - 1).cast("double")).select("event_id", nu.number("props").alias("n"), nu.number("value").alias("v"), "signed", nu.ratio(F.lit(1.0), F.col("signed")).alias("inverse"))
)
register("prj_signed_log", "select event_id, round(sign(x) * ln(1 + abs(x)), 6) as logged, round(x, 6) as back from (select event_id, value - 40 as x from events)")(
    lambda s, d: rounded(s.read.parquet(f"{d}/events.parquet").select("event_id", nu.signed_log(F.col("value") - 40).alias("logged")).withColumn("back", nu.signed_exp(F.col("logged"))))
)
register("dedup_first_wins", "select service, efa_date, efa, price, volume, l_orderkey from (select *, row_number() over (partition by service, efa_date, efa order by l_orderkey, l_linenumber, l_partkey, l_suppkey, price, volume) as k from auctions_raw) where k = 1", "auctions_raw")(
    lambda s, d: clean.first_wins(view(s, d, "auctions_raw"), ["service", "efa_date", "efa"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "volume"]).select("service", "efa_date", "efa", "price", "volume", "l_orderkey")
)


def _union(s, d):
    legacy = view(s, d, "auctions_long").select("service", "efa_date", "efa", "price").withColumn("source_rank", F.lit(0))
    other = view(s, d, "auctions").select("service", "efa_date", "efa", "price").withColumn("source_rank", F.lit(1))
    return rounded(clean.first_wins(clean.union_all([legacy, other]), ["service", "efa_date", "efa"], ["source_rank", "price"]))


register("union_first_wins", "select service, efa_date, efa, round(price, 6) as price, source_rank from (select *, row_number() over (partition by service, efa_date, efa order by source_rank, price) as k from (select service, efa_date, efa, price, 0 as source_rank from auctions_long union all select service, efa_date, efa, price, 1 from auctions)) where k = 1", "auctions_long auctions")(_union)
register(
    "daily_gen_by_group",
    "select settlement_date, case fuel_type when 'CCGT' then 'Gas' when 'WIND' then 'Wind' when 'NUCLEAR' then 'Nuclear' when 'SOLAR' then 'Solar' when 'INTFR' then 'Interconnectors' else 'Other' end as fuel_group, round(sum(generation), 6) as generation from fuel_half_hourly where settlement_date is not null group by 1, 2",
    "fuel_half_hourly",
)(lambda s, d: rounded(clean.daily_generation(view(s, d, "fuel_half_hourly"))))


def _eac(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    raw = e.select(F.col("event_type").alias("auctionProduct"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("deliveryStart"), (F.col("user_id") % 4).cast("string").alias("clearedVolume"), F.col("value").cast("string").alias("clearingPrice"))
    return rounded(clean.block_auctions(raw).drop("delivery_start", "delivery_end"))


register(
    "eac_block_vwap",
    "select event_type as service, cast(ts as date) + cast(hour(ts) >= 23 as int) as efa_date, cast(floor(((hour(ts) + 1) % 24) / 4) as int) + 1 as efa, round(avg(cast(user_id % 4 as double)), 6) as volume, round(sum(value * (user_id % 4)) / nullif(sum(cast(user_id % 4 as double)), 0), 6) as price from events group by 1, 2, 3",
)(_eac)


def _wide(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    demand = e.select(F.date_format("ts", "dd/MM/yyyy").alias(" settlement_date"), cal.period_of(F.col("ts")).alias("SETTLEMENT_PERIOD"), F.col("value").cast("string").alias("embedded_solar_generation"), F.col("user_id").cast("string").alias("EMBEDDED_WIND_GENERATION "))
    return clean.embedded_generation(demand)


register("wide_to_long", "select cast(ts as date) as settlement_date, cast(floor((60 * hour(ts) + minute(ts)) / 30) as int) + 1 as settlement_period, unnest([value, cast(user_id as double)]) as generation, unnest(['SOLAR', 'EMBEDDED_WIND']) as fuel_type from events")(_wide)
register("month_spine", "select cast(unnest(generate_series(date '2019-01-01', date '2023-12-01', interval 1 month)) as date) as month")(lambda s, d: cal.months(s, "2019-01-15", "2023-12-31"))
register("date_chunks", "select cast(s as date) as start, least(cast(s as date) + 6, date '2024-03-10') as end from (select unnest(generate_series(date '2024-01-01', date '2024-03-10', interval 7 day)) as s)")(lambda s, d: cal.chunks(s, "2024-01-01", "2024-03-10"))

# Market overview

#: Prices have six places, so means of two or four fall on halves of the last place kept, which
#: engines round either way: both sides are moved off them first.
NUDGE = 1.234e-8
register("clearing_trend", f"select service, efa_date, round(p + {NUDGE}, 6) as daily_price, round(avg(p) over (partition by service order by efa_date range between interval 27 days preceding and current row) + {NUDGE}, 6) as trend from (select service, efa_date, avg(price) as p from auctions_long where service is not null group by 1, 2)", "auctions_long")(
    lambda s, d: market.clearing_trend(view(s, d, "auctions_long")).select("service", "efa_date", *(F.round(F.col(c) + NUDGE, 6).alias(c) for c in ("daily_price", "trend")))
)
register("service_summary", "select service, round(avg(price), 6) as mean_price, round(median(price), 6) as median_price, round(max(price), 6) as max_price, round(avg(volume), 6) as mean_volume, count(price) as n from auctions_long where service is not null group by 1", "auctions_long")(
    lambda s, d: rounded(market.service_summary(view(s, d, "auctions_long")))
)
register("service_order", "select service, round(avg(price), 6) as mean_price from auctions where service is not null group by 1 order by 2 desc", "auctions")(lambda s, d: rounded(market.service_order(view(s, d, "auctions"))))
_BOX = "round(min(price), 6) as low, round(quantile_cont(price, 0.25), 6) as q1, round(quantile_cont(price, 0.5), 6) as q2, round(quantile_cont(price, 0.75), 6) as q3, round(max(price), 6) as high"
register("price_box", f"select service, {_BOX} from auctions_long group by 1", "auctions_long")(lambda s, d: rounded(market.five_numbers(view(s, d, "auctions_long"), ["service"], "price")))
register("price_box_by_block", f"select efa, service, {_BOX} from auctions_long group by 1, 2", "auctions_long")(lambda s, d: rounded(market.five_numbers(view(s, d, "auctions_long"), ["efa", "service"], "price")))
_SPREADS = ctes("auctions") + ", spreads as (select m.market, h.efa_date, h.efa, h.price as h, l.price as l, h.price - l.price as spread from (values ('DC', 'DCH', 'DCL'), ('DR', 'DRH', 'DRL'), ('DM', 'DMH', 'DML')) m(market, hs, ls) join auctions h on h.service = m.hs join auctions l on l.service = m.ls and l.efa_date = h.efa_date and l.efa = h.efa)"
_spreads = lambda s, d: market.spreads(view(s, d, "auctions"))
for _name, _f, _sql in (
    ("spread_rows", lambda x: x, "select market, efa_date, efa, round(h, 6) as h, round(l, 6) as l, round(spread, 6) as spread from spreads"),
    ("spread_daily", market.spread_daily, "select efa_date, market, round(avg(spread), 6) as mean_spread from spreads group by 1, 2"),
    ("spread_by_block", market.spread_by_block, "select efa, market, round(avg(spread), 6) as mean_spread from spreads group by 1, 2"),
    ("spread_summary", market.spread_summary, "select market, round(avg(spread), 6) as mean, round(median(spread), 6) as median, round(stddev_samp(spread), 6) as std, round(min(spread), 6) as min, round(max(spread), 6) as max, round(avg(case when spread > 0 then 1.0 else 0.0 end) * 100, 6) as pct_positive from spreads group by 1"),
    ("spread_heat_map", lambda x: market.spread_heat_map(x, "DC"), "select strftime(efa_date, '%Y-%m') as month, " + ", ".join(f"round(avg(case when efa = {i} then spread end), 6) as efa_{i}" for i in range(1, 7)) + " from spreads where market = 'DC' group by 1"),
    ("spread_box", lambda x: market.five_numbers(x, ["market"], "spread"), f"select market, {_BOX.replace('price', 'spread')} from spreads group by 1"),
):
    register(_name)(lambda s, d, f=_f: rounded(f(_spreads(s, d))))
    SQL[_name] = f"with {_SPREADS} {_sql}"
register("system_daily", "select settlement_date, round(avg(sell_price), 6) as sell, round(avg(buy_price), 6) as buy from system_prices group by 1", "system_prices")(lambda s, d: rounded(market.system_daily(view(s, d, "system_prices"))))
_AGAINST = ctes("system_prices", "auctions") + ", both_ as (select a.day, a.sell, b.service_price from (select settlement_date as day, avg(sell_price) as sell from system_prices group by 1) a join (select efa_date as day, avg(price) as service_price from auctions where service = 'DCH' group by 1) b on a.day = b.day)"
_against = lambda s, d: market.price_against_service(view(s, d, "system_prices"), view(s, d, "auctions"))
register("price_against_service")(lambda s, d: rounded(_against(s, d)))
SQL["price_against_service"] = f"with {_AGAINST} select day, round(sell, 6) as sell, round(service_price, 6) as service_price from both_"
register("price_correlation")(lambda s, d: rounded(market.correlation(_against(s, d), "sell", "service_price")))
SQL["price_correlation"] = f"with {_AGAINST} select round(corr(sell, service_price), 6) as corr, count(*) as n from both_ where sell is not null and service_price is not null"
_DENSE = ctes("generation_long") + ", g as (select settlement_date, fuel_group, avg(generation) as generation from generation_long where settlement_date is not null and fuel_group is not null group by 1, 2), dense as (select d.settlement_date, f.fuel_group, coalesce(g.generation, 0.0) as generation from (select distinct settlement_date from g) d cross join (select distinct fuel_group from g) f left join g on g.settlement_date = d.settlement_date and g.fuel_group = f.fuel_group)"
_gen = lambda s, d: view(s, d, "generation_long")
register("generation_trend")(lambda s, d: rounded(market.generation_trend(_gen(s, d))))
SQL["generation_trend"] = f"with {_DENSE} select settlement_date, fuel_group, round(generation, 6) as generation, round(case when count(*) over w >= 7 then avg(generation) over w end, 6) as trend from dense window w as (partition by fuel_group order by settlement_date rows between 13 preceding and current row)"
register("fuel_share")(lambda s, d: rounded(market.fuel_share(_gen(s, d))))
SQL["fuel_share"] = f"with {_DENSE}, m as (select fuel_group, avg(generation) as x from dense group by 1 having avg(generation) > 0) select fuel_group, round(x, 6) as mean_generation, round(x / sum(x) over (), 6) as share from m"
register("fuel_buckets")(lambda s, d: rounded(market.fuel_buckets(_gen(s, d))))
SQL["fuel_buckets"] = f"with {_DENSE}, m as (select fuel_group, avg(generation) as x from dense group by 1 having avg(generation) > 0) select case when upper(fuel_group) in ('WIND','HYDRO','BIOMASS','SOLAR') then 'Renewables' when upper(fuel_group) in ('GAS','COAL','OIL') then 'Fossil Fuels' else 'Other' end as bucket, round(sum(x), 6) as mean_generation from m group by 1"
register("date_bounds", "select auction_from, auction_to, auction_rows, price_from, price_to, price_rows, greatest(auction_from, price_from) as start, least(auction_to, price_to) as \"end\" from (select min(efa_date) as auction_from, max(efa_date) as auction_to, count(*) as auction_rows from auctions), (select min(settlement_date) as price_from, max(settlement_date) as price_to, count(*) as price_rows from market_index)", "auctions market_index")(
    lambda s, d: market.date_bounds(view(s, d, "auctions"), view(s, d, "market_index"))
)
register("distinct_services", "select distinct service from auctions", "auctions")(lambda s, d: view(s, d, "auctions").select("service").distinct())

# Calendar, features, fleet

register("efa_bridge", "select settlement_date as day, settlement_period as sp, settlement_date + cast(floor((settlement_period + 1) / 48) as int) as efa_date, cast(floor((settlement_period + 1) / 8) as int) % 6 + 1 as efa, round(price, 6) as price from market_index where settlement_period <= 48 and price is not null", "market_index")(
    lambda s, d: rounded(al.in_blocks(al.spot_prices(view(s, d, "market_index"))))
)
register("feature_lags", "select settlement_date, settlement_period, round(price, 6) as spot, " + ", ".join(f"round(lag(price, {k}) over w, 6) as lag_{k}d" for k in (1, 2, 7, 14)) + " from market_index where provider = 'APXMIDP' window w as (partition by settlement_period order by settlement_date)", "market_index")(
    lambda s, d: rounded(features.period_lags(features.spot(view(s, d, "market_index"))))
)
_STATS = "stats as (select settlement_date + 1 as settlement_date, a as prev_day_mean, s as prev_day_std, hi as prev_day_max, lo as prev_day_min, case when count(*) over w >= 7 then avg(a) over w end as rolling_7d_mean from (select settlement_date, avg(price) as a, stddev_samp(price) as s, max(price) as hi, min(price) as lo from market_index group by 1) window w as (order by settlement_date rows between 6 preceding and current row))"
_STAT_COLS = "prev_day_mean prev_day_std prev_day_max prev_day_min rolling_7d_mean".split()
_r = lambda cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)
register("feature_daily_stats")(lambda s, d: rounded(features.daily_stats(features.spot(view(s, d, "market_index")))))
SQL["feature_daily_stats"] = f"with {ctes('market_index')}, {_STATS} select settlement_date, {_r(_STAT_COLS)} from stats"
_GCOLS = {g: features.column_of(g) for g in GROUPS}
_ren = " + ".join(c for c in _GCOLS.values() if any(w in c for w in ("wind", "hydro", "biomass", "solar")))
_fos = " + ".join(c for c in _GCOLS.values() if any(w in c for w in ("gas", "coal", "oil")))
_MIX = "mix as (select *, (" + _ren + ") / nullif(gen_total, 0) as gen_renewable_frac, (" + _fos + ") / nullif(gen_total, 0) as gen_fossil_frac from (select *, " + " + ".join(_GCOLS.values()) + " as gen_total from (select settlement_date + 1 as settlement_date, " + ", ".join(f"coalesce(sum(case when fuel_group = '{g}' then generation end), 0.0) as {c}" for g, c in _GCOLS.items()) + " from generation group by 1)))"
_MIX_COLS = [*_GCOLS.values(), "gen_total", "gen_renewable_frac", "gen_fossil_frac"]
register("feature_generation_mix")(lambda s, d: rounded(features.generation_mix(view(s, d, "generation"))))
SQL["feature_generation_mix"] = f"with {ctes('generation')}, {_MIX} select settlement_date, {_r(_MIX_COLS)} from mix"
_CYC = "round(sin(2 * pi() * settlement_period / 48), 6) as sp_sin, round(cos(2 * pi() * settlement_period / 48), 6) as sp_cos, round(sin(2 * pi() * (isodow(settlement_date) - 1) / 7), 6) as dow_sin, round(cos(2 * pi() * (isodow(settlement_date) - 1) / 7), 6) as dow_cos, round(sin(2 * pi() * dayofyear(settlement_date) / dayofyear(make_date(year(settlement_date), 12, 31))), 6) as doy_sin, round(cos(2 * pi() * dayofyear(settlement_date) / dayofyear(make_date(year(settlement_date), 12, 31))), 6) as doy_cos, cast(isodow(settlement_date) >= 6 as int) as is_weekend, cast(settlement_date = date '2024-01-01' as int) as is_bank_holiday"


def _matrix(s, d):
    m = features.feature_matrix(view(s, d, "market_index"), view(s, d, "generation"), view(s, d, "fleet"))
    return rounded(m)


register("feature_matrix")(_matrix)
SQL["feature_matrix"] = f"""with {ctes('market_index', 'generation', 'fleet')}, {_STATS}, {_MIX},
lags as (select settlement_date, settlement_period, price as spot, lag(price, 1) over w as lag_1d, lag(price, 2) over w as lag_2d, lag(price, 7) over w as lag_7d, lag(price, 14) over w as lag_14d from market_index window w as (partition by settlement_period order by settlement_date)),
m as (select lags.*, stats.* exclude (settlement_date), mix.* exclude (settlement_date), coalesce(f.fleet_mw, 0.0) as fleet_mw, coalesce(coalesce(f.fleet_mw, 0.0) / nullif(mix.gen_total, 0), 0.0) as fleet_suppression
  from lags left join stats using (settlement_date) left join mix using (settlement_date) left join fleet f on f.month = cast(date_trunc('month', lags.settlement_date - 1) as date))
select settlement_date, settlement_period, {_r(['spot', 'lag_1d', 'lag_2d', 'lag_7d', 'lag_14d', *_STAT_COLS, *_MIX_COLS, 'fleet_mw', 'fleet_suppression'])}, {_CYC} from m
where lag_1d is not null and lag_2d is not null and lag_7d is not null and lag_14d is not null and prev_day_mean is not null and prev_day_std is not null and prev_day_max is not null and prev_day_min is not null and rolling_7d_mean is not null"""


def _curves(s, d):
    p = features.spot(view(s, d, "market_index"))
    return rounded(features.curve_features(p))


register(
    "feature_curves",
    "select b.settlement_date, b.settlement_period, "
    + ", ".join(f"round(w{k}.p{p}, 6) as curve_{k}d_{p}" for k in (1, 2, 7) for p in range(1, 49))
    + ", " + ", ".join(f"cast(isodow(b.settlement_date) = {i + 1} as int) as dow_{i}" for i in range(7)) + " from market_index b "
    + " ".join("left join (select settlement_date + {0} as settlement_date, ".format(k) + ", ".join(f"max(case when settlement_period = {p} then price end) as p{p}" for p in range(1, 49)) + f" from market_index group by 1) w{k} on w{k}.settlement_date = b.settlement_date" for k in (1, 2, 7)),
    "market_index",
)(_curves)
_TECH = ["automobile", "building"]
_projects = lambda s, d: clean.battery_projects(view(s, d, "projects"), _TECH)
_PROJ = ctes("projects") + ", p as (select * from projects where lower(trim(technology_type)) in ('automobile', 'building') and lower(development_status) like '%operational%' and installed_capacity_mw > 0 and operational_date is not null)"
register("battery_projects")(lambda s, d: _projects(s, d))
SQL["battery_projects"] = f"with {_PROJ} select * from p"
_SPINE = "spine as (select cast(unnest(generate_series(date '1996-01-01', date '2002-12-01', interval 1 month)) as date) as month), c as (select s.month, coalesce((select sum(installed_capacity_mw) from p where operational_date <= last_day(s.month)), 0.0) as fleet_mw from spine s)"
register("fleet_cumulative")(lambda s, d: rounded(fleet.cumulative(_projects(s, d), "1996-01-01", "2002-12-31")))
SQL["fleet_cumulative"] = f"with {_PROJ}, {_SPINE} select month, round(fleet_mw, 6) as fleet_mw from c"
_SERIES = _SPINE + ", last_ as (select cast(date_trunc('month', max(operational_date)) as date) as m from p), known as (select *, row_number() over (order by month desc) as back from c where month <= (select m from last_)), fit as (select regr_slope(fleet_mw, x) as a, regr_intercept(fleet_mw, x) as b, count(*) as k from (select fleet_mw, 12.0 - back as x from known where back <= 12)), series as (select month, fleet_mw from known union all select c.month, greatest(a * (k + row_number() over (order by c.month) - 1) + b, 0.0) from c, fit where c.month > (select m from last_))"
register("fleet_series")(lambda s, d: fleet.series(_projects(s, d), "1996-01-01", "2002-12-31").select("month", F.round("fleet_mw", 3).alias("fleet_mw")))
SQL["fleet_series"] = f"with {_PROJ}, {_SERIES} select month, round(fleet_mw, 3) as fleet_mw from series"


def _milestones(s, d):
    m = fleet.milestones(fleet.series(_projects(s, d), "1996-01-01", "2002-12-31"), {1997: 1_000_000.0, 1999: 1_500_000.0, 2001: 2_000_000.0})
    return m.select("year", F.round("fleet_mw", 3).alias("fleet_mw"), "expected", F.round("delta_pct", 6).alias("delta_pct"), "off")


register("fleet_milestones")(_milestones)
SQL["fleet_milestones"] = f"with {_PROJ}, {_SERIES}, y as (select cast(year(month) as int) as year, max_by(fleet_mw, month) as f from series group by 1), e(year, expected) as (values (1997, 1000000.0::double), (1999, 1500000.0), (2001, 2000000.0)) select y.year, round(f, 3) as fleet_mw, expected, round((f / expected - 1) * 100, 6) as delta_pct, abs((f / expected - 1) * 100) > 20 as off from y join e on y.year = e.year"

# Allocation, dispatch, results

_BASE = ctes("market_index", "auctions") + """, spot as (select settlement_date as day, settlement_period as sp, price from market_index where settlement_period <= 48 and price is not null),
blocks as (select *, day + cast(floor((sp + 1) / 48) as int) as efa_date, cast(floor((sp + 1) / 8) as int) % 6 + 1 as efa from spot),
ranked as (select *, row_number() over (partition by efa_date, efa order by price, day, sp) as low, row_number() over (partition by efa_date, efa order by price desc, day, sp) as high, count(*) over (partition by efa_date, efa) as n from blocks),
ends as (select efa_date, efa, avg(case when low <= 4 then price end) as buy, avg(case when high <= 4 then price end) as sell from ranked where n >= 8 group by 1, 2),
resp as (select efa_date, efa, sum(price * 4) as response from auctions where price >= 0 group by 1, 2),
grid as (select d.efa_date, e.efa from (select distinct day as efa_date from spot) d cross join (values (1), (2), (3), (4), (5), (6)) e(efa)),
split as (select g.efa_date, g.efa, coalesce(r.response, 0.0) as response, coalesce(greatest(0.0, (e.sell - e.buy / 0.9 - 3.0) * 2.0), 0.0) as trade from grid g left join ends e on e.efa_date = g.efa_date and e.efa = g.efa left join resp r on r.efa_date = g.efa_date and r.efa = g.efa),
plan as (select *, case when response + trade > 0 then 50.0 * response / (response + trade) else 50.0 end as fr_mw from split),
income as (select cast(date_trunc('month', a.efa_date) as date) as month, a.service, sum(a.price * coalesce(p.fr_mw, 50.0) * 4) as revenue_gbp from auctions a left join plan p on p.efa_date = a.efa_date and p.efa = a.efa where a.price >= 0 group by 1, 2)"""


def _recursion(ends: str, gain: str) -> str:
    """Greedy trades of the blocks of a CTE, as the recursion `walk`."""
    return f"""todo as (select row_number() over (order by e.efa_date, e.efa) as i, e.efa_date, e.efa, e.buy, e.sell, 50.0 - p.fr_mw as arb from {ends} e join plan p on p.efa_date = e.efa_date and p.efa = e.efa where 50.0 - p.fr_mw > 0 and e.buy is not null and e.sell is not null),
walk(i, efa_date, efa, soc, go, revenue, wear, mwh) as (
  select 0::bigint, null::date, null::int, 50.0::double, false, 0.0::double, 0.0::double, 0.0::double
  union all
  select i, efa_date, efa, case when go then least(greatest(soc - dis + {gain}, 0.0), 100.0) else soc end, go, sell * dis - buy * chg, 3.0 * dis, dis from (
    select *, (dis > 0 and chg > 0 and sell * dis - buy * chg > 3.0 * dis) as go from (
      select *, least(dis / 0.9, greatest(0.0, 90.0 - soc)) as chg from (
        select t.*, w.soc, least(t.arb * 2.0, greatest(0.0, w.soc - 10.0)) as dis from walk w join todo t on t.i = w.i + 1)))
)"""


_TRADES = "with recursive " + _BASE + ", " + _recursion("ends", "chg * 0.9")
_INCOME = """, arb as (select cast(date_trunc('month', efa_date) as date) as month, sum(revenue) as rev, sum(wear) as wear from walk where go group by 1),
wide as (select month, """ + ", ".join(f"coalesce(sum(case when service = '{x}' then revenue_gbp end), 0.0) * 0.95 as {x}_rev" for x in SERVICES) + """ from income group by 1),
monthly as (select coalesce(w.month, a.month) as month, """ + ", ".join(f"coalesce({x}_rev, 0.0) as {x}_rev" for x in SERVICES) + """, coalesce(rev, 0.0) * 0.95 as imbalance_revenue_gbp, coalesce(wear, 0.0) * 0.95 as cycling_cost_gbp from wide w full join arb a on a.month = w.month),
totals as (select *, """ + " + ".join(f"{x}_rev" for x in SERVICES) + """ + imbalance_revenue_gbp as gross_revenue from monthly)"""
_MONTHLY = _TRADES + _INCOME


def _inputs(s, d):
    """Aggregates of a row a block and a half-hour, which a back-test reads several times."""
    return view(s, d, "auctions").persist(), view(s, d, "market_index").persist(), bt.reference_cells(s)


def _plan(s, d):
    a, m, c = _inputs(s, d)
    return al.schedule(a, al.spot_prices(m), c)


register("block_ends")(lambda s, d: rounded(al.block_ends(al.spot_prices(view(s, d, "market_index")), bt.reference_cells(s)).select("efa_date", "efa", "buy", "sell")))
SQL["block_ends"] = f"with {_BASE} select efa_date, efa, round(buy, 6) as buy, round(sell, 6) as sell from ends"
register("response_value")(lambda s, d: rounded(al.response_value(view(s, d, "auctions"))))
SQL["response_value"] = f"with {_BASE} select efa_date, efa, round(response, 6) as response from resp"
register("fr_schedule")(lambda s, d: rounded(_plan(s, d).select("efa_date", "efa", "response", "trade", "fr_mw")))
SQL["fr_schedule"] = f"with {_BASE} select efa_date, efa, {_r(['response', 'trade', 'fr_mw'])} from plan"


def _income(s, d):
    a, m, c = _inputs(s, d)
    return al.response_revenue(a, al.schedule(a, al.spot_prices(m), c), c).select("month", "service", F.round("revenue_gbp", 4).alias("revenue_gbp"))


register("ancillary_monthly")(_income)
SQL["ancillary_monthly"] = f"with {_BASE} select month, service, round(revenue_gbp, 4) as revenue_gbp from income"
register("period_power")(lambda s, d: rounded(al.period_power(al.spot_prices(view(s, d, "market_index")), _plan(s, d)).select("day", "sp", "price", "arb_mw")))
SQL["period_power"] = f"with {_BASE} select b.day, b.sp, round(b.price, 6) as price, round(coalesce(50.0 - p.fr_mw, 0.0), 6) as arb_mw from blocks b left join plan p on p.efa_date = b.efa_date and p.efa = b.efa"


def _perfect(s, d, **o):
    a, m, c = _inputs(s, d)
    return bt.perfect_foresight(a, m, c, **o)


register("greedy_trades")(lambda s, d: _perfect(s, d).trades.select(F.col("day").alias("efa_date"), "efa", *(F.round(c, 4).alias(c) for c in ("revenue_gbp", "wear_gbp", "mwh", "soc"))))
SQL["greedy_trades"] = _TRADES + " select efa_date, efa, round(revenue, 4) as revenue_gbp, round(wear, 4) as wear_gbp, round(mwh, 4) as mwh, round(soc, 4) as soc from walk where go"
_MCOLS = [f"{x}_rev" for x in SERVICES] + ["imbalance_revenue_gbp", "cycling_cost_gbp", "gross_revenue", "net_revenue"]
register("greedy_backtest")(lambda s, d: _perfect(s, d).monthly.select("month", *(F.round(c, 3).alias(c) for c in _MCOLS)))
SQL["greedy_backtest"] = _MONTHLY + " select month, " + ", ".join(f"round({c}, 3) as {c}" for c in _MCOLS[:-1]) + ", round(gross_revenue - cycling_cost_gbp, 3) as net_revenue from totals"
_TOTALS = ", s as (select sum(gross_revenue) as g, sum(cycling_cost_gbp) as w, count(*) / 12.0 as y from totals)"


def _summary(s, d):
    x = _perfect(s, d).summary
    return x.select("scenario", *(F.round(c, 3).alias(c) for c in ("total_gross", "total_cycling_cost", "total_net", "years_covered", "annualised_net", "annualised_per_mw")), "top_service", F.round("fr_mw", 6).alias("fr_mw"), F.round("arb_mw", 6).alias("arb_mw"))


register("backtest_summary")(_summary)
SQL["backtest_summary"] = _MONTHLY + _TOTALS + ", streams as (select unnest([" + ", ".join(f"'{x}'" for x in [*SERVICES, "Arbitrage"]) + "]) as k, unnest([" + ", ".join(f"sum({x}_rev)" for x in SERVICES) + ", sum(imbalance_revenue_gbp)]) as v from totals) select 'reference' as scenario, round(g, 3) as total_gross, round(w, 3) as total_cycling_cost, round(g - w, 3) as total_net, round(y, 3) as years_covered, round((g - w) / y, 3) as annualised_net, round((g - w) / y / 50.0, 3) as annualised_per_mw, (select max_by(k, v) from streams) as top_service, (select round(avg(fr_mw), 6) from plan) as fr_mw, (select round(avg(50.0 - fr_mw), 6) from plan) as arb_mw from s"
register("wear_sensitivity")(lambda s, d: re.wear_sensitivity(_perfect(s, d).summary).select("wear", F.round("net", 3).alias("net"), F.round("net_per_mw_year", 3).alias("net_per_mw_year")))
SQL["wear_sensitivity"] = _MONTHLY + _TOTALS + " select c::double as wear, round(g - w / 3.0 * c, 3) as net, round((g - w / 3.0 * c) / y / 50.0, 3) as net_per_mw_year from s, unnest([0.0, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0]) t(c)"


def _mix(s, d):
    r = re.service_mix(_perfect(s, d).monthly, bt.reference_cells(s))
    return r.select(F.element_at(F.split("scenario", r"\|"), 2).alias("mix"), F.round("total_net", 3).alias("total_net"), F.round("annualised_per_mw", 3).alias("annualised_per_mw"))


register("service_mix")(_mix)
_FR = " + ".join(f"{x}_rev" for x in SERVICES)
SQL["service_mix"] = _MONTHLY + f", mixes(mix, f, a) as (values ('FR only', 1, 0), ('Arbitrage only', 0, 1), ('FR + Arbitrage', 1, 1)), z as (select mix, sum(f * ({_FR}) + a * (imbalance_revenue_gbp - cycling_cost_gbp)) as n, count(*) / 12.0 as y from totals, mixes group by 1) select mix, round(n, 3) as total_net, round(n / y / 50.0, 3) as annualised_per_mw from z"
register("cumulative_revenue")(lambda s, d: re.cumulative(_perfect(s, d).monthly).select("month", "stream", F.round("revenue_gbp", 3).alias("revenue_gbp"), F.round("cumulative_gbp", 3).alias("cumulative_gbp")))
SQL["cumulative_revenue"] = _MONTHLY + ", long as (unpivot (select month, " + ", ".join(_MCOLS[:7]) + " from totals) on columns(* exclude (month)) into name stream value v) select month, stream, round(v, 3) as revenue_gbp, round(sum(v) over (partition by stream order by month), 3) as cumulative_gbp from long"


def _filtered(s, d):
    m = re.filtered(_perfect(s, d).monthly, "2024-01-10", "2024-01-20", ["DCH", "DCL"], 100.0)
    return m.select("month", *(F.round(c, 3).alias(c) for c in _MCOLS[:9]))


register("filtered_view")(_filtered)
SQL["filtered_view"] = _MONTHLY + " select month, " + ", ".join(f"round({f'{c} * 2.0' if c[:3] in ('DCH', 'DCL', 'imb', 'cyc') else c if c == 'gross_revenue' else '0.0'}, 3) as {c}" for c in _MCOLS[:9]) + " from totals where month between date '2024-01-01' and date '2024-01-31'"

# Forecasts

register("naive_forecast", "select settlement_date + 1 as day, settlement_period as sp, round(price, 6) as price from market_index where settlement_period <= 48 and price is not null", "market_index")(lambda s, d: rounded(forecast.naive(al.spot_prices(view(s, d, "market_index")))))


def _scored(s, d):
    p = al.spot_prices(view(s, d, "market_index"))
    return p.withColumnRenamed("price", "spot").join(forecast.naive(p).withColumnRenamed("price", "prediction"), ["day", "sp"])


_SCORED = ctes("market_index") + ", z as (select a.price as y, b.price as p from market_index a join market_index b on b.settlement_date = a.settlement_date - 1 and b.settlement_period = a.settlement_period where a.settlement_period <= 48), q as (select quantile_cont(y, 0.9) as h from z), ra as (select y, p, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp from z)"
register("forecast_metrics")(lambda s, d: rounded(forecast.metrics(_scored(s, d))))
SQL["forecast_metrics"] = f"with {_SCORED} select count(*) as n, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(avg(abs(y - p)), 6) as mae, round(case when count(case when y >= h then 1 end) >= 10 then sqrt(avg(case when y >= h then (y - p) * (y - p) end)) end, 6) as spike_rmse, (select round(corr(ry, rp), 6) from ra) as rho from z, q"
_FORECAST = _BASE.replace("blocks as (select", "actual as (select *, day + cast(floor((sp + 1) / 48) as int) as efa_date, cast(floor((sp + 1) / 8) as int) % 6 + 1 as efa from spot),\nseen as (select day + 1 as day, sp, price from spot where day + 1 in (select day from spot)),\nblocks as (select").replace("% 6 + 1 as efa from spot),\nranked", "% 6 + 1 as efa from seen),\nranked").replace("(select distinct day as efa_date from spot)", "(select distinct day as efa_date from seen)")
_FENDS = "counts as (select efa_date, efa, count(*) as n from actual group by 1, 2), own as (select *, row_number() over (partition by efa_date, efa order by price, day, sp) as low, row_number() over (partition by efa_date, efa order by price desc, day, sp) as high, count(*) over (partition by efa_date, efa) as n from blocks where efa_date = day), fends as (select o.efa_date, o.efa, avg(case when o.low <= 4 then a.price end) as buy, avg(case when o.high <= 4 then a.price end) as sell from own o join counts c on c.efa_date = o.efa_date and c.efa = o.efa left join actual a on a.day = o.day and a.sp = o.sp where o.n >= 8 and c.n >= 8 group by 1, 2)"


def _naive_run(s, d):
    a, m, c = _inputs(s, d)
    return bt.forecast_driven(a, m, c)


register("forecast_trades")(lambda s, d: _naive_run(s, d).trades.select(F.col("day").alias("efa_date"), "efa", *(F.round(c, 4).alias(c) for c in ("revenue_gbp", "wear_gbp", "mwh", "soc"))))
SQL["forecast_trades"] = "with recursive " + _FORECAST + ", " + _FENDS + ", " + _recursion("fends", "dis / 0.9") + " select efa_date, efa, round(revenue, 4) as revenue_gbp, round(wear, 4) as wear_gbp, round(mwh, 4) as mwh, round(soc, 4) as soc from walk where go"


def _gap(s, d):
    a, m, c = _inputs(s, d)
    return bt.strategies(a, m, c).select("strategy", "scenario", F.round("total_net", 3).alias("total_net"), F.round("gap", 6).alias("gap"))


register("revenue_gap")(_gap)
_FMONTHLY = "with recursive " + _FORECAST + ", " + _FENDS + ", " + _recursion("fends", "dis / 0.9") + _INCOME
_NETS = "select sum(gross_revenue) - sum(cycling_cost_gbp) as net, sum(imbalance_revenue_gbp) - sum(cycling_cost_gbp) as arb from totals"
_BOTH = f"with p as ({_MONTHLY} {_NETS}), n as ({_FMONTHLY} {_NETS})"
SQL["revenue_gap"] = _BOTH + " select s.strategy, 'reference' as scenario, round(s.net, 3) as total_net, round(case when abs(p.net - n.net) >= 1.0 then (s.net - n.net) / (p.net - n.net) end, 6) as gap from p, n, (select 'perfect' as strategy, net from p union all select 'naive', net from n) s"


def _trading_gap(s, d):
    a, m, c = _inputs(s, d)
    runs = {"perfect": bt.perfect_foresight(a, m, c), "naive": bt.forecast_driven(a, m, c)}
    return re.trading_gap({k: r.monthly for k, r in runs.items()}).select("strategy", "scenario", F.round("trading_net", 3).alias("trading_net"), F.round("gap", 6).alias("gap"))


register("trading_gap")(_trading_gap)
SQL["trading_gap"] = _BOTH + " select s.strategy, 'reference' as scenario, round(s.arb, 3) as trading_net, round(case when abs(p.arb - n.arb) >= 1.0 then (s.arb - n.arb) / (p.arb - n.arb) end, 6) as gap from p, n, (select 'perfect' as strategy, arb from p union all select 'naive', arb from n) s"


def _sizes(s, d):
    x = bt.size_sensitivity(view(s, d, "auctions"), view(s, d, "market_index")).summary
    return x.select("scenario", *(F.round(c, 3).alias(c) for c in ("total_gross", "total_cycling_cost", "total_net", "years_covered", "annualised_net", "annualised_per_mw")), "top_service", F.round("fr_mw", 6).alias("fr_mw"), F.round("arb_mw", 6).alias("arb_mw"))


def _of_size(sql: str, mw: float) -> str:
    """The summary's SQL for another power: its limits of charge, 10, 90 and 100 MWh, follow."""
    for limit, share in (("soc - 10.0", "soc - {}"), ("90.0 - soc", "{} - soc"), ("0.0), 100.0) else", "0.0), {}) else")):
        assert limit in sql
        sql = sql.replace(limit, share.format({"s": 0.2, "9": 1.8, "0": 2.0}[limit[0]] * mw))
    return sql.replace("50.0", str(mw)).replace("'reference'", f"'{mw:g} MW'")


register("size_sensitivity")(_sizes)
SQL["size_sensitivity"] = " union all ".join(f"select * from ({_of_size(SQL['backtest_summary'], mw)})" for mw in (10.0, 25.0, 50.0, 100.0, 200.0))


def _by_day(s, d):
    """Response income under a plan that knows days only: the day's mean power, else all of it."""
    a, m, c = _inputs(s, d)
    plan = al.schedule(a, al.spot_prices(m), c).groupBy("scenario", "efa_date").agg(F.avg("fr_mw").alias("fr_mw")).where(F.dayofmonth("efa_date") % 3 != 0)
    return al.response_revenue(a, plan, c).select("month", "service", F.round("revenue_gbp", 4).alias("revenue_gbp"))


register("ancillary_by_day")(_by_day)
SQL["ancillary_by_day"] = f"with {_BASE}, daily as (select efa_date, avg(fr_mw) as fr_mw from plan where dayofmonth(efa_date) % 3 <> 0 group by 1) select cast(date_trunc('month', a.efa_date) as date) as month, a.service, round(sum(a.price * coalesce(p.fr_mw, 50.0) * 4), 4) as revenue_gbp from auctions a left join daily p on p.efa_date = a.efa_date where a.price >= 0 group by 1, 2"
register("mpc_backtest")(lambda s, d: _perfect(s, d, method="mpc").monthly)
register("soc_profile")(lambda s, d: market.soc_profile(_perfect(s, d, method="mpc").soc))


def _model(kind: str, **options):
    def run(s, d):
        m = features.feature_matrix(view(s, d, "market_index"), view(s, d, "generation"), view(s, d, "fleet"))
        # Written, so that no later plan holds the matrix's; the forest draws rows by partition and keeps those that it had.
        m = cut(m, "features") if kind in ("xgb", "lgb") else m.persist()
        return forecast.train(m, kind, "2024-01-24", **options)[1]

    return run


register("model_forest")(_model("rf"))
register("model_boosted")(_model("xgb"))
register("model_boosted_deep")(_model("lgb"))
register("model_per_period")(_model("lear", least=5))  # the fixture has 23 days a period; the default least is 30
register("model_neural")(_model("dnn"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocation and greedy back-test: the monthly table."""
    return _perfect(spark, sf_dir).monthly
