"""Market tables as views over the driver's tables, with the same SQL for DuckDB.

Averages are taken of whole cents or millionths, so that both engines give the same double.
Each view is a name and a SELECT that both dialects accept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SERVICE = "case l_returnflag || l_linestatus when 'AF' then 'DCH' when 'AO' then 'DCL' when 'NF' then 'DRH' when 'NO' then 'DRL' when 'RF' then 'DMH' when 'RO' then 'DML' end"
_PRICE = "cast(round((l_extendedprice / l_quantity / 1000 - 0.5) * 1000000) as bigint)"
_FUEL = "case substr(o_orderpriority, 1, 1) when '1' then 'CCGT' when '2' then 'WIND' when '3' then 'NUCLEAR' when '4' then 'SOLAR' else 'INTFR' end"
_GROUP = "case substr(o_orderpriority, 1, 1) when '1' then 'Gas' when '2' then 'Wind' when '3' then 'Nuclear' when '4' then 'Solar' else 'Interconnectors' end"
_CENTS = "cast(round(value * 100) as bigint)"
_SP = "cast(floor((60 * hour(ts) + minute(ts)) / 30) as int) + 1"
_GEN = "cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100000"

VIEWS = {
    "market_index": f"select cast(ts as date) as settlement_date, {_SP} as settlement_period, 'APXMIDP' as provider, cast(sum({_CENTS}) as double) / (100 * count(value)) - 40 as price from events group by 1, 2",
    "market_index_multi": f"select cast(ts as date) as settlement_date, {_SP} as settlement_period, event_type as provider, cast(sum({_CENTS}) as double) / (100 * count(value)) - 40 as price from events group by 1, 2, 3",
    "market_index_long_day": f"select cast(ts as date) as settlement_date, {_SP} + case when cast(ts as date) = date '2024-01-28' then 2 else 0 end as settlement_period, 'APXMIDP' as provider, cast(sum({_CENTS}) as double) / (100 * count(value)) - 40 as price from events group by 1, 2",
    "system_prices": f"select cast(ts as date) as settlement_date, {_SP} as settlement_period, cast(sum(case when event_type = 'click' then {_CENTS} end) as double) / (100 * nullif(count(case when event_type = 'click' then value end), 0)) as sell_price, cast(sum(case when event_type = 'purchase' then {_CENTS} end) as double) / (100 * nullif(count(case when event_type = 'purchase' then value end), 0)) as buy_price from events group by 1, 2",
    "auctions": f"select {_SERVICE} as service, date_add(date '2024-01-01', cast(l_orderkey % 30 as int)) as efa_date, cast((l_linenumber - 1) % 6 + 1 as int) as efa, cast(sum({_PRICE}) as double) / (1000000 * count(*)) as price, cast(sum(cast(l_quantity as bigint)) as double) / count(*) as volume from lineitem group by 1, 2, 3",
    "auctions_raw": f"select {_SERVICE} as service, date_add(date '2024-01-01', cast(l_orderkey % 30 as int)) as efa_date, cast((l_linenumber - 1) % 6 + 1 as int) as efa, cast({_PRICE} as double) / 1000000 as price, l_quantity as volume, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem",
    "auctions_long": f"select {_SERVICE} as service, cast(l_shipdate as date) as efa_date, cast((l_linenumber - 1) % 6 + 1 as int) as efa, cast({_PRICE} as double) / 1000000 as price, l_quantity as volume from lineitem",
    "generation": f"select date_add(date '2024-01-01', cast(o_orderkey % 30 as int)) as settlement_date, {_GROUP} as fuel_group, {_GEN} as generation from orders group by 1, 2",
    "generation_long": f"select cast(o_orderdate as date) as settlement_date, {_GROUP} as fuel_group, {_GEN} as generation from orders group by 1, 2",
    "fuel_half_hourly": f"select cast(o_orderdate as date) as settlement_date, {_FUEL} as fuel_type, o_totalprice / 1000 as generation from orders",
    "projects": "select c_mktsegment as technology_type, case o_orderstatus when 'F' then 'Operational' else 'Under Construction' end as development_status, c_acctbal as installed_capacity_mw, cast(o_orderdate as date) as operational_date from orders join customer on o_custkey = c_custkey",
    "fleet": "select cast(date_trunc('month', o_orderdate) as date) as month, cast(count(*) as double) as fleet_mw from orders group by 1",
}
_TABLES = ("events", "lineitem", "orders", "customer")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of a folder."""
    sql, args = VIEWS[name], {}
    for t in _TABLES:
        if f" {t}" in sql:
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql, **args)


def duck(name: str) -> str:
    """The same SELECT in DuckDB's dialect."""
    return VIEWS[name].replace("date_add(date '2024-01-01', cast(l_orderkey % 30 as int))", "(date '2024-01-01' + cast(l_orderkey % 30 as int))").replace("date_add(date '2024-01-01', cast(o_orderkey % 30 as int))", "(date '2024-01-01' + cast(o_orderkey % 30 as int))")


def ctes(*names: str) -> str:
    return ", ".join(f"{n} as ({duck(n)})" for n in names)
