"""Batch jobs: collect raw tables, prepare the processed ones, precompute the back-tests, compare
the models. From a shell: `python -m voltlake.plans.jobs collect|prepare|precompute ...`."""

from __future__ import annotations

import argparse
import subprocess
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import calendar as cal
from ..functions.numbers import number
from ..operators import clean, fleet, forecast
from ..operators.features import feature_matrix
from ..operators.market import date_bounds
from ..operators.results import best_of, rounded
from ..schemas import AUCTIONS, EAC_RAW, MARKET_INDEX, PROCESSED_NAMES, SYSTEM_PRICES
from ..sources import files
from ..sources import http as web
from ..sources.config import load_config
from . import backtest as bt


def prepare_auctions(legacy: DataFrame, eac: DataFrame) -> DataFrame:
    """Legacy rows come before the half-hourly ones, which are put into blocks first."""
    rows = clean.union_all([legacy.withColumn("source_rank", F.lit(0)), clean.block_auctions(eac).withColumn("source_rank", F.lit(1))])
    return clean.first_wins(rows, ["service", "efa_date", "efa"], ["source_rank", "delivery_start", "price", "volume"]).drop("source_rank")


def prepare_generation(half_hourly: DataFrame, demand: DataFrame | None = None) -> DataFrame:
    rows = half_hourly if demand is None else clean.union_all([half_hourly, clean.embedded_generation(demand)])
    return clean.daily_generation(rows)


def prepare_fleet(projects: DataFrame, start: str, end: str) -> DataFrame:
    return fleet.series(clean.battery_projects(projects), start, end)


def prepare_prices(raw: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """A raw price table in the types of a schema, the first row of each key."""
    kinds = {x.split()[0]: x.split()[1] for x in schema.split(", ")}
    typed = {c: number(c) if t == "double" else cal.parse_day(c) if t == "date" else F.expr(f"try_cast(`{c}` as {t})") for c, t in kinds.items()}
    return clean.first_wins(raw.withColumns(typed), keys, ["file_path", "row_seq"]).select(*kinds)


def _raw(spark: SparkSession, folder: str, pattern: str, names: dict[str, str]) -> DataFrame | None:
    """The CSV files of a pattern as text columns, their old or new names in any case, what is
    missing null; with the file and the row in it. None without a file."""
    try:
        df = spark.read.option("header", True).csv(f"{folder}/{pattern}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return None
    have = {c.strip().lower(): f"`{c}`" for c in reversed(df.columns)}
    found = {new: next((have[x] for x in (old.lower(), new.lower()) if x in have), None) for old, new in names.items()}
    columns = [(F.col(c) if c else F.lit(None).cast("string")).alias(new) for new, c in found.items()]
    return df.select(*columns, F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("row_seq"))


def _same(schema: str) -> dict[str, str]:
    return {c.split()[0]: c.split()[0] for c in schema.split(", ")}


def prepare(spark: SparkSession, raw: str, out: str, start: str, end: str) -> dict[str, DataFrame]:
    """Writes the five processed tables from a folder of raw files, those whose files are there:
    auction_results*, eac_results*, market_index*, system_prices*, generation_by_fuel*,
    embedded_solar_wind* and a project register (repd.xlsx or repd.csv)."""
    legacy = _raw(spark, raw, "auction_results*", PROCESSED_NAMES["auctions"])
    eac = _raw(spark, raw, "eac_results*", _same(EAC_RAW))
    tables: dict[str, DataFrame] = {}
    if legacy is not None or eac is not None:
        none = spark.createDataFrame
        tables["auctions"] = prepare_auctions(none([], AUCTIONS) if legacy is None else _typed_auctions(legacy), none([], EAC_RAW) if eac is None else eac)
    for name, schema, keys in (("market_index", MARKET_INDEX, ["settlement_date", "settlement_period", "provider"]), ("system_prices", SYSTEM_PRICES, ["settlement_date", "settlement_period"])):
        own = {old: new for new, old in ({new: new for new in _same(schema)} | {new: old for old, new in PROCESSED_NAMES[name].items()}).items()}
        found = _raw(spark, raw, f"{name}*", own)
        if found is not None:
            tables[name] = prepare_prices(found, schema, keys)
    half_hours = {"settlementDate": "settlement_date", "settlementPeriod": "settlement_period", "fuelType": "fuel_type", "generation": "generation"}
    parts = [_half_hours(x) for x in (_raw(spark, raw, f"{n}*", half_hours) for n in ("generation_by_fuel", "embedded_solar_wind")) if x is not None]
    if parts:
        tables["generation_daily"] = prepare_generation(clean.union_all(parts))
    register = next((p for p in (f"{raw}/repd.xlsx", f"{raw}/repd.csv") if _there(spark, p)), None)
    if register:
        tables["bess_fleet_capacity"] = prepare_fleet(files.read_projects(spark, register), start, end)
    for name, df in tables.items():
        back = {new: old for old, new in PROCESSED_NAMES[name].items()}
        files.save(df.withColumnsRenamed(back), f"{out}/{name}")
    return tables


def _there(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return False


def _half_hours(raw: DataFrame) -> DataFrame:
    """Generation by half-hour and fuel; rows that several files hold once."""
    rows = raw.withColumns({"settlement_date": cal.parse_day("settlement_date"), "settlement_period": F.expr("try_cast(settlement_period as int)"), "generation": number("generation")})
    return clean.first_wins(rows, ["settlement_date", "settlement_period", "fuel_type"], ["file_path", "row_seq"]).drop("file_path", "row_seq")


def _typed_auctions(legacy: DataFrame) -> DataFrame:
    rows = legacy.select(
        "service", cal.parse_day("efa_date", [*cal.FORMATS, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]).alias("efa_date"), F.expr("try_cast(efa as int)").alias("efa"),
        *(F.expr(f"cast(try_cast({c} as timestamp) as timestamp_ntz)").alias(c) for c in ("delivery_start", "delivery_end")), number("volume").alias("volume"), number("price").alias("price"), "file_path", "row_seq",
    )
    return clean.first_wins(rows.where("service is not null and efa_date is not null"), ["service", "efa_date", "efa"], ["file_path", "row_seq"]).drop("file_path", "row_seq")


def collect(spark: SparkSession, config: dict, start: str, end: str, out: str | None = None, sources: tuple[str, ...] = ("all",), **fetchers) -> dict[str, DataFrame]:
    """Raw tables of the configured sources, `auctions`, `prices` or all; written as CSV under
    `out` if it is given."""
    unknown = set(sources) - {"all", "auctions", "prices"}
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    use = {k: config.get(k) for k, source in (("auction_api", "auctions"), ("price_api", "prices")) if {"all", source} & set(sources)}
    tables = web.collect_markets(spark, use, start, end, **fetchers)
    if out:
        for name, df in tables.items():
            files.save(df, f"{out}/{name}_{start}_{end}", "csv")
    return tables


def code_version() -> str:
    """The checked-out commit, where the code lies in a checkout."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def precompute(auctions: DataFrame, market_index: DataFrame, features: DataFrame | None, out: str, config: dict | None = None, inputs: list[str] | None = None) -> dict:
    """Writes monthly and state-of-charge tables of each strategy, partitioned by it, and a
    manifest of parameters, code version, inputs' times, summaries and model metrics."""
    c = load_config() | (config or {})
    spark = auctions.sparkSession
    bounds = date_bounds(auctions, market_index).first()
    start, end = str(bounds["start"]), str(bounds["end"])
    cells = bt.reference_cells(spark, initial_soc=c["initial_soc"])
    options = {"start": start, "end": end, "method": c["method"], "horizon": c["horizon"]}
    runs = {"perfect": bt.perfect_foresight(auctions, market_index, cells, **options), "naive": bt.forecast_driven(auctions, market_index, cells, **options)}
    manifest: dict = {"created": datetime.now(timezone.utc).isoformat(), "start": start, "end": end, "version": code_version(), "inputs": files.modified(spark, inputs or []), "parameters": c, "summary": {}}
    if features is not None:
        model, metrics, data = forecast.train(features, c["model"], c["test_start"], **c.get("model_options", {}))
        prices = forecast.predict_prices(model, data)
        runs["ml"] = bt.forecast_driven(auctions, market_index, cells, "ml", prices, **options)
        manifest["metrics"] = {r["part"]: r.asDict() for r in forecast.rounded_metrics(metrics).collect()}
    for name, run in runs.items():
        run.monthly.withColumn("strategy", F.lit(name)).write.mode("overwrite").parquet(f"{out}/monthly/strategy={name}")
        if run.soc is not None:
            run.soc.write.mode("overwrite").parquet(f"{out}/soc/strategy={name}")
        manifest["summary"][name] = {r["scenario"]: r.asDict() for r in rounded(run.summary).collect()}  # a row a scenario
        run.plan.unpersist()
    files.write_manifest(spark, f"{out}/manifest.json", manifest)
    return manifest


def model_benchmark(features: DataFrame, test_start: str, kinds: tuple[str, ...] = ("rf", "xgb", "lgb", "lear"), options: dict | None = None) -> DataFrame:
    """Test metrics of each model with its error against training; the features are read once."""
    features = features.persist()
    rows = []
    for kind in kinds:
        _, m, _ = forecast.train(features, kind, test_start, **(options or {}).get(kind, {}))
        m = m.persist()
        rows.append(m.where("part = 'test'").join(F.broadcast(forecast.overfit_ratio(m))).withColumn("model", F.lit(kind)))
    return reduce(lambda a, b: a.unionByName(b), rows)


def best_model(benchmark: DataFrame, metric: str = "rmse", least: bool = True) -> DataFrame:
    return best_of(benchmark, metric, "model", least)


def revenue_benchmark(auctions: DataFrame, market_index: DataFrame, features: DataFrame, test_start: str, kinds: tuple[str, ...] = ("rf", "xgb", "lgb", "lear"), options: dict | None = None, **run) -> DataFrame:
    """Every model's back-test against perfect foresight and the naive forecast."""
    cells = bt.reference_cells(auctions.sparkSession)
    runs = {"perfect": bt.perfect_foresight(auctions, market_index, cells, **run), "naive": bt.forecast_driven(auctions, market_index, cells, **run)}
    for kind in kinds:
        model, _, data = forecast.train(features, kind, test_start, **(options or {}).get(kind, {}))
        runs[kind] = bt.forecast_driven(auctions, market_index, cells, "ml", forecast.predict_prices(model, data), **run)
    return bt.re.compare({k: r.summary for k, r in runs.items()})


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Collect, prepare and precompute.")
    jobs = p.add_subparsers(dest="job", required=True)
    one = {name: jobs.add_parser(name, help=text) for name, text in (("collect", "raw tables from the configured sources"), ("prepare", "processed tables from raw files"), ("precompute", "back-tests from processed tables"))}
    for name, parser in one.items():
        parser.add_argument("--config")
        parser.add_argument("--start")
        parser.add_argument("--end")
        parser.add_argument("--out", required=name != "collect")
        if name != "collect":
            parser.add_argument("--data", required=True, help="folder of the raw files, or of the processed tables")
    one["collect"].add_argument("--sources", nargs="+", choices=["auctions", "prices", "all"], default=["all"])
    one["collect"].add_argument("--no-save", action="store_true")
    one["precompute"].add_argument("--model", choices=["rf", "xgb", "lgb", "lear", "dnn", "none"], default="rf")
    a = p.parse_args(arguments)
    config = load_config(a.config)
    start, end = a.start or str(config["start"]), a.end or str(config["end"])
    spark: SparkSession = session.build()
    if a.job == "collect":
        tables = collect(spark, config, start, end, None if a.no_save else a.out or "raw", tuple(a.sources))
        print({name: df.count() for name, df in tables.items()})
        return
    if a.job == "prepare":
        print({name: df.count() for name, df in prepare(spark, a.data, a.out, start, end).items()})
        return
    names = ("auctions", "market_index", "generation_daily", "bess_fleet_capacity")
    read = lambda n: files.read_table(spark, f"{a.data}/{n}.parquet", n)
    auctions, index = read("auctions"), read("market_index")
    auctions, index = clean.date_range(auctions, "efa_date", a.start, a.end), clean.date_range(index, "settlement_date", a.start, a.end)
    features = None if a.model == "none" else feature_matrix(index, read("generation_daily"), read("bess_fleet_capacity"))
    precompute(auctions, index, features, a.out, config | {"model": a.model}, [f"{a.data}/{n}.parquet" for n in names])


if __name__ == "__main__":
    main()
