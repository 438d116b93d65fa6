"""Market-data connectors as Spark Python data sources, behind a fetch function that tests and
offline runs replace. The request windows of a source are read by `streams` partitions, one by
default, which share the source's rate; a window that the server refuses is logged and skipped,
as one bad day must not lose a year, and `missing_windows` names it. What is wrong with the
answer's form is an error."""

from __future__ import annotations

import csv
import http.client
import json
import logging
import shutil
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import calendar as cal
from ..functions import constants as k
from ..functions.numbers import number
from ..operators.clean import date_range, embedded_generation
from ..schemas import AUCTIONS, EAC_RAW, PROCESSED_NAMES

log = logging.getLogger(__name__)
TIMEOUT = 30
PAGE = 32_000


def get_json(url: str, params: dict | None = None) -> dict:
    q = f"?{urllib.parse.urlencode(params)}" if params else ""
    with urllib.request.urlopen(url + q, timeout=TIMEOUT) as r:  # raises on an HTTP error
        return json.load(r)


def get_text(url: str) -> str:
    with urllib.request.urlopen(url, timeout=4 * TIMEOUT) as r:
        return r.read().decode("utf-8-sig")


def download_once(url: str, folder: str, local: str | None = None) -> str:
    """The path of a file: a local copy, else one downloaded before, else a new download."""
    if local and Path(local).exists():
        return local
    if not url:
        raise ValueError("neither a local file nor an address is given")
    target = Path(folder) / (url.split("/")[-1].split("?")[0] or "latest.xlsx")
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.part")
        with urllib.request.urlopen(url, timeout=4 * TIMEOUT) as r, open(part, "wb") as f:
            shutil.copyfileobj(r, f)
        part.rename(target)  # a download that breaks off leaves no file that passes for whole
    return str(target)


class Limiter:
    """At least 60 / per_minute seconds between calls."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.last = 60.0 / per_minute, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.gap - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()


def windows(start: str, end: str, days: int = 7) -> list[tuple[str, str]]:
    """Inclusive windows of at most `days` days."""
    a, b, out = date.fromisoformat(start), date.fromisoformat(end), []
    while a <= b:
        to = min(a + timedelta(days=days - 1), b)
        out.append((a.isoformat(), to.isoformat()))
        a = to + timedelta(days=1)
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def range_sql(resource: str, columns: list[str], column: str, start: str, end: str, order: str, product_column: str | None = None, products: list[str] | None = None) -> str:
    """The remote scan: columns, products and a half-open day range pushed to the server."""
    names = ", ".join(f'"{c}"' for c in columns) or "*"
    after = (date.fromisoformat(end) + timedelta(days=1)).isoformat()
    where = f'"{column}" >= {quoted(start)} AND "{column}" < {quoted(after)}'
    if products:
        where += f' AND "{product_column}" IN ({", ".join(map(quoted, products))})'
    return f'SELECT {names} FROM "{resource}" WHERE {where} ORDER BY "{order}" ASC'


def route_auctions(start: str, end: str) -> list[tuple[str, str, str]]:
    """(source, start, end) parts of a range: legacy results, half-hourly archive, current."""
    bounds = [("legacy", "0001-01-01", k.LEGACY_END), ("archive", k.ARCHIVE_START, k.ARCHIVE_END), ("current", k.CURRENT_START, "9999-12-31")]
    return [(name, max(start, a), min(end, b)) for name, a, b in bounds if max(start, a) <= min(end, b)]


def year_resources(listing: dict, prefix: str = "Historic Demand Data ") -> dict[int, str]:
    """Year to resource id of a package listing."""
    if not listing.get("success"):
        raise RuntimeError(f"listing failed: {listing.get('error')}")
    found = {r.get("name", ""): r["id"] for r in listing["result"]["resources"]}
    return {int(n.removeprefix(prefix)): i for n, i in found.items() if n.startswith(prefix) and n.removeprefix(prefix).strip().isdigit()}


class Windows(InputPartition):
    """Request windows that one task reads, one after another."""

    def __init__(self, parts: list[tuple[str, str]], streams: int) -> None:
        super().__init__(tuple(parts))
        self.parts, self.streams = parts, streams


class MarketReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.options, self.names = dict(options), names

    def partitions(self):
        parts = windows(self.options["start"], self.options["end"], int(self.options.get("days", "7")))
        streams = max(1, min(int(self.options.get("streams", "1")), len(parts)))
        return [Windows(parts[i::streams], streams) for i in range(streams)]

    def read(self, partition):
        o = self.options
        limiter = Limiter(float(o.get("per_minute", "60")) / partition.streams)
        for start, end in partition.parts:
            limiter.wait()
            params = {o.get("from_name", "from"): start, o.get("to_name", "to"): end}
            try:
                records = get_json(o["url"].format(start=start, end=end), params if o.get("pass_range", "true") == "true" else None)
            except (OSError, http.client.HTTPException, json.JSONDecodeError) as e:  # network and HTTP errors, cut answers
                if o.get("on_error", "skip") == "raise":
                    raise
                log.warning("window %s to %s failed: %s", start, end, e)
                continue
            for part in o.get("records", "data").split("."):
                records = records[part]
            for r in records:
                yield tuple(None if r.get(n) is None else str(r[n]) for n in self.names)


class MarketSource(DataSource):
    """format("market").options(url=..., start=..., end=..., columns="a,b"): text columns."""

    @classmethod
    def name(cls) -> str:
        return "market"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> MarketReader:
        return MarketReader(self.options, [f.name for f in schema.fields])


def collect(spark: SparkSession, url: str, columns: list[str], start: str, end: str, **options) -> DataFrame:
    spark.dataSource.register(MarketSource)
    return spark.read.format("market").options(url=url, start=start, end=end, columns=",".join(columns), **options).load()


def missing_windows(df: DataFrame, day: str, start: str, end: str, days: int = 7) -> DataFrame:
    """start, end of the request windows of which a table has no day."""
    parts = df.sparkSession.createDataFrame(windows(start, end, days), "start string, end string")
    parts = parts.select(F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    have = df.select(F.to_date(day).alias("_day")).where("_day is not null")
    number = lambda c: F.floor(F.datediff(c, F.lit(start).cast("date")) / days)
    return parts.withColumn("_n", number(F.col("start"))).join(have.select(number(F.col("_day")).alias("_n")).distinct(), "_n", "left_anti").drop("_n")


def remote_sql(spark: SparkSession, base: str, sql: str, fetch: Callable[[str, dict], dict] = get_json) -> DataFrame:
    """Rows of a remote SQL statement; the server's text-search column is dropped."""
    body = fetch(f"{base}/datastore_search_sql", {"sql": sql})
    if not body.get("success"):
        raise RuntimeError(f"query failed: {body.get('error')}")
    return _rows(spark, body["result"]["records"])


def remote_page(spark: SparkSession, base: str, resource: str, limit: int = PAGE, offset: int = 0, sort: str | None = None, fetch: Callable[[str, dict], dict] = get_json) -> DataFrame:
    """One page of a remote table."""
    params = {"resource_id": resource, "limit": limit, "offset": offset} | ({"sort": sort} if sort else {})
    return _rows(spark, fetch(f"{base}/datastore_search", params)["result"]["records"])


def _rows(spark: SparkSession, records: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(n for r in records for n in r if n not in ("_full_text", "_id")))
    if not names:
        return spark.createDataFrame([], "_empty string").drop("_empty")
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records], ", ".join(f"`{n}` string" for n in names))


def or_empty(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """A table, or an empty one if its source fails: the network, the server, or an answer that
    is not what was asked for. Errors in the program are raised."""
    try:
        return read()
    except (OSError, http.client.HTTPException, json.JSONDecodeError, RuntimeError, KeyError) as e:
        log.warning("read failed, taken as empty: %s", e)
        return spark.createDataFrame([], schema)


def requirements(spark: SparkSession, base: str, resource: str, fetch: Callable[[str, dict], dict] = get_json) -> DataFrame:
    """A service's volume requirements: EFA_DATE as a date, the other columns as they are."""
    df = remote_page(spark, base, resource, fetch=fetch)
    return df.withColumn("EFA_DATE", cal.strict_day("EFA_DATE")) if "EFA_DATE" in df.columns else df


def legacy_auctions(spark: SparkSession, base: str, resource: str, start: str, end: str, fetch: Callable[[str, dict], dict] = get_json) -> DataFrame:
    """Results of the first platform in the names used here; what is no number or date is null."""
    sql = range_sql(resource, [], "EFA Date", start, end, "EFA Date")
    raw = remote_sql(spark, base, sql, fetch)
    have = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    own = raw.select(*(have(old).alias(new) for old, new in PROCESSED_NAMES["auctions"].items()))
    time_ = lambda c: F.expr(f"cast(try_cast(`{c}` as timestamp) as timestamp_ntz)").alias(c)
    return own.select("service", cal.parse_day("efa_date", [*cal.FORMATS, "yyyy-MM-dd'T'HH:mm:ss"]).alias("efa_date"), F.expr("try_cast(efa as int)").alias("efa"), time_("delivery_start"), time_("delivery_end"), number("volume").alias("volume"), number("price").alias("price"))


def half_hourly_auctions(spark: SparkSession, base: str, resources: dict[str, str], start: str, end: str, fetch: Callable[[str, dict], dict] = get_json) -> DataFrame:
    """Raw rows of the second platform, its archive and its current part, for the days of a range
    that each holds."""
    names = [x.split()[0] for x in EAC_RAW.split(", ")]
    out = spark.createDataFrame([], EAC_RAW)
    for part, a, b in route_auctions(start, end):
        if part in resources and part != "legacy":
            rows = remote_sql(spark, base, range_sql(resources[part], names, "deliveryStart", a, b, "deliveryStart", "auctionProduct", k.SERVICES), fetch)
            if rows.columns:
                out = out.unionByName(rows.select(*names))
    return out


def embedded_years(spark: SparkSession, base: str, dataset: str, start: str, end: str, download: str, fetch: Callable[[str, dict], dict] = get_json, fetch_text: Callable[[str], str] = get_text) -> DataFrame:
    """Embedded solar and wind generation of a range, from a CSV file a year; a year without a
    resource, or whose download fails, is logged and left out. download: the address of a file,
    with {dataset}, {resource} and {year}."""
    found = year_resources(fetch(f"{base}/package_show", {"id": dataset}))
    out = spark.createDataFrame([], "settlement_date date, settlement_period int, generation double, fuel_type string")
    for year in range(int(start[:4]), int(end[:4]) + 1):
        if year not in found:
            log.warning("no resource for %s", year)
            continue
        try:
            text = fetch_text(download.format(dataset=dataset, resource=found[year], year=year))
        except (OSError, http.client.HTTPException) as e:
            log.warning("year %s failed: %s", year, e)
            continue
        lines = text.splitlines()  # a year of half-hours
        names = [x.strip().upper() for x in next(csv.reader(lines[:1]))]
        rows = spark.createDataFrame([(x,) for x in lines[1:] if x.strip()], "value string")
        wide = rows.select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names)).alias("r")).select("r.*")
        out = out.unionByName(embedded_generation(wide))
    return date_range(out, "settlement_date", start, end)


def collect_markets(spark: SparkSession, config: dict, start: str, end: str, fetch: Callable[[str, dict], dict] = get_json, fetch_text: Callable[[str], str] = get_text) -> dict[str, DataFrame]:
    """Every table that the configuration names a source for. A table whose source fails is empty
    and logged, so that one failure doesn't lose the rest."""
    data, out = config.get("auction_api") or {}, {}
    base, ids = data.get("base_url"), data.get("resources") or {}
    if base:
        limiter = Limiter(float(data.get("rate_limit", 2)))

        def paced(url: str, params: dict) -> dict:
            limiter.wait()
            return fetch(url, params)

        parts = {x for x, _, _ in route_auctions(start, end)}
        if "legacy" in parts and "legacy" in ids:
            a, b = next((a, b) for x, a, b in route_auctions(start, end) if x == "legacy")
            out["auction_results"] = or_empty(lambda: legacy_auctions(spark, base, ids["legacy"], a, b, paced), spark, AUCTIONS)
        if parts & {"archive", "current"} & set(ids):
            out["eac_results"] = or_empty(lambda: half_hourly_auctions(spark, base, ids, start, end, paced), spark, EAC_RAW)
        for name in ("dr_requirements", "dm_requirements"):
            if name in ids:
                out[name] = or_empty(lambda n=name: requirements(spark, base, ids[n], paced), spark, "EFA_DATE date")
        if data.get("demand_dataset") and data.get("demand_download"):
            empty = "settlement_date date, settlement_period int, generation double, fuel_type string"
            out["embedded_solar_wind"] = or_empty(lambda: embedded_years(spark, base, data["demand_dataset"], start, end, data["demand_download"], paced, fetch_text), spark, empty)
    market = config.get("price_api") or {}
    for name, source in (market.get("endpoints") or {}).items():
        rate = {"per_minute": str(market.get("rate_limit", 60))}
        out[name] = collect(spark, market["base_url"] + source["path"], source["columns"].split(","), start, end, **rate, **{k_: str(v) for k_, v in (source.get("options") or {}).items()})
    return out
