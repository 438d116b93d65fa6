import datetime as dt
import http.server
import json
import math
import threading
import time
import zipfile
from typing import ClassVar

import pytest

from voltlake.plans import jobs
from voltlake.sources import files, http as web
from voltlake.sources.config import load_config
from voltlake.streaming import market as live


def test_windows_and_routing():
    assert web.windows("2024-01-01", "2024-01-15") == [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-15")]
    assert [x[0] for x in web.route_auctions("2023-10-01", "2025-04-02")] == ["legacy", "archive", "current"]
    assert web.route_auctions("2024-01-01", "2024-01-02") == [("archive", "2024-01-01", "2024-01-02")]
    assert web.year_resources({"success": True, "result": {"resources": [{"name": "Historic Demand Data 2020", "id": "a"}, {"name": "Notes", "id": "b"}]}}) == {2020: "a"}
    sql = web.range_sql("r", ["a"], "d", "2024-01-01", "2024-01-31", "d", "p", ["x'y"])
    assert '"d" < \'2024-02-01\'' in sql and "'x''y'" in sql


def test_limiter():
    now, slept = [0.0], []
    lim = web.Limiter(2, lambda: now[0], slept.append)
    lim.wait()
    now[0] = 10.0
    lim.wait()
    assert slept == [20.0]


def test_remote_rows(spark):
    body = {"success": True, "result": {"records": [{"_id": 1, "a": 1, "_full_text": "x"}, {"a": None, "b": "q"}]}}
    assert [tuple(r) for r in web.remote_sql(spark, "u", "select", lambda u, p: body).collect()] == [("1", None), (None, "q")]
    assert web.remote_page(spark, "u", "r", fetch=lambda u, p: {"result": {"records": []}}).count() == 0
    with pytest.raises(RuntimeError):
        web.remote_sql(spark, "u", "x", lambda u, p: {"success": False})
    assert web.or_empty(lambda: web.remote_sql(spark, "u", "x", lambda u, p: {"success": False}), spark, "a int").count() == 0
    with pytest.raises(ZeroDivisionError):
        web.or_empty(lambda: 1 / 0, spark, "a int")


@pytest.fixture()
def server():
    """A server of one record a window; it refuses the second week of 2024 and counts calls."""

    class Handler(http.server.BaseHTTPRequestHandler):
        calls: ClassVar[list] = []

        def do_GET(self):
            self.calls.append((time.monotonic(), self.path))
            ok = "from=2024-01-08" not in self.path
            self.send_response(200 if ok else 500)
            self.end_headers()
            if ok:
                self.wfile.write(b"binary" if "file" in self.path else json.dumps({"data": [{"price": 5.5, "day": self.path[-10:]}]}).encode())

        def log_message(self, *a):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", Handler.calls
    s.shutdown()


def test_market_source_skips_a_failed_window(spark, server):
    url, calls = server
    df = web.collect(spark, f"{url}/x", ["price", "day"], "2024-01-01", "2024-01-15", per_minute="300")
    assert sorted(map(tuple, df.collect())) == [("5.5", "2024-01-07"), ("5.5", "2024-01-15")]
    assert len(calls) == 3 and min(b[0] - a[0] for a, b in zip(calls, calls[1:])) > 0.12  # the limit holds over all windows
    assert df.rdd.getNumPartitions() == 1
    gaps = web.missing_windows(df, "day", "2024-01-01", "2024-01-15")
    assert [(str(r.start), str(r.end)) for r in gaps.collect()] == [("2024-01-08", "2024-01-14")]
    with pytest.raises(Exception, match="500"):
        web.collect(spark, f"{url}/x", ["price"], "2024-01-08", "2024-01-09", per_minute="6000", on_error="raise").collect()
    with pytest.raises(Exception, match="other"):  # a wrong form is an error
        web.collect(spark, f"{url}/x", ["price"], "2024-01-01", "2024-01-02", per_minute="6000", records="other").collect()


def test_download_once(tmp_path, server):
    url, calls = server
    path = web.download_once(f"{url}/file.xlsx?x=1", str(tmp_path / "cache"))
    assert path.endswith("cache/file.xlsx") and open(path, "rb").read() == b"binary"
    assert web.download_once(f"{url}/file.xlsx?x=1", str(tmp_path / "cache")) == path and len(calls) == 1
    assert web.download_once(url, "none", path) == path
    with pytest.raises(ValueError):
        web.download_once("", str(tmp_path))


def test_collected_tables(spark, tmp_path):
    legacy = [{"_id": 1, "Service": "DCH", "EFA Date": "2023-10-30T00:00:00", "EFA": "2", "Cleared Volume": "3", "Clearing Price": "x"}]
    eac = [{"auctionProduct": "DCL", "deliveryStart": "2024-01-01T03:00:00", "deliveryEnd": "", "clearedVolume": 1, "clearingPrice": 9}]
    asked = []

    def fetch(url, params):
        asked.append((url, params))
        if url.endswith("package_show"):
            return {"success": True, "result": {"resources": [{"name": "Historic Demand Data 2023", "id": "y23"}, {"name": "Historic Demand Data 2024", "id": "y24"}]}}
        if url.endswith("datastore_search_sql"):
            return {"success": "r3" not in params["sql"], "result": {"records": legacy if '"r1"' in params["sql"] else eac}}
        return {"result": {"records": [{"EFA_DATE": "2024-01-05", "x": 1}]}}

    def fetch_text(url):
        if "2024" in url:
            raise OSError("gone")
        return " settlement_date ,SETTLEMENT_PERIOD,EMBEDDED_SOLAR_GENERATION,EMBEDDED_WIND_GENERATION,TSD\n30-Dec-2023,1,5,7,9\n28/10/2023,2,1,1,1\n"

    api = {"base_url": "u", "rate_limit": 60_000, "resources": {"legacy": "r1", "archive": "r2", "current": "r3", "dr_requirements": "q"}, "demand_dataset": "d", "demand_download": "u/{dataset}/{resource}/{year}"}
    got = jobs.collect(spark, {"auction_api": api}, "2023-10-30", "2024-01-02", str(tmp_path), fetch=fetch, fetch_text=fetch_text)
    assert set(got) == {"auction_results", "eac_results", "dr_requirements", "embedded_solar_wind"}
    row = got["auction_results"].first()
    assert (row.service, str(row.efa_date), row.efa, row.volume, row.price) == ("DCH", "2023-10-30", 2, 3.0, None)
    assert [r.auctionProduct for r in got["eac_results"].collect()] == ["DCL"]
    assert str(got["dr_requirements"].first().EFA_DATE) == "2024-01-05"
    assert sorted((r.fuel_type, r.generation) for r in got["embedded_solar_wind"].collect()) == [("EMBEDDED_WIND", 7.0), ("SOLAR", 5.0)]
    assert any("AND" in p.get("sql", "") and "'DCH'" in p["sql"] for _, p in asked)
    made = jobs.prepare(spark, str(tmp_path), str(tmp_path / "out"), "2023-01-01", "2024-01-31")
    assert set(made) == {"auctions", "generation_daily"}
    assert [(r.service, r.price) for r in files.read_table(spark, f"{tmp_path}/out/auctions.parquet", "auctions").orderBy("service").collect()] == [("DCH", None), ("DCL", 9.0)]
    assert jobs.collect(spark, {"auction_api": api}, "2024-01-01", "2024-01-02", None, ("prices",)) == {}
    with pytest.raises(ValueError):
        jobs.collect(spark, {}, "2024-01-01", "2024-01-02", None, ("x",))


def test_prepare_all_tables(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "market_index_a.csv").write_text("settlementDate,settlementPeriod,dataProvider,price,volume,startTime\n2024-01-01,1,APXMIDP,30,2,2024-01-01T00:00:00Z\n2024-01-01,1,APXMIDP,31,2,\n")
    (raw / "market_index_b.csv").write_text("settlementDate,settlementPeriod,dataProvider,price,volume,startTime\n2024-01-01,1,APXMIDP,99,2,\n2024-01-01,2,APXMIDP,bad,2,\n")
    (raw / "system_prices.csv").write_text("settlementDate,settlementPeriod,systemSellPrice,systemBuyPrice,note\n01/02/2024,3,4.5,5.5,x\n")
    (raw / "generation_by_fuel.csv").write_text("settlementDate,settlementPeriod,fuelType,generation\n2024-01-01,1,CCGT,5\n2024-01-01,1,CCGT,6\n2024-01-01,2,OCGT,1\n")
    (raw / "repd.csv").write_text("Technology Type,Installed Capacity (MWelec),Development Status,Operational\nBattery,50,Operational,15/01/2024\nBattery,x,Operational,15/01/2024\n")
    made = jobs.prepare(spark, str(raw), str(tmp_path / "out"), "2024-01-01", "2024-02-29")
    read = lambda n: files.read_table(spark, f"{tmp_path}/out/{n}.parquet", n).collect()
    assert set(made) == {"market_index", "system_prices", "generation_daily", "bess_fleet_capacity"}
    assert sorted((r.settlement_period, r.price) for r in read("market_index")) == [(1, 30.0), (2, None)]
    assert [(str(r.settlement_date), r.sell_price, r.buy_price) for r in read("system_prices")] == [("2024-02-01", 4.5, 5.5)]
    assert [(r.fuel_group, r.generation) for r in read("generation_daily")] == [("Gas", 6.0)]
    assert min((str(r.month), r.fleet_mw) for r in read("bess_fleet_capacity")) == ("2024-01-01", 50.0)


def workbook(path, sheets):
    """A minimal workbook: shared strings, a date style, rows of cells."""
    strings, parts = [], []
    for rows in sheets.values():
        xml = ""
        for i, row in enumerate(rows, 1):
            cells = ""
            for k, v in enumerate(row):
                at = f"{chr(65 + k)}{i}"
                if isinstance(v, str):
                    strings.append(v)
                    cells += f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
                elif isinstance(v, dt.date):
                    cells += f'<c r="{at}" s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
                elif v is not None:
                    cells += f'<c r="{at}"><v>{v}</v></c>'
            xml += f'<row r="{i}">{cells}</row>' if cells else ""
        parts.append(xml)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, xml in enumerate(parts):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{xml}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    header = ["Technology Type", "Installed Capacity (MWelec)", "Development Status", "Operational"]
    rows = [["Register"], [], [], [], header, ["Battery", 49.5, "Operational", dt.date(2024, 1, 15)], [], ["Wind", "x", "Operational", None]]
    workbook(tmp_path / "a.xlsx", {"Notes": [["nothing", "here"]], "REPD": rows})
    got = files.read_projects(spark, str(tmp_path / "a.xlsx")).collect()
    assert [(r.technology_type, r.installed_capacity_mw, str(r.operational_date)) for r in got] == [("Battery", 49.5, "2024-01-15"), ("Wind", None, "None")]
    workbook(tmp_path / "b.xlsx", {"Other": rows[4:]})
    assert files.read_projects(spark, str(tmp_path / "b.xlsx")).count() == 2
    workbook(tmp_path / "c.xlsx", {"REPD": [["a", "b"]]})
    with pytest.raises(ValueError):
        files.read_projects(spark, str(tmp_path / "c.xlsx"))


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("data_collection:\n  start_date: '2019-01-01'\n  end_date: 2024-10-24\nhorizon: 12\nauction_api: {rate_limit: 2}\n")
    c = load_config(str(path), {"horizon": 96, "model": "rf", "auction_api": {"base_url": "u"}})
    assert (c["start"], c["end"], c["horizon"], c["model"]) == ("2019-01-01", "2024-10-24", 12, "rf")
    assert c["auction_api"] == {"base_url": "u", "rate_limit": 2}


def test_tables(spark, tmp_path):
    assert files.read_table(spark, f"{tmp_path}/none", "auctions").count() == 0
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 3, "APXMIDP", float("nan"))], "settlementDate date, settlementPeriod int, dataProvider string, price double")
    path = files.save(df, f"{tmp_path}/market_index")
    r = files.read_table(spark, path, "market_index").first()
    assert path.endswith(".parquet") and r.price is None and r.provider == "APXMIDP" and not math.isnan(r.settlement_period)
    files.save(df, f"{tmp_path}/t", "csv")
    assert files.load(spark, f"{tmp_path}/t.csv", "csv").count() == 1
    with pytest.raises(FileNotFoundError):
        files.load(spark, f"{tmp_path}/no")
    with pytest.raises(ValueError):
        files.load(spark, "x", "pickle")


def test_project_register(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,,\nx,,\ny,,\nz,,\nTechnology Type,Installed Capacity (MWelec),Development Status\nBattery,5,Operational\n")
    (tmp_path / "b.csv").write_text(" Technology ,MWelec,Status\nBattery,7,Planned\n")
    assert [(r.technology_type, r.installed_capacity_mw) for r in files.read_projects(spark, str(tmp_path / "a.csv")).collect()] == [("Battery", 5.0)]
    assert [(r.technology_type, r.development_status) for r in files.read_projects(spark, str(tmp_path / "b.csv")).collect()] == [("Battery", "Planned")]


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"a": 1}, {"a": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"result": {"records": [{"a": 3}]}}))
    assert [r.a for r in files.read_json_records(spark, str(tmp_path / "a.json"), "a int").collect()] == [1, 2]
    assert [r.a for r in files.read_json_records(spark, str(tmp_path / "b.json"), "a int", "result.records").collect()] == [3]


def test_precompute(spark, tmp_path):
    d = dt.date(2024, 1, 1)
    prices = spark.createDataFrame([(d + dt.timedelta(days=i), sp, "APXMIDP", float(20 + sp)) for i in range(2) for sp in range(1, 49)], "settlement_date date, settlement_period int, provider string, price double")
    legacy = spark.createDataFrame([("DCH", d, 2, None, None, 1.0, 5.0)], "service string, efa_date date, efa int, delivery_start timestamp_ntz, delivery_end timestamp_ntz, volume double, price double")
    eac = spark.createDataFrame([("DCH", "2024-01-01T03:00:00", "1", "9"), ("DCL", "2024-01-02T03:00:00", "1", "9")], "auctionProduct string, deliveryStart string, clearedVolume string, clearingPrice string")
    auctions = jobs.prepare_auctions(legacy, eac)
    assert sorted((r.service, r.price) for r in auctions.collect()) == [("DCH", 5.0), ("DCL", 9.0)]
    m = jobs.precompute(auctions, prices, None, str(tmp_path), {"horizon": 8})
    assert set(m["summary"]) == {"perfect", "naive"} and m["start"] == "2024-01-01"
    assert files.read_manifest(spark, f"{tmp_path}/manifest.json").count() == 1
    assert files.load_manifest(spark, f"{tmp_path}/manifest.json")["version"] and files.load_manifest(spark, f"{tmp_path}/none") == {}
    assert files.load_result(spark, str(tmp_path), "soc", "naive").count() > 0 and files.load_result(spark, str(tmp_path), "soc", "ml") is None
    assert files.load_result(spark, str(tmp_path), "monthly", "perfect").first().month == d
    assert set(files.modified(spark, [f"{tmp_path}/monthly", f"{tmp_path}/none"])) == {"monthly"}
    assert spark.read.parquet(f"{tmp_path}/soc").where("strategy = 'perfect'").count() == 96


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), float(m), "u", 10.0) for m in (0, 10, 40)]
    spark.createDataFrame(rows, "ts timestamp, value double, unit string, mwh double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, value double, unit string, mwh double").parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted((r.n, r.price) for r in run(live.half_hours(stream), "half", "complete")) == [(1, 40.0), (2, 5.0)]
    assert sorted(r.soc_frac for r in run(live.state_of_charge(stream), "soc", "append")) == [pytest.approx(0.6), pytest.approx(0.7), pytest.approx(0.8)]
    assert len(run(live.first_of_key(stream, ["unit"]), "first", "append")) == 1


def test_sliding_mean_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(t + dt.timedelta(days=d), "DCH", float(d)) for d in (0, 1, 2, 40)]
    spark.createDataFrame(rows, "ts timestamp, service string, price double").write.parquet(f"{tmp_path}/in")
    stream = live.sliding_mean(spark.readStream.schema("ts timestamp, service string, price double").parquet(f"{tmp_path}/in"), days=2)
    q = stream.writeStream.format("memory").queryName("sliding").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r.day): r.trend for r in spark.table("sliding").collect()}
    assert {k: got[k] for k in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04")} == {"2024-01-01": 0.0, "2024-01-02": 0.5, "2024-01-03": 1.5, "2024-01-04": 2.0}
