"""File sources and sinks: schemas given, never inferred; a missing path is an empty table."""

from __future__ import annotations

import csv
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import parse_day
from ..functions.constants import PROJECT_ALIASES
from ..functions.numbers import clean_doubles, number
from ..schemas import PROCESSED_NAMES, TABLES
from .workbook import Workbook

FORMATS = ("csv", "parquet")


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or "")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A processed table in the names used here, with every column of its schema; NaN is null."""
    want = spark.createDataFrame([], TABLES[name])
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return want
    df = df.withColumnsRenamed(PROCESSED_NAMES[name])
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.schema.fields]
    return clean_doubles(df.select(*cols))


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Any file of a known format; an unknown format or a missing path is an error."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.format(kind).options(**({"header": True} if kind == "csv" else {})).load(path)
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(path) from e
        raise


def save(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Writes over a path, with the format's ending added if it lacks it."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    path = path if path.endswith(f".{kind}") else f"{path}.{kind}"
    w = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
    return path


def read_csvs(spark: SparkSession, path: str, schema: str, rank: int = 0) -> DataFrame:
    """CSV files of a glob, with what orders them: source_rank, the file and the row in it."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.withColumns({"source_rank": F.lit(rank), "file_path": F.col("_metadata.file_path"), "row_seq": F.monotonically_increasing_id()})


def read_json_records(spark: SparkSession, path: str, record_schema: str, key: str = "data") -> DataFrame:
    """The records under `key` (a dotted path) of JSON documents, as an API returns them."""
    outer = record_schema
    for part in reversed(key.split(".")):
        outer = f"{part} array<struct<{outer}>>" if outer is record_schema else f"{part} struct<{outer}>"
    df = spark.read.option("multiLine", True).schema(outer.replace(" array<struct<", " array<struct<")).json(path)
    return df.select(F.explode(key).alias("r")).select("r.*")


def resolve_headers(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns renamed to canonical names by the first alias that matches, whatever the case
    and spacing; the rest stay."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {name: next((have[a] for a in options if a in have), None) for name, options in (aliases or PROJECT_ALIASES).items()}
    return df.withColumnsRenamed({c: name for name, c in found.items() if c})


def _known_names(names: list) -> int:
    """How many of the register's columns a header holds."""
    have = {str(n).strip().lower() for n in names if n}
    return sum(any(a in have for a in options) for options in PROJECT_ALIASES.values())


#: Rows that the header of a project register may stand in, from 0.
HEADER_ROWS = (0, 4)


def _named(header: list) -> list[str]:
    """Header cells as column names, none empty, none twice."""
    out: list[str] = []
    for i, n in enumerate(header):
        name = str(n).strip() if n else f"_c{i}"
        out.append(name if name.lower() not in {x.lower() for x in out} else f"{name}_{i}")
    return out


def read_workbook(spark: SparkSession, path: str, sheet: str = "REPD") -> DataFrame:
    """A project register in a workbook: the named sheet if there is one, then the others; the
    first whose first or fifth row is a header."""
    data = spark.read.format("binaryFile").load(path).select("content").first()
    if data is None:
        raise FileNotFoundError(path)
    book = Workbook(bytes(data["content"]))
    for name in sorted(book.sheets, key=lambda n: n != sheet):
        rows = list(book.rows(name))
        for skip in HEADER_ROWS:
            if skip < len(rows) and _known_names(rows[skip]) >= 2:
                names = _named(rows[skip])
                body = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[skip + 1 :] if any(r)]
                return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))
    raise ValueError(f"no known header in {path}: {', '.join(book.sheets)}")


def _read_register(spark: SparkSession, path: str) -> DataFrame:
    """The register as CSV."""
    head = [r[0] for r in spark.read.text(path).limit(max(HEADER_ROWS) + 1).collect()]
    for skip in HEADER_ROWS:
        names = next(csv.reader(head[skip : skip + 1]), []) if skip < len(head) else []
        if _known_names(names) < 2:
            continue
        schema = ", ".join(f"`{n}` string" for n in _named(names))
        if not skip:
            return spark.read.csv(path, schema=schema, header=True, multiLine=True, enforceSchema=True)
        # The lines above the data are told by their whole text, the blank ones among them by that.
        lines = spark.read.text(path).where(~F.col("value").isin(head[: skip + 1]) & (F.trim("value") != ""))
        return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")
    raise ValueError(f"no known header in {path}")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The project register, a workbook or CSV, whose header is its first row or its fifth: the
    one with two known columns or more. Columns in their canonical names, the capacity as a
    number and the date of operation as a date; what is neither is null."""
    df = resolve_headers(read_workbook(spark, path) if path.lower().endswith(".xlsx") else _read_register(spark, path))
    typed = {"installed_capacity_mw": number("installed_capacity_mw"), "operational_date": parse_day("operational_date")}
    return df.withColumns({c: v.alias(c) for c, v in typed.items() if c in df.columns})


def modified(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """When each input file was last changed; paths that are missing have no entry."""
    out = {}
    for path in paths:
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max("modificationTime").cast("string").alias("t")).first()
        except AnalysisException as e:
            if not _missing(e):
                raise
            continue
        if found["t"]:
            out[path.rstrip("/").rpartition("/")[2]] = found["t"]
    return out


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """One JSON document, on the file system that the tables are on."""
    text = json.dumps(manifest, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest as it was written; without one an empty one."""
    try:
        row = spark.read.text(path).first()
    except AnalysisException as e:
        if not _missing(e):
            raise
        return {}
    return json.loads(row["value"]) if row else {}


def load_result(spark: SparkSession, out: str, table: str, strategy: str) -> DataFrame | None:
    """A back-test's table, monthly or soc, of one strategy, months as dates; None if there is none."""
    try:
        df = spark.read.parquet(f"{out}/{table}/strategy={strategy}")
    except AnalysisException as e:
        if not _missing(e):
            raise
        return None
    return df.withColumn("month", F.col("month").cast("date")) if "month" in df.columns else df
