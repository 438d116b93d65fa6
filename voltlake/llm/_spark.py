"""Session helpers: shared folder, cut lineage, bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir, ship

__all__ = ["arrow_limits", "cut", "fixed_width", "shared_dir", "table"]

ARROW_BYTES = 8 << 20
ARROW_ROWS = 4096


def arrow_limits(spark: SparkSession) -> None:
    """Bound the bytes and rows that go to a Python worker at once; a row goes whole. The frames
    that are made under these settings run later, so the session keeps them."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_width(expr, width: int = 16):
    """A bigint as lowercase hex digits of the given width."""
    return F.lower(F.lpad(F.hex(expr), width, "0"))
