"""Session settings that the queries rely on, the folder that a cluster shares, and what is sent
to its workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", app: str = "voltlake", partitions: int = 8) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app).config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false")
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the folder that
    the context checkpoints to. Only with a local master, as in tests, a folder of this process;
    on a cluster such a folder would be another one on every machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _LOCAL.get(sc.applicationId) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="voltlake-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL[sc.applicationId] = path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later reads neither recompute it
    nor depend on an executor that may be lost."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/voltlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, unless they find it on
    their own: by PYTHONPATH, or in the folder that they start in."""
    root = Path(__file__).resolve().parents[1]
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)] + [Path.cwd()]
    app = spark.sparkContext.applicationId
    if root in known or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="voltlake-")  # the driver serves it to the executors
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/voltlake", "zip", root, "voltlake"))
