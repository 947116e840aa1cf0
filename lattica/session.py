"""Sessions whose Python workers know this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where it is unset (tests on one machine) an own one, gone at the end."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lattica-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def short_list(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast, after its size was checked: more than ``most`` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"this list is to have at most {most} rows")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Put the folder of this package on the path of the Python workers; on a cluster it is installed or shared."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return spark
