"""Session preparation, shared work folders and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import let_workers_import

#: Rows per Arrow batch: whole texts travel in them, so they stay small.
BATCH_ROWS = 512
_OWN: list[str] = []
_TABLES: dict[str, None] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep the batches of whole texts small."""
    let_workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where it is unset (tests) an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lattica-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lattica-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and a lost executor
    costs nothing of it. The table lasts until ``discard`` or the end of the driver."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _TABLES:
        atexit.register(_clear, spark)
    _TABLES[path] = None
    out._lattica_path = path
    release(spark)
    return out


def path_of(table: DataFrame) -> str:
    """Where ``written`` wrote a table."""
    return table._lattica_path


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once no plan reads it any more."""
    for table in tables:
        _delete(table.sparkSession, table._lattica_path)
        _TABLES.pop(table._lattica_path, None)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clear(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None:  # the session ended before the driver; local folders can still go
        for path in _TABLES:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file:").replace("///", "/"), ignore_errors=True)
        return
    for path in list(_TABLES):
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more go when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, none of which ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n = 0
        while (own := f"__{name}_{n}") in taken:
            n += 1
        taken.add(own)
        out.append(own)
    return out


#: A key is hot beyond so many rows, or beyond the share 1 / ``MOST_HOT`` of all rows where that is more.
HOT_ROWS, MOST_HOT = 20_000, 20_000


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` on ``keys``, where some keys may have any share of all rows.

    ``sizes``, a written table of one row a key, has in its column ``size`` how many rows have that key; it is ``facts`` itself where that has one row a key. The rows
    of a hot key go to several tasks, and the facts of that key to each. Sizes add up to all rows, so fewer
    than ``MOST_HOT`` keys exceed that share of them: that bounds what is broadcast, whatever the data. Key columns are not null.
    """
    own = facts if sizes is None else sizes
    total = own.agg(F.sum(size)).first()[0] or 0
    limit = max(HOT_ROWS, total // MOST_HOT)
    crowded = own.filter(F.col(size) > limit)
    if not crowded.limit(1).count():
        return rows.join(facts, keys, how)
    tasks, task = fresh(rows.join(facts, keys), "tasks", "task")
    crowded = F.broadcast(crowded.select(*keys, F.ceil(F.col(size) / limit).cast("int").alias(tasks)))
    rest = [c for c in rows.columns if c not in keys]
    number = F.when(F.col(tasks).isNull(), 0).otherwise(F.pmod(F.xxhash64(*rest), F.col(tasks))).cast("int")
    spread = rows.join(crowded, keys, "left").withColumn(task, number)
    many = facts.join(crowded, keys, "left").withColumn(task, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(tasks), F.lit(1)) - 1))).drop(tasks)
    return spread.join(many, [*keys, task], how).drop(tasks, task)


def blocks_for(rows: int, each: int, least: int = 1) -> int:
    return max(least, -(-int(rows) // each))


def hex16(column) -> F.Column:
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
