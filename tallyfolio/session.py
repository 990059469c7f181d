"""Session helpers.  The cluster's own settings always win over ours."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "tallyfolio") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    n = str(cpus)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if n == "*" else n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, a local one only in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tallyfolio-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows that a task of a sort, window or join over wide rows gets at most (a few hundred MB with all its operators).
TASK_ROWS = 1 << 18


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for `rows` rows: their number follows the rows, so a task's memory does not grow with the input."""
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // TASK_ROWS), min(session, -(-rows // (TASK_ROWS >> 4))))


def materialize_dealt(df: DataFrame, name: str, key: str, tasks: int, dealt: bool = False) -> DataFrame:
    """The same in `tasks` buckets of `key`: groupings, windows and joins by it need no shuffle any more.

    `dealt`: the rows lie so already, in as many partitions (others are right too, but write many small files).
    """
    label = f"{name}-{uuid.uuid4().hex}"
    table = "tallyfolio_" + label.replace("-", "_")
    rows = df if dealt else df.repartition(tasks, key)
    written = rows.write.option("path", f"{shared_folder(df.sparkSession)}/{label}")
    written.format("parquet").bucketBy(tasks, key).saveAsTable(table)
    _free_shuffles(df.sparkSession)
    return df.sparkSession.table(table)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and continue from it.

    Used where several later steps read the same rows: lineage is cut, a lost
    executor costs a re-read instead of a re-parse, and later scans still prune
    columns and push filters down.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _free_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the driver collects what refers to them: after a write those behind it are not needed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
