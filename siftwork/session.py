"""Session set-up and reliable lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


#: Intermediate tables by application, for release().
_written: dict[str, list[str]] = {}


def get_session(app: str = "siftwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs were planned for.

    On a cluster the master and the memory come from spark-submit; only a local
    run passes ``master``, and then the partition count follows the cores.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(DEFAULTS)
    if master:
        builder = builder.master(master)
        settings["spark.sql.shuffle.partitions"] = str(_local_cores(master))
        settings["spark.ui.enabled"] = "false"
        settings["spark.driver.memory"] = os.environ.get("SIFTWORK_DRIVER_MEMORY", "8g")
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    it need not be installed on every node."""
    sc = spark.sparkContext
    if getattr(sc, "_siftwork_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="spark-siftwork-"), "siftwork"), "zip",
        os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(archive)
    sc._siftwork_shipped = True


def _local_cores(master: str) -> int:
    inside = master.partition("[")[2].rstrip("]")
    return int(inside) if inside.isdigit() else (os.cpu_count() or 4)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``.  A folder of our own is
    made only for a local master, where every task sees the same disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-siftwork-")
    sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder, which release() clears."""
    name = uuid.uuid4().hex
    _written.setdefault(spark.sparkContext.applicationId, []).append(name)
    return f"{checkpoint_folder(spark).rstrip('/')}/tables/{name}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage behind it and survives the loss of executors.
    It is a Parquet table, so later steps read only the columns they use and
    plan with its real size."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session, through Spark's own file
    system so that any shared folder works.  Call it when the results are written."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/tables"
    for name in _written.pop(spark.sparkContext.applicationId, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before a compute-heavy step, when the input is too
    small to be split that far by itself.

    The size comes from the plan's statistics, so nothing runs.  Large inputs
    are left alone: their files already make more tasks than cores, and moving
    them would cost a shuffle."""
    spark = df.sparkSession
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter", "Generate"):
        node = node.children().head()
    if node.nodeName().startswith("Repartition"):
        return df  # spread before, by a caller
    cores = max(spark.sparkContext.defaultParallelism, 1)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if size >= cores * split else df.repartition(cores)
