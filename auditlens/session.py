"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

READ_TASKS = "auditlens.read.tasks"
_LOCAL: dict[str, str] = {}


def build_session(app: str = "auditlens", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(READ_TASKS, str(2 * (int(cores) if cores.isdigit() else os.cpu_count() or 1)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the source line of every column call makes large plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows over as many tasks as the session asks for in READ_TASKS; without it, nothing is moved.

    For sessions on small tables of one file each, where a file would be one task.
    """
    tasks = df.sparkSession.conf.get(READ_TASKS, None)
    return df if tasks is None or df.isStreaming else df.repartition(int(tasks))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in `spark.checkpoint.dir`.

    A local session without that setting gets a folder of its own, which goes when Python
    ends.  On a cluster it is an error: executors do not see each other's disks.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named or context.getCheckpointDir():
        return named or context.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="auditlens-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return _LOCAL["folder"]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, on whatever file system it is, is a folder; an error if nothing is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
