"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Hour, day and weekday keys are UTC based, whatever the session default is."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine) gets a folder of its own; a cluster is refused, as each executor
    would write to its own disk.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="barloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders of the steps written since the outermost ``only_result`` began, one list a nesting level.
_STEPS: list[list[str]] = []


def only_result(spark: SparkSession, job: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``job``; the steps that it wrote on the way are deleted."""
    _STEPS.append([])
    try:
        out = cut_lineage(job())
    finally:
        steps = _STEPS.pop()
        kept = steps.pop() if steps else None  # the result is the last one written
        for path in steps:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if _STEPS and kept:
            _STEPS[-1].append(kept)
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and go on from the written table.

    Later steps read a step several times (totals, then rows). Without the cut each reading would
    re-run the whole history, scanning the ticks again; executors may be lost, the table stays.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if _STEPS:
        _STEPS[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
