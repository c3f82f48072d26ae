"""Session helpers: defaults, shared scratch folder, checked broadcast."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when Catalyst's own size estimate stays below this.
SMALL_SIDE_BYTES = 32 * 1024 * 1024


def _temporary() -> str:
    """A folder of this machine that goes when the process ends."""
    path = tempfile.mkdtemp(prefix="tallygrid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallygrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", _temporary())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir`` of the session.

    A local session that names none gets a temporary folder; on a cluster that is an error, since each
    executor would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _temporary()
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_PATHS: list[str] = []


def drop_scratch(spark: SparkSession) -> None:
    """Remove the folders that this process has made below the shared folder; tables read from them are gone."""
    while _PATHS:
        p = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    _PATHS.append(os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}"))
    return _PATHS[-1]


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a result once and read it back, so that lost executors re-read files
    instead of recomputing the lineage and several consumers share one computation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = SMALL_SIDE_BYTES) -> DataFrame:
    """Broadcast hint only when the estimate proves the side small; otherwise the plain
    frame, which Spark joins by sort-merge with skew handling."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
