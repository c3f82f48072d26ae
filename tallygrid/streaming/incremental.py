"""Incremental upkeep (INC-01..08).

Streaming variants use the same operators as the batch: a keyed ``max_by`` aggregate is
maintained by Spark's state store, one row per key, and every micro-batch writes only the keys
that changed below its epoch (an overwritten epoch folder makes a repeated batch harmless)."""
from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.keyed import newest_per_key, pending
from tallygrid.session import scratch


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Stream over a parquet table, whether it is one file or a folder of files. A glob that only this
    path matches lets the source take a single file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def disk_state(spark: SparkSession):
    """While a stream starts and runs: keyed state on executor disks instead of Spark's in-memory default, since
    it holds one row per key and may exceed the memory of an executor. A provider the session has chosen
    stays, and so does the session's setting afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    if old.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def append_new_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """INC-01: files that were not processed before are appended; the checkpoint is the resume state."""
    with disk_state(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()


def new_keys_only(batch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """INC-01 / INC-02 for a batch: keys not in the output yet, repeated ones inside the batch once."""
    return pending(batch.dropDuplicates(keys), done, keys)


def drop_repeats(stream: DataFrame, key: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """INC-02: each filing once. With an event time the key state is dropped after ``delay``."""
    if time:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


# Epochs after which the rows of all are written as one.
COMPACT_EVERY = 16


def keep_state(aggregate: DataFrame, out: str, checkpoint: str, keys: list[str], every: int = COMPACT_EVERY) -> None:
    """INC-03 / INC-07: run a streaming keyed aggregate over what is available; the rows that changed
    in a micro-batch are written below its epoch. Every few epochs the newest row of each key is written as
    that epoch, and the earlier ones go. An epoch that runs again overwrites its folder; once its folder
    is complete, only the removal of earlier ones is repeated."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark, here = batch.sparkSession, f"{out}/epoch={epoch}"
        if epoch == 0 or epoch % every:
            batch.write.mode("overwrite").parquet(here)
            return
        fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = fs_path(out).getFileSystem(spark._jsc.hadoopConfiguration())
        older = [x.getPath().toString() for x in fs.listStatus(fs_path(out)) if "epoch=" in x.getPath().getName() and int(x.getPath().getName().split("=")[1]) < epoch]
        if not fs.exists(fs_path(f"{here}/_SUCCESS")):
            rows = batch.withColumn("epoch", F.lit(epoch))
            if older:
                rows = rows.unionByName(spark.read.option("basePath", out).parquet(*older))
            newest_per_key(rows, keys, ["epoch"], batch.drop(*keys).columns).select(*batch.columns).write.mode("overwrite").parquet(here)
        for p in older:
            fs.delete(fs_path(p), True)

    with disk_state(aggregate.sparkSession):
        aggregate.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current state: the newest epoch of each key."""
    x = spark.read.parquet(out)
    return newest_per_key(x, keys, ["epoch"], [c for c in x.columns if c not in (*keys, "epoch")])


def stream_latest(stream: DataFrame, keys: list[str], order: list[str], payload: list[str], label: str) -> DataFrame:
    """INC-07 end to end: keep-latest state of a stream, returned as a table."""
    spark = stream.sparkSession
    out, cp = scratch(spark, label), scratch(spark, f"{label}-cp")
    keep_state(newest_per_key(stream, keys, order, payload), out, cp, keys)
    return read_state(spark, out, keys)


def extend_series(series: DataFrame, filings: DataFrame, keys: list[str]) -> DataFrame:
    """INC-04: filings newer than each series' cursor, to be read oldest first; the caller extracts
    the values and then calls ``advance``."""
    return series.join(filings, keys).where(F.col("filed") > F.coalesce("last_source", F.lit("")))


def advance(series: DataFrame, used: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """INC-04: cursor = newest filing used."""
    top = used.groupBy(*keys, name).agg(F.max("filed").alias("_top"))
    return series.join(top, [*keys, name], "left").withColumn(
        "last_source", F.greatest("last_source", "_top")).drop("_top")


def daily_slice(state: DataFrame, key: str, today: Column, days: int = 7) -> DataFrame:
    """INC-05: the share of the pool that is due today: older than ``days``, or never fetched. With a
    daily run this settles at one ``days``-th of the pool per day."""
    return state.where(F.col("fetched_at").isNull() | (F.datediff(today, F.col("fetched_at")) >= days)).select(key)


def todays_work(pick: DataFrame, log: DataFrame, done: DataFrame, today: Column, key: str = "entity") -> DataFrame:
    """INC-06: an existing pick of today is reused, otherwise the fresh one is taken; finished keys are
    skipped. ``log``: date, entity."""
    old = log.where(F.col("date") == today).select(key)
    flag = old.agg((F.count(F.lit(1)) > 0).alias("f")).scalar()
    work = old.where(flag).unionByName(pick.select(key).where(~flag))
    return work.join(done.where(F.col("date") == today).select(key), key, "left_anti")


def outdated(rows: DataFrame, version: int) -> DataFrame:
    """INC-08: rows below the current definition version."""
    return rows.where(F.coalesce("version", F.lit(1)) < version)


def reapply(rows: DataFrame, rerun: DataFrame, keys: list[str], version: int, keep: list[str]) -> DataFrame:
    """INC-08: replace outdated rows by their re-run; the ``keep`` fields survive a null re-run value."""
    r = rerun.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in rerun.columns if c not in keys], F.lit(True).alias("_hit"))
    x = rows.join(r, keys, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & (F.coalesce("version", F.lit(1)) < version))
    for c in rerun.columns:
        if c not in keys:
            new = F.coalesce(f"_r_{c}", c) if c in keep else F.col(f"_r_{c}")
            x = x.withColumn(c, F.when(F.col("_hit"), new).otherwise(F.col(c)))
    x = x.withColumn("version", F.when(F.col("_hit"), F.lit(version)).otherwise(F.col("version")))
    return x.select(*rows.columns)


def run_batches(batches: list[DataFrame], step: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    state = None
    for b in batches:
        state = step(state, b)
    return state
