"""Table writers (SNK-01..12). A path that is being read is never overwritten: results go to a new
path or replace single partitions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.scalars import _c


def overwrite(df: DataFrame, path: str) -> None:
    """SNK-01: all or nothing through the commit protocol."""
    df.write.mode("overwrite").parquet(path)


def entity_bucket(entity, n) -> Column:
    return F.pmod(F.xxhash64(_c(entity).cast("string")), F.lit(n)).cast("int")


# Input bytes that one bucket folder stands for.
BUCKET_BYTES = 256 * 1024 * 1024


def write_by_entity(df: DataFrame, path: str, entity: str = "entity", buckets: int | None = None) -> None:
    """SNK-02: per-entity shards. One folder per entity would mean millions of folders, so entities
    share bucket folders, as many as the input's size asks for, and are sorted inside their files. The
    exchange is a rebalance: AQE splits a bucket that outgrows its advisory size, so an entity that
    holds a third of the rows is written by several tasks."""
    from tallygrid.session import estimated_bytes
    if buckets is None:
        size = estimated_bytes(df)
        buckets = 64 if size >= 1 << 58 else max(8, -(-size // BUCKET_BYTES))       # larger: Catalyst does not know
    x = df.withColumn("buckets", F.lit(buckets)).withColumn("bucket", entity_bucket(entity, buckets))
    x.hint("rebalance", "bucket").sortWithinPartitions("bucket", entity).write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)


def write_shards(df: DataFrame, path: str, shard: str, sort: str) -> None:
    """SNK-03: only the shards present in ``df`` are replaced; rows sorted inside each shard file.
    A range exchange on (shard, sort key) cuts a large shard into several sorted files with disjoint
    key ranges; its sampling pass reads the input once more, so pass a table, not a long plan."""
    df.repartitionByRange(shard, sort).sortWithinPartitions(shard, sort).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """SNK-06: one JSON document per key as (key, payload) rows."""
    documents(df, key).write.mode("overwrite").parquet(path)


def documents(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("payload"))


def changed_documents(new: DataFrame, stored: DataFrame) -> DataFrame:
    """SNK-07: documents whose content differs from the stored one. Keys are compared by a 64-bit
    hash of the payload, and the payload itself settles equal hashes."""
    n = new.withColumn("_h", F.xxhash64("payload"))
    s = stored.select("key", F.xxhash64("payload").alias("_h"), F.col("payload").alias("_p"))
    return n.join(s, ["key", "_h"], "left").where(F.col("_p").isNull() | (F.col("_p") != F.col("payload"))).select("key", "payload")


# Fixed value: series a user may keep.
MAX_SERIES = 60


def save_series(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-08: create or replace by (user_id, entity, name); hint and last source survive a null;
    a user's series beyond the limit are refused, existing ones always stay."""
    k = ["user_id", "entity", "name"]
    o = old.select(*k, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in k], F.lit(True).alias("_had"))
    n = new.select(*k, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in k], F.lit(True).alias("_new"))
    x = o.join(n, k, "full_outer")
    cols = [c for c in old.columns if c not in k]
    keep = ("source_hint", "last_source")
    out = [F.when(F.col("_new"), F.coalesce(f"_n_{c}", f"_o_{c}") if c in keep else F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)
           for c in cols]
    x = x.select(*k, *out, F.coalesce("_had", F.lit(False)).alias("_had"))
    from pyspark.sql import Window as W
    have = x.where("_had").groupBy("user_id").agg(F.count(F.lit(1)).alias("_have"))
    # only newly created series can be refused; at most MAX_SERIES of them matter per user
    w = W.partitionBy("user_id").orderBy("entity", "name")
    fresh = x.where(~F.col("_had")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= MAX_SERIES) \
        .join(have, "user_id", "left").where(F.col("_rn") + F.coalesce("_have", F.lit(0)) <= MAX_SERIES)
    return x.where("_had").drop("_had").unionByName(fresh.drop("_had", "_rn", "_have"))


def add_points(old: DataFrame, new: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """SNK-09: union of points; for the same period the later one wins."""
    u = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    cols = [c for c in old.columns if c not in (*keys, period)]
    return u.groupBy(*keys, period).agg(F.max_by(F.struct(*cols), F.struct("_n", *cols)).alias("b")).select(*keys, period, "b.*")


def update_log(log: DataFrame, updates: DataFrame) -> DataFrame:
    """SNK-11: per date a new summary replaces the old one and processed tickers are united.
    ``log``/``updates``: date, tickers, summary."""
    x = log.alias("l").join(updates.alias("u"), "date", "full_outer")
    arr = F.array().cast("array<string>")
    t = F.array_sort(F.array_union(F.coalesce("l.tickers", arr), F.coalesce("u.tickers", arr)))
    return x.select("date", t.alias("tickers"), F.size(t).cast("bigint").alias("n"), F.coalesce("u.summary", "l.summary").alias("summary"))


def snapshot_path(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
