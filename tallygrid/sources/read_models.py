"""Read models as JSON documents (SNK-06, 07): one table for all models, keyed by (model, key), with a content hash next to each payload.

A publishing run is one job: the documents of all models are built as one frame, compared with the stored ones by their hashes, and what is new, changed or gone is
written as one change of a merge-on-read table. The hash is a narrow column, so the comparison reads no stored payload; a run without changes writes nothing.

A list model (the companies of an industry, the search index) is cut into pages of at most ``PAGE`` rows, so that no document grows with the data."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.session import materialise
from tallygrid.sources import merge_table as M

PAGE = 1_000
SCHEMA = "model string, key string, hash string, payload string"


def documents(df: DataFrame, model: str, key: list[str], values: list[str]) -> DataFrame:
    """(model, key, payload): a document for each row."""
    return df.select(F.lit(model).alias("model"), F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"), F.to_json(F.struct(*values)).alias("payload"))


def pages(df: DataFrame, model: str, group: list[str], order: list[str], values: list[str], size: int = PAGE) -> DataFrame:
    """(model, key, payload): a group's rows in order, ``size`` to a document; the key ends with the page's number.

    Rows are numbered by a window that streams through a group, and only a page is collected."""
    n = F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    x = df.select(*group, n.alias("_n"), F.struct(*values).alias("_v")).withColumn("_page", F.floor(F.col("_n") / size))
    x = x.groupBy(*group, "_page").agg(F.sort_array(F.collect_list(F.struct("_n", "_v"))).alias("_r")).withColumn("rows", F.col("_r._v"))
    return documents(x, model, [*group, "_page"], [*group, "rows"])


def create(spark: SparkSession, path: str, buckets: int | None = None) -> M.MergeTable:
    return M.MergeTable.create(spark.createDataFrame([], SCHEMA), path, ["model", "key"], buckets)


def changes(table: M.MergeTable, docs: DataFrame, at: M.Manifest | None = None) -> DataFrame:
    """(model, key, hash, payload, how): documents that are new or differ, and the keys of those that are gone from the models of ``docs``."""
    m = at or table.manifest()
    now = docs.withColumn("hash", F.sha2("payload", 256)).select("model", "key", "hash", "payload")
    stored = table.read(m, columns=["hash"])
    fresh = now.join(stored, ["model", "key", "hash"], "left_anti").withColumn("how", F.lit(M.REPLACE))
    gone = stored.join(now.select("model").distinct(), "model", "left_semi").join(now, ["model", "key"], "left_anti")
    return fresh.unionByName(gone.select("model", "key", F.lit(M.REMOVE).alias("how")), allowMissingColumns=True)


def publish(table: M.MergeTable, docs: DataFrame) -> DataFrame:
    """Bring the table up to the documents; returns (model, key, how) of what has changed. Models that ``docs`` does not hold stay."""
    m = table.manifest()
    diff = materialise(changes(table, materialise(docs, "documents"), m), "changes")
    if not diff.isEmpty():
        table.apply(diff, F.col("how"), at=m)
    return diff.select("model", "key", "how")


def read(table: M.MergeTable, model: str, schema: str) -> DataFrame:
    """(key and the document's fields) of one model."""
    return table.read(columns=["payload"]).where(F.col("model") == model).select("key", F.from_json("payload", schema).alias("j")).select("key", "j.*")
