"""File readers (SRC-01..08, 15, 17): JSON arrays, JSON lines, shard folders, text corpora.

All readers take an explicit schema: no inference pass over the data."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.operators.keyed import newest_per_key


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], _schema(schema))


def read_json_array(spark: SparkSession, path: str, schema, array_per_line: bool = False) -> DataFrame:
    """SRC-01: rows of JSON-array files; a missing, unreadable or non-array file gives no rows. A file
    with one array per line is split by lines instead of being read as a whole."""
    s = _schema(schema)
    if not exists(spark, path):
        return empty(spark, s)
    raw = spark.read.text(path, wholetext=not array_per_line).where(F.ltrim("value").startswith("["))
    return raw.select(F.explode(F.from_json("value", T.ArrayType(s))).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC-02: JSON lines, blank and invalid ones skipped."""
    s = _schema(schema)
    return spark.read.schema(s).option("mode", "DROPMALFORMED").json(path) if exists(spark, path) else empty(spark, s)


def field_values(spark: SparkSession, path: str, field: str) -> DataFrame:
    """SRC-03: distinct non-null values of one field; only that field is parsed."""
    x = read_json_lines(spark, path, T.StructType([T.StructField(field, T.StringType())]))
    return x.where(F.col(field).isNotNull()).distinct()


def json_documents(spark: SparkSession, path: str, schema, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable documents) of JSON files: an array or a document per file, indented or not, or one per
    line. Rows carry ``_file``; unreadable documents are (file, document).

    A file is read as a whole to tell its form, unless ``lines`` declares one document or array per line:
    then large files are split."""
    s = _schema(schema)
    marked = T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])
    file = F.input_file_name().alias("_file")
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    if lines:
        docs = spark.read.text(path).select(trim("value").alias("v"), file)
    else:
        whole = spark.read.text(path, wholetext=True).select(trim("value").alias("v"), file)
        first = trim(F.split("v", "\n", 2)[0])
        # a complete document on the first line: one per line
        by_line = first.startswith("{") & first.endswith("}") | first.startswith("[") & first.endswith("]")
        # a broken first line: complete documents on further lines, more than lines that go on as in an array, and the whole is no JSON
        full = F.regexp_count("v", F.lit(r"(?m)^[ \t]*(\{.*\}|\[.*\])[ \t\r]*$"))
        listed = F.regexp_count("v", F.lit(r"(?m)^[ \t]*\[?[ \t]*(\{.*\}|\[.*\]),[ \t\r]*$"))
        opened = first.isin("[", "{").cast("int")               # one document below a bracket may be its only element
        by_line = by_line | (full > listed) & (full > opened) & F.try_parse_json("v").isNull()
        docs = whole.select(F.explode(F.when(by_line, F.split("v", "\n")).otherwise(F.array("v"))).alias("v"), "_file").withColumn("v", trim("v"))
    array = F.col("v").startswith("[")
    x = docs.where("v <> ''").select("_file", "v", F.when(array, F.from_json("v", T.ArrayType(s))).alias("a"),
                                     F.when(~array, F.from_json("v", marked, {"columnNameOfCorruptRecord": "_corrupt_record"})).alias("o"))
    bad = F.col("a").isNull() & (array | F.col("o._corrupt_record").isNotNull())
    one = F.array(F.struct(*[F.col("o").getField(f).alias(f) for f in s.fieldNames()]))
    good = x.where(~bad).select("_file", F.explode(F.coalesce("a", one)).alias("r")).where(F.col("r").isNotNull()).select("r.*", "_file")
    return good, x.where(bad).select(F.col("_file").alias("file"), F.col("v").alias("document"))


def read_shards(spark: SparkSession, path: str, schema, key: str = "entity", stamp: str = "fetched_at", lines: bool = False) -> DataFrame:
    """SRC-05: folder of shard files; per key the newest fetch wins, on a tie the later file name.
    Unreadable shards are the second part of ``json_documents``."""
    s = _schema(schema)
    if not exists(spark, path):
        return empty(spark, s)
    x = json_documents(spark, path, s, lines)[0].where(F.col(key).isNotNull())
    return newest_per_key(x, [key], [F.coalesce(stamp, F.lit("")), "_file"], [f for f in s.fieldNames() if f != key])


def keyed_rows(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """SRC-06: one row per key, rows without a key dropped, the last duplicate wins."""
    return newest_per_key(df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), [key], [ordinal])


def read_entity(spark: SparkSession, path: str, entity, column: str = "entity") -> DataFrame:
    """SRC-04: point read of a table written by ``sinks.write_by_entity``: the number of buckets and the
    bucket are partition columns, so one folder is read and its row groups are skipped by the sorted key."""
    from tallygrid.sources.sinks import entity_bucket
    x = spark.read.parquet(path)
    return x.where((F.col("bucket") == entity_bucket(F.lit(entity), F.col("buckets"))) & (F.col(column) == entity)).drop("bucket", "buckets")


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: {code: {per_usd, as_of}} documents to rows; missing file gives no rows."""
    if not exists(spark, path):
        return empty(spark, "ccy string, per_usd double, as_of string")
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,struct<per_usd:double,as_of:string>>")
    return raw.select(F.explode(m).alias("ccy", "r")).select("ccy", "r.per_usd", "r.as_of")


def read_quarantined(spark: SparkSession, path: str, schema, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC-07: (good rows, unreadable documents) of a store folder, see ``json_documents``."""
    good, bad = json_documents(spark, path, schema, lines)
    return good.drop("_file"), bad


def read_html_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: one row per document file: name, html, text, chars."""
    from tallygrid.functions.html import html_to_text
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("html"))
    return x.withColumn("text", html_to_text("html")).withColumn("chars", F.length("text").cast("bigint"))
