"""Helpers shared by the corpus operators: keys, bucket counts, packed exchange of numpy columns."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.session import estimated_bytes, materialise

#: Input bytes (as files) that one bucket of an exchange stands for.
BUCKET_BYTES = 24 * 1024 * 1024
#: Largest table, in bytes of its files as Catalyst sees them, that is sent to every executor.
BROADCAST_BYTES = 8 * 1024 * 1024


def bucket_count(df: DataFrame) -> int:
    """Buckets for an exchange over this input: the session's shuffle partitions, more where the input is larger."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    return conf if size >= 1 << 58 else max(conf, math.ceil(size / BUCKET_BYTES))       # larger: Catalyst does not know


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) only, text never null; other columns and their names play no part."""
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, text, rest) of all rows with a key that names one text, and the same with one row for each key.

    ``rest`` is a struct of the other columns. Where ids are unique and never null, the id is the key. Otherwise rows
    with the same id and text are one document, and the keys ascend with the distinct (id, text), null ids first; they have gaps."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))).alias("rest"))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1)
    if not odd.head(1):
        rows = rows.select(F.col("doc_id").alias("key"), "doc_id", "text", "rest")
        return rows, rows
    rows = rows.withColumn("h", F.sha2("text", 256))
    order = rows.select("doc_id", "h").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "h")
    # ascending over the sorted partitions, with gaps
    numbers = materialise(order.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.monotonically_increasing_id().alias("key")), "keys")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    # written, so that sizes are those of files (the estimate of a join multiplies its sides) and one row of each key is the same for all readers
    rows = materialise(rows.join(numbers, on).select("key", "doc_id", "text", "rest"), "keyed")
    return rows, materialise(rows.dropDuplicates(["key"]), "unique")


def restore(rows: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text", **changed) -> DataFrame:
    """Rows of ``keyed`` with their first columns in their first order; ``changed``: new values by name."""
    base = {key: F.col("doc_id"), text: F.col("text")} | {c: changed[c] for c in changed if c in columns}
    return rows.select(*[base.get(c, F.col("rest").getField(c)).alias(c) for c in columns])


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed bytes."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    """The columns that ``pack`` was given; each type may have a width, such as '160u1'."""
    raw = zstandard.decompress(blob)
    kinds = [np.dtype(t) for t in types]
    n = len(raw) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * k.itemsize
    return out


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for every bucket present, positions ascending."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def runs(sorted_columns: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def per_bucket(blobs: DataFrame, buckets: int, types: tuple[str, ...], work: Callable, schema: str) -> DataFrame:
    """Bring the packed rows (bucket int, payload binary) of a bucket to one task and run
    ``work(bucket, columns) -> list[pa.RecordBatch]`` on the bucket's columns, one bucket at a time."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close():
            if parts:
                yield from work(now, [np.concatenate(c) for c in zip(*parts)])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != now:
                    yield from close()
                    now, parts = b, []
                parts.append(unpack(memoryview(blob.as_buffer()), *types))
        yield from close()

    dealt = blobs.select("bucket", "payload").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(job, schema)


def blob_rows(bucket: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """One packed row for each bucket present."""
    ids, blobs = [], []
    for b, at in split_by(bucket):
        ids.append(b)
        blobs.append(pack(*[c[at] for c in columns]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)


BLOB = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
