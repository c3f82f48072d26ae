"""Line dedup with two Bloom filters.

A line's key is the line without white space at both ends, A-Z lower-cased. Every task notes the hashes of the keys of
its documents in two filters, seen once and seen twice; filters of two tasks merge bit by bit (what both have seen
once has been seen twice). Only lines that the merged filter suspects are shuffled: their keys are counted exactly, by
the text itself, and the first occurrence is chosen. The filters' size is bounded, a fuller filter only lets
more lines through to the exact count.

An empty text is one empty line, a null text too; keys shorter than ``min_chars`` code points stay. A key counts once
for each row that holds it; rows with the same id and text are one document, and both get its result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import common as C
from tallygrid.session import estimated_bytes, materialise, small_side

MIN_DOCS, MIN_CHARS = 10, 1
#: Bits of a filter: one for each 4 bytes of input files, within these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
SLICE = 1 << 16


def line_keys(raw: bytes) -> list[bytes]:
    """The key of each line: bytes.strip and bytes.lower touch exactly the six white-space characters and A-Z."""
    return [x.strip() for x in raw.lower().split(b"\n")]


def _long_enough(k: bytes, least: int) -> bool:
    return len(k) >= least and (least <= 1 or len(k.decode()) >= least)


def filter_bits(docs: DataFrame) -> int:
    size = estimated_bytes(docs)
    return LEAST_BITS if size >= 1 << 58 else min(MOST_BITS, max(LEAST_BITS, 1 << (size * 2).bit_length() - 3))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash."""
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def twice_seen(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The filter of keys that more than one document may hold."""
    size = bits // 8
    width = min(SLICE, size)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            h = [x for t in batch.column(0) for x in {xxhash.xxh3_64_intdigest(k) for k in line_keys(bytes(t.as_buffer())) if _long_enough(k, min_chars)}]
            h, n = np.unique(np.array(h, np.uint64), return_counts=True)
            a, b = _places(h, bits)
            again = (n > 1) | (_has(once, a) & _has(once, b))
            for filter_, at in ((twice, a[again]), (twice, b[again]), (once, a), (once, b)):
                _set(filter_, at)
        for i in range(0, size, width):
            x, y = once[i:i + width], twice[i:i + width]
            if x.any():
                yield pa.RecordBatch.from_pydict({"slice": [i // width], "once": [zstandard.compress(x.tobytes(), 1)], "twice": [zstandard.compress(y.tobytes(), 1)]},
                                                 schema=pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = once = twice = None
        out = pa.schema([("slice", pa.int32()), ("twice", pa.binary())])
        for batch in batches:
            for s, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = (np.frombuffer(zstandard.decompress(z), np.uint8) for z in (x, y))
                if s != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"slice": [now], "twice": [twice.tobytes()]}, schema=out)
                    now, once, twice = s, np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
                twice |= y | (once & x)
                once |= x
        if now is not None:
            yield pa.RecordBatch.from_pydict({"slice": [now], "twice": [twice.tobytes()]}, schema=out)

    parts = docs.select("text").mapInArrow(note, "slice int, once binary, twice binary")
    dealt = parts.repartition(min(size // width, C.bucket_count(docs)), "slice").sortWithinPartitions("slice")
    whole = np.zeros(size, np.uint8)
    for r in dealt.mapInArrow(merge, "slice int, twice binary").toLocalIterator():      # at most bits / 8 bytes
        whole[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["twice"], np.uint8)
    return whole


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """(key, numbers): for each document of (key, text) rows the packed numbers of the lines to drop."""
    bits = filter_bits(docs)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(twice_seen(docs, min_chars, bits))
    out = pa.schema([("line", pa.binary()), ("key", pa.int64()), ("first", pa.int64()), ("numbers", pa.binary())])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            cols = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = line_keys(bytes(text.as_buffer()))
                a, b = _places(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
                where: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(_has(bitmap, a) & _has(bitmap, b)).tolist():
                    if _long_enough(keys[i], min_chars):
                        where.setdefault(keys[i], []).append(i)
                for k, at in where.items():
                    for c, x in zip(cols, (k, doc, at[0], np.array(at, "<u4").tobytes())):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types)], schema=out)

    found = materialise(docs.select("key", "text").mapInArrow(suspects, "line binary, key long, first long, numbers binary"), "lines")
    confirmed = found.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("f")).where(F.col("n") >= min_docs)
    confirmed = materialise(confirmed.select("line", F.col("f.key").alias("first_key")), "confirmed")
    drops = found.join(small_side(confirmed, C.BROADCAST_BYTES), "line")
    # the first occurrence is the first line of the first document
    own = F.when(F.lit(keep_first) & (F.col("key") == F.col("first_key")), F.expr("substring(numbers, 5)")).otherwise(F.col("numbers"))
    return drops.select("key", own.alias("numbers")).groupBy("key").agg(F.collect_list("numbers").alias("numbers"))


def marked_rows(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool, key: str, text: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text, rest): rows of ``docs`` with the lines that stay."""
    rows, unique = C.keyed(docs, key, text)
    drops = repeated_lines(unique, min_docs, min_chars, keep_first)
    joined = rows.join(drops, "key", "left").select("rest", "doc_id", "text", "numbers")
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text", "rest").schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for t, numbers in zip(batch.column(2), batch.column(3).to_pylist()):
                lines = bytes(t.as_buffer()).split(b"\n")
                n_lines.append(len(lines))
                gone = set(np.frombuffer(b"".join(numbers), "<u4").tolist()) if numbers else ()
                n_dropped.append(len(gone))
                kept.append((b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t.as_buffer().to_pybytes()).decode())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), batch.column(0)],
                                             names=["doc_id", "n_lines", "n_dropped", "text", "rest"])

    return joined.mapInArrow(apply, schema)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept (the other lines). Lines of keys in at least ``min_docs`` documents go,
    all of them or, with ``keep_first``, all but the first line of the document with the smallest key."""
    return marked_rows(docs, min_docs, min_chars, keep_first, key, text).select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
