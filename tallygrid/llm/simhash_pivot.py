"""SimHash near-dedup with pivot distance tables.

A fingerprint is made of a text's word shingles. Distinct fingerprints are dealt to groups that agree on some blocks of
bits: of b blocks, two differing bits spare b - 2, so every linked pair meets under one of the choices of b - 2
blocks. In a group, the Hamming distances of each fingerprint to many reference fingerprints (pivots, rows of
a Hadamard matrix) are precomputed as a table; rows are sorted by the first coordinate, a pair is discarded when any
coordinate differs by more than the radius (triangle inequality), and the survivors are verified bit by
bit. What a group links is sent on as stars; components are found in Spark.

Blocks: 3 while no group of equal blocks grows beyond ``GROUP_ROWS``, then 4, 5 and 6; the links are the same.

A text without words has fingerprint zero and is linked like any other; a null text counts as empty. Rows with the
same id and text are one document. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import common as C
from tallygrid.llm.graph import components
from tallygrid.session import materialise

WORDS, SEED, RADIUS, PIVOTS = 3, 42, 2, 24
GROUP_ROWS = 50_000
#: Bits of shingles unpacked at a time.
BLOCK = 60_000


def shingle_hashes(raw: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``words`` words (fewer: all of them; none: nothing). A-Z are lower-cased."""
    w = raw.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(t), seed) for t in zip(*(w[i:] for i in range(words)))) if len(w) >= words else [digest(join(w), seed)], np.uint64, n)


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """A bit is 1 where it is set in over half of a text's hashes."""
    out = np.zeros(len(hashes), np.uint64)
    at = 0
    while at < len(hashes):
        end, n = at, 0
        while end < len(hashes) and (end == at or n + len(hashes[end]) <= BLOCK):
            n += len(hashes[end])
            end += 1
        sizes = np.array([len(h) for h in hashes[at:end]])
        some = np.flatnonzero(sizes)
        if len(some):
            total = np.zeros((len(some), 64), np.int64)
            flat = np.concatenate([hashes[at + i] for i in some])
            starts = np.cumsum(sizes[some]) - sizes[some]
            for lo in range(0, len(flat), BLOCK):               # a very long text is counted in parts
                part = np.unpackbits(flat[lo:lo + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first = np.searchsorted(starts, lo, "right") - 1
                cuts = np.maximum(starts[first:np.searchsorted(starts, lo + len(part))] - lo, 0)
                total[first:first + len(cuts)] += np.add.reduceat(part, cuts, axis=0, dtype=np.int32)
            bits = 2 * total > sizes[some][:, None]
            out[at + some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        at = end
    return out


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Rows of the 64 x 64 Hadamard matrix as fingerprints: bit j of row i is the parity of i & j."""
    i, j = np.arange(64, dtype=np.uint64)[:, None], np.arange(64, dtype=np.uint64)[None, :]
    bits = np.bitwise_count(i & j) & 1
    spread = (np.arange(n) * 37 + 1) % 64
    return np.packbits(bits[spread].astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def linked(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within ``radius`` bits among the rows of a group."""
    reference = pivots()
    table = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    table, group, f = table[order], group[order], fp[order]
    a, b = [], []
    here = np.arange(len(f) - 1)
    step = 1
    while len(here):
        here = here[here + step < len(f)]
        there = here + step
        near = (group[there] == group[here]) & (table[there, 0] - table[here, 0] <= radius)
        here = here[near]                                       # sorted: what is too far now stays too far
        x, y = here, here + step
        for p in range(1, table.shape[1]):
            ok = np.abs(table[y, p] - table[x, p]) <= radius
            x, y = x[ok], y[ok]
            if not len(x):
                break
        ok = np.bitwise_count(f[x] ^ f[y]) <= radius
        a.append(order[x[ok]])
        b.append(order[y[ok]])
        step += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each position reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """For each choice of blocks that may differ, a mask of the bits that then agree."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (y - x)) - 1) << x for x, y in zip(edge, edge[1:])]
    return [(1 << 64) - 1 ^ sum(block[i] for i in out) for out in combinations(range(blocks), radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(key, fp) of (key, text) rows; the unsigned fingerprint as a long."""
    out = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fp = fingerprints([shingle_hashes(bytes(t.as_buffer())) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], schema=out)

    return docs.select("key", "text").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): stars that connect all fingerprints (column fp, distinct) within ``radius`` of each other."""
    for blocks in range(radius + 1, radius + 5):
        choice = masks(blocks, radius)
        keys = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(choice)])).alias("k"))
        if blocks == radius + 4 or (keys.groupBy("k").count().agg(F.max("count")).first()[0] or 0) <= group_rows:
            break
    buckets = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mask = np.array(choice, np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            which = np.tile(np.arange(len(mask), dtype=np.uint8), len(fp))
            all_ = np.repeat(fp, len(mask))
            by = ((all_ & mask[which]) ^ mask[which]) * np.uint64(0x9E3779B97F4A7C15) + which
            yield C.blob_rows(((by >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32), [which, all_], schema=C.BLOB)

    def work(_bucket: int, cols: list[np.ndarray]) -> list[pa.RecordBatch]:
        which, fp = cols
        group = np.unique(np.stack([which.astype(np.uint64), fp & mask[which]], 1), axis=0, return_inverse=True)[1].ravel()
        a, b = linked(fp, group, radius)
        root = stars(len(fp), a, b)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return [pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[root[moved]].view(np.int64))], names=["a", "b"])] if len(moved) else []

    blobs = distinct.select("fp").mapInArrow(send, "bucket int, payload binary")
    return C.per_bucket(blobs, buckets, ("u1", "u8"), work, "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(key, fp, component) of (key, text) rows: component is the smallest key reachable over links."""
    marked = materialise(with_fingerprints(docs), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    roots = components(links(distinct))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    return marked.join(named.join(smallest, "root").select("fp", "component"), "fp").select("key", "fp", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable) of every row."""
    rows, unique = C.keyed(docs, key, text)
    found = groups(unique)
    if rows is unique:
        return found.select(F.col("key").alias("doc_id"), _hex("fp").alias("fingerprint"), F.col("component").alias("component_id"))
    ids = unique.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
    every = rows.select("key", "doc_id").join(found, "key").join(ids, "component")
    return every.select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def _hex(c: str):
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest key, with all its columns."""
    rows, unique = C.keyed(docs, key, text)
    kept = groups(unique).where("key = component").select("key")
    return C.restore(unique.join(kept, "key", "left_semi"), docs.columns, key, text)
