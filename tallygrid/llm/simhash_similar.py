"""Near copies by wide SimHash: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The fingerprint has 512 bits, a bit being 1 where it is set in over half of the distinct shingles' hashes; two texts of
similarity j differ in about 512 * arccos(2j / (1 + j)) / pi bits, with a standard deviation of eight bits at 0.8. Pairs
up to ``SURE`` bits (0.9; a pair under 0.8 lies four deviations away) are links; pairs up to ``RADIUS`` bits (0.7;
a pair at 0.8 stays below with 0.995) are compared shingle by shingle, unless sure links join them already.

Fingerprints within the radius differ too widely for blocks that must agree, so each is dealt to several groups, one
for each table of sampled bits. The number of bits grows with the logarithm of the rows (a group of unlike texts
holds some 32 of them) and the number of tables so that a pair at 0.8 meets with probability 0.98 or more. In a
group, distances to reference rows of the group are kept as a table; a pair is discarded when a coordinate differs
by more than the radius and verified bit by bit otherwise. Large groups are mostly copies of one text: references link
them as stars in one pass each, and only rows outside the largest star are compared further.

Texts with equal fingerprints are one row before the exchange. A text of fewer than five words is one shingle; texts
without words have fingerprint zero and are copies of each other; null counts as empty. Rows with the same id
and text are one document. An empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import common as C
from tallygrid.llm.graph import components
from tallygrid.llm.simhash_pivot import shingle_hashes, stars
from tallygrid.session import materialise

WORDS, LANES, SIMILARITY = 5, 8, 0.8
BITS = 64 * LANES


def differing(similarity: float) -> float:
    """Share of bits that differ at a Jaccard similarity, texts being of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


RADIUS, SURE = round(BITS * differing(0.7)), round(BITS * differing(0.9))
#: Rows of unlike texts that a group holds; groups beyond ``CROWD`` rows are linked through references.
GROUP, CROWD, REFERENCES = 32, 512, 16
#: Bytes of rows that one bucket of the exchange stands for.
BUCKET_BYTES = 64 * 1024 * 1024


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Eight lanes of 64 bits of a text's shingle hashes, repeats counted once."""
    h = np.unique(hashes)
    total = np.zeros(BITS, np.int64)
    lanes = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(h), 4080):                           # a very long text is counted in parts
        x = h[lo:lo + 4080, None] + lanes
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):                     # 255 rows cannot overflow a byte
            total += np.add.reduce(bits[at:at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").view("<u8")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(key, fp) of (key, text) rows; fp is 64 bytes."""
    out = pa.schema([("key", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(bytes(t.as_buffer()), WORDS)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary())], schema=out)

    return docs.select("key", "text").mapInArrow(run, "key long, fp binary")


def shape(rows: int) -> tuple[int, int]:
    """(bits of a table, tables) for so many distinct fingerprints."""
    bits = min(64, max(4, math.ceil(math.log2(max(rows, 1) / GROUP + 1))))
    return bits, math.ceil(4 / (1 - differing(SIMILARITY)) ** bits)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def crowd(fp: np.ndarray, radius: int = RADIUS, sure: int = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``linked`` for one group of many rows; sure links as stars."""
    root = np.arange(len(fp))
    table: list[np.ndarray] = []
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def unite(rows: np.ndarray) -> None:
        root[np.isin(root, root[rows])] = root[rows].min()

    def outside() -> np.ndarray:
        return np.flatnonzero(root != np.bincount(root).argmax())

    done = np.zeros(len(fp), bool)
    for _ in range(REFERENCES):
        free = outside() if table else np.arange(len(fp))
        free = free[~done[free]]
        if not len(free):
            break
        table.append(distance(fp, fp[free[0]]))
        done[free[0]] = True
        unite(np.flatnonzero(table[-1] <= sure))
    for x in outside():                                         # of any two rows in different stars one is here
        near = np.flatnonzero(root != root[x])
        for d in table:
            near = near[np.abs(d[near] - d[x]) <= radius]
        d = distance(fp[near], fp[x])
        if (d <= sure).any():
            unite(np.append(near[d <= sure], x))
        open_ = (d > sure) & (d <= radius)
        pairs.append((np.full(open_.sum(), x), near[open_], d[open_]))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    pairs.append((moved, root[moved], np.zeros(len(moved), np.int32)))
    return tuple(np.concatenate(c) for c in zip(*pairs))


def linked(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS, sure: int = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d): positions of pairs of a group with their distance (0 in a star of sure links). All pairs within
    ``radius`` are there but those that sure links join."""
    order = np.argsort(group, kind="stable")
    f, g = fp[order], group[order]
    first = np.flatnonzero(C.runs([g]))
    size = np.diff(np.append(first, len(g)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    for at, n in zip(first[size > CROWD], size[size > CROWD]):
        a, b, d = crowd(f[at:at + n], radius, sure)
        out.append((order[at + a], order[at + b], d))
    table = distance(f, f[np.repeat(first, size)])
    here = np.flatnonzero((np.repeat(size, size) <= CROWD) & (np.arange(len(g)) + 1 < len(g)))
    step = 1
    while len(here):
        here = here[here + step < len(g)]
        here = here[g[here + step] == g[here]]
        x = here[np.abs(table[here + step] - table[here]) <= radius]
        d = distance(f[x], f[x + step])
        x, d = x[d <= radius], d[d <= radius]
        out.append((order[x], order[x + step], d))
        step += 1
    return tuple(np.concatenate(c) for c in zip(*out))


def links(distinct: DataFrame, rows: int) -> DataFrame:
    """(a, b, sure) over the nodes of (node, fp) rows, ``rows`` of them: stars of sure links, and pairs to be compared."""
    bits, tables = shape(rows)
    at = np.stack([np.random.default_rng(t).permutation(BITS)[:bits] for t in range(tables)])
    conf = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(conf, math.ceil(rows * tables * (8 * LANES + 18) / BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                node, n = part.column(0).to_numpy(), part.num_rows
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, 8 * LANES)
                on = np.unpackbits(fp, axis=1, bitorder="little")
                key = np.zeros((n, tables), np.uint64)
                for i in range(bits):
                    key |= on[:, at[:, i]].astype(np.uint64) << np.uint64(i)
                which = np.tile(np.arange(tables, dtype=np.uint16), n)
                key = key.ravel()
                by = (key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + which * np.uint64(0xBF58476D1CE4E5B9)
                bucket = (((by ^ (by >> np.uint64(31))) >> np.uint64(7)) % np.uint64(buckets)).astype(np.int32)
                row = np.repeat(np.arange(n), tables)
                yield C.blob_rows(bucket, [which, key, node[row], fp[row]], schema=C.BLOB)

    def work(_bucket: int, cols: list[np.ndarray]) -> list[pa.RecordBatch]:
        which, key, node, fp = cols
        order = np.lexsort((node, key, which))
        which, key, node = which[order], key[order], node[order]
        words = np.ascontiguousarray(fp[order]).view("<u8")
        a, b, d = linked(words, np.cumsum(C.runs([which, key])))
        names, place = np.unique(node, return_inverse=True)
        a, b = place[a], place[b]
        root = stars(len(names), a[d <= SURE], b[d <= SURE])
        moved = np.flatnonzero(root != np.arange(len(names)))
        other = (d > SURE) & (root[a] != root[b])
        pair = np.unique(np.stack([np.maximum(a, b)[other], np.minimum(a, b)[other]]), axis=1)
        a, b = np.append(moved, pair[0]), np.append(root[moved], pair[1])
        return [pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b]), pa.array(np.arange(len(a)) < len(moved))], names=["a", "b", "sure"])] if len(a) else []

    blobs = distinct.select("node", "fp").mapInArrow(send, "bucket int, payload binary")
    return C.per_bucket(blobs, buckets, ("u2", "u8", "i8", f"{8 * LANES}u1"), work, "a long, b long, sure boolean").distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, grams): the distinct shingle hashes of (key, text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                grams = [np.unique(shingle_hashes(bytes(t.as_buffer()), WORDS)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["node", "grams"])

    return docs.select("key", "text").mapInArrow(run, "node long, grams array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``SIMILARITY`` or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = materialise(shingle_sets(docs.select("key", "text").join(ends, "key", "left_semi")), "shingle-sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return pairs.join(left, "a").join(right, "b").where(both / (F.size("grams_a") + F.size("grams_b") - both) >= SIMILARITY).select("a", "b")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, fp), (node, root)) of (key, text) rows: node is the smallest key of a fingerprint; nodes that have links, with the smallest node reached."""
    distinct = materialise(with_fingerprints(docs).groupBy("fp").agg(F.min("key").alias("node")), "wide-fingerprints")
    found = materialise(links(distinct, distinct.count()), "wide-links")
    sure = found.where("sure").select("a", "b")
    joined = materialise(components(sure), "sure")
    open_ = materialise(across(found.where("not sure").select("a", "b"), joined), "open")
    # each node's smallest partner first: copies of one text mostly join through it, and the pairs among them need no comparison
    first = materialise(open_.groupBy("a").agg(F.min("b").alias("b")), "first")
    edges = materialise(sure.unionByName(confirmed(first, docs)), "confirmed")
    joined = materialise(components(edges), "joined")
    rest = materialise(across(open_.join(first, ["a", "b"], "left_anti"), joined), "rest")
    return distinct, components(edges.unionByName(confirmed(rest, docs))) if rest.head(1) else joined


def across(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components of (node, root)."""
    for c in "ab":
        pairs = pairs.join(joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return pairs.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, that of the smallest key, with all its columns."""
    rows, unique = C.keyed(docs, key, text)
    distinct, found = groups(unique)
    kept = distinct.join(found.where("node <> root"), "node", "left_anti").select(F.col("node").alias("key"))
    return C.restore(unique.join(kept, "key", "left_semi"), docs.columns, key, text)
