"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector v to the cell floor((A v + b) / width) of ``HASHES`` random Gaussian projections. A query looks into its
own cell and into cells perturbed by one step in some coordinates, in the order of their estimated
success: a step costs the squared distance to the cell's wall, a set of steps the sum, and the sets of least cost
come first. The candidates of all tables are merged and ranked by their exact distance on the original vectors.

Equal vectors are searched once: the index holds each distinct vector with its smallest ids, queries with equal vectors share a
search. Cells with more than ``CELL_ROWS`` vectors are split over several tasks, and probes of them are
copied. A query that finds fewer than k others is searched again, exactly, against all vectors in blocks of queries.

The width is fitted on at most ``SAMPLE`` vectors (smallest hash of their ids); every vector is indexed.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Of several vectors of one id the
least counts. Only vectors of equal length are compared. Ties go to the smaller id; null ids take no part.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm import common as C
from tallygrid.session import materialise, small_side

TABLES, HASHES, PROBES, SAMPLE, SEED = 6, 6, 60, 2_000, 7
#: Cell width in units of the sample's typical distance to its 10th nearest neighbour.
WIDTH = 1.6
CELL_ROWS = 50_000
#: Queries of one exact block.
BLOCK = 1_000


class Tables:
    """Projections for vectors of one length, made from a fixed seed."""

    def __init__(self, dim: int, width: float, tables: int = TABLES, hashes: int = HASHES):
        rng = np.random.default_rng([SEED, dim])
        self.tables, self.hashes = tables, hashes
        self.a = rng.standard_normal((dim, tables * hashes)) / width
        self.b = rng.random(tables * hashes)
        self.salt = rng.integers(1, 1 << 62, (tables, hashes), dtype=np.int64) | 1
        self.base = rng.integers(1, 1 << 62, tables, dtype=np.int64) + dim

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.a + self.b).reshape(len(x), self.tables, self.hashes)

    def key(self, cells: np.ndarray) -> np.ndarray:
        """One number for each table and cell; cells: (..., tables, hashes)."""
        with np.errstate(over="ignore"):
            k = (cells.astype(np.int64) * self.salt).sum(-1) + self.base
            k = (k ^ (k >> 31)) * np.int64(0x7FB5D329728EA185)
        return k ^ (k >> 27)

    def probes(self, x: np.ndarray, n: int = PROBES) -> np.ndarray:
        """(rows, tables * n) keys of the cells to visit, each table's most promising first."""
        p = self.project(x)
        cells = np.floor(p)
        inside = p - cells
        cost = np.concatenate([inside, 1 - inside], -1) ** 2    # down, then up
        order = np.argsort(cost, -1)
        out = np.empty((len(x), self.tables, n), np.int64)
        for i in range(len(x)):
            for t in range(self.tables):
                c = cells[i, t]
                sets = perturbations(cost[i, t][order[i, t]], order[i, t], self.hashes, n)
                moved = np.repeat(c[None, :], len(sets), 0)
                for row, s in zip(moved, sets):
                    for j in s:
                        row[j % self.hashes] += 1 if j >= self.hashes else -1
                got = self.key(moved[:, None, :].repeat(self.tables, 1))[:, t]
                out[i, t, :len(got)] = got
                out[i, t, len(got):] = got[0]
        return out.reshape(len(x), -1)


def perturbations(cost: np.ndarray, which: np.ndarray, hashes: int, n: int) -> list[tuple[int, ...]]:
    """The n sets of steps of least total cost, none first. cost ascending; a set never steps both ways in one coordinate."""
    out: list[tuple[int, ...]] = [()]
    cost = cost.tolist()
    heap = [(cost[0], (0,))]
    while heap and len(out) < n:
        total, s = heapq.heappop(heap)
        steps = [int(which[i]) for i in s]
        if len({j % hashes for j in steps}) == len(steps):
            out.append(tuple(steps))
        last = s[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*s, last + 1)))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, _matrix(column.take(pa.array(at)))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances of one vector to many."""
    return np.sqrt(((x - q) ** 2).sum(1))


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one row per id, v an array of double."""
    v = F.col(vector).cast("array<double>")
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull()).where(F.coalesce(good, F.lit(False)))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def typical_distance(vectors: DataFrame, k: int) -> dict[int, float]:
    """For each length, the sample's median distance to its k-th nearest neighbour, carried to the number of all vectors."""
    sample = vectors.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    counts = {r["d"]: r["count"] for r in vectors.groupBy(F.size("v").alias("d")).count().collect()}
    out = {}
    for d, n in counts.items():
        x = np.array([r["v"] for r in sample if len(r["v"]) == d], np.float64).reshape(-1, d)
        if len(x) < 2:
            out[d] = 1.0
            continue
        sq = (x ** 2).sum(1)
        near = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
        # the k-th of all n lies where the (k * sample / n)-th of the sample does, at least its nearest
        at = min(len(x) - 1, max(1, math.ceil(k * len(x) / n)))
        out[d] = float(np.median(np.partition(near, at, 1)[:, at])) or 1.0
    return out


def nearest(table: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score (distance): the k nearest found of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    rows = materialise(usable(table, key, vector), "vectors")
    # distinct vectors under their smallest id; k + 1 ids are enough for any query, itself included
    ids = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    members = materialise(ids.select("v", "id").groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "v"), "members")
    queries = rows.where(F.col("id") % every == 0)
    asked = materialise(queries.groupBy("v").agg(F.min("id").alias("q")), "asked")
    scale = {d: s * width for d, s in typical_distance(members, k).items()}
    buckets = C.bucket_count(table)

    def send(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            for at, x in _by_length(batch.column(1)):
                d = x.shape[1]
                t = made.setdefault(d, Tables(d, scale[d], tables, hashes))
                keys = t.probes(x, probes) if probe else t.key(np.floor(t.project(x)))
                per = keys.shape[1]
                blobs = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy()[at], per)), pa.array(np.repeat(np.array(blobs, object), per), pa.binary())],
                                                 names=["cell", "id", "x"])

    shape = "cell long, id long, x binary"
    index = members.select("rep", "v").mapInArrow(lambda b: send(b, False), shape)
    asks = asked.select("q", "v").mapInArrow(lambda b: send(b, True), shape)
    crowded = index.groupBy("cell").count().where(F.col("count") > CELL_ROWS).select("cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts"))
    crowded = small_side(materialise(crowded, "crowded"), C.BROADCAST_BYTES)
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(crowded, "cell", "left").select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "x")
    asks = asks.dropDuplicates(["cell", "id"]).join(crowded, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("kind"), "id", "x")
    found_schema = pa.schema([("q", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, blobs, x = None, [], [], None
        out: list[list] = [[], [], []]
        for batch in batches:
            for cell, part, kind, id_, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, part) != now:
                    now, reps, blobs, x = (cell, part), [], [], None
                if kind == 0:
                    reps.append(id_)
                    blobs.append(v)
                elif reps:
                    if x is None:
                        x, r = np.frombuffer(b"".join(blobs)).reshape(len(reps), -1), np.array(reps)
                    d = distances(np.frombuffer(v), x)
                    best = np.arange(len(d))
                    if len(d) > k + 1:
                        best = np.flatnonzero(d <= np.partition(d, k)[k])
                        best = best[np.lexsort((r[best], d[best]))[:k + 1]]
                    for c, y in zip(out, ([id_] * len(best), r[best].tolist(), d[best].tolist())):
                        c += y
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, found_schema.types)], schema=found_schema)
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, found_schema.types)], schema=found_schema)

    both = index.unionByName(asks).repartition(buckets, "cell", "part").sortWithinPartitions("cell", "part", "kind")
    found = both.mapInArrow(search, "q long, rep long, score double").distinct()
    found = materialise(_expand(found, members, k), "near")
    few = asked.join(found.groupBy("q").agg(F.countDistinct("id").alias("n")), "q", "left").where(F.coalesce("n", F.lit(0)) < k + 1).select("q", "v")
    few = materialise(few, "few")
    missing = few.count()
    parts_n = math.ceil(missing / BLOCK)
    for b in range(parts_n):
        block = [(r["q"], np.array(r["v"])) for r in few.where(F.pmod(F.xxhash64("q"), F.lit(parts_n)) == b).collect()]

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reps = batch.column(0).to_numpy()
                for at, x in _by_length(batch.column(1)):
                    r = reps[at]
                    for q, v in block:
                        if len(v) == x.shape[1]:
                            d = distances(v, x)
                            best = np.lexsort((r, d))[:k + 1]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(r[best]), pa.array(d[best])], schema=found_schema)

        found = found.unionByName(_expand(members.select("rep", "v").mapInArrow(scan, "q long, rep long, score double"), members, k))
    found = materialise(found.distinct(), "found")
    back = queries.select(F.col("id").alias("query_id"), "v").join(asked, "v").select("query_id", "q")
    result = back.join(found, "q").where("id != query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return result.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _expand(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Each query's k + 1 nearest rows: its nearest distinct vectors first, then their ids."""
    near = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "rep"))).where(F.col("n") <= k + 1)
    rows = near.join(members.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("id"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("n") <= k + 1).select("q", "id", "score")
