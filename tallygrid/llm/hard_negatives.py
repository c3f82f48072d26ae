"""Hard negatives by Fagin's threshold algorithm.

A row's components are integers, floor(scale * x); its score for an anchor is their inner product. Rows are dealt into shards of at most
about ``SHARD_ROWS``; a shard keeps, for each dimension, its candidates in the order of that component. For an anchor the lists are
read from the end that its component's sign prefers, all to the same depth; each row met for the first time is scored exactly by random
access. No row not yet met can score more than the threshold, the sum of anchor component times list value at that depth, so
a search ends once the threshold is strictly below the k-th best score found (a tie could still win by its smaller id).

Two searches over all shards: the positives (rows of the anchor's label), then, for each positive, the best rows of other labels inside its window of scores, all
windows of an anchor in one pass. A window also ends once the threshold lies below its lower bound. What the shards find is
merged by one ranking. Anchors come in blocks of ``BLOCK``; a block is the only data that is collected and sent to all tasks.

Rows with a null id, label or vector, an empty vector, a null or non-finite component, or a component beyond 2**24 after scaling (scores must
fit a long) take no part. Of several rows of one id the least (label, vector) counts. Only vectors of equal length are compared. Other columns play no part.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.session import materialise, scratch

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A window holds scores from LOW / HIGH of the positive's score to that score.
LOW, HIGH = 80, 100
#: Ids divisible by this have their label moved on, modulo LABELS.
MOVED, LABELS = 7, 10
SHARD_ROWS, BLOCK = 16_384, 4_096
#: Components beyond this take no part; with it a vector of 2**14 components still has a score within 2**62.
LARGEST = 1 << 24


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, moved: int = MOVED, labels: int = LABELS) -> DataFrame:
    """(id, label, q): one row per id, q an array of long; labels of some ids moved on, so that these are labelled wrong on purpose."""
    q = F.transform(F.col(vector), lambda x: F.floor(scale * x.cast("double")))
    x = F.col(vector)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) <= LARGEST / scale))
    id_, label_ = F.col(key).cast("long"), F.col(label).cast("long")
    label_ = F.when(id_ % moved == 0, (label_ + 1) % labels).otherwise(label_) if moved else label_
    rows = table.where(F.coalesce(good, F.lit(False))).select(id_.alias("id"), label_.alias("label"), q.alias("q")).where("id is not null and label is not null")
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def shards(rows: DataFrame) -> DataFrame:
    """(shard, dim, ids, labels, q, lists): candidates of one vector length with their order in every dimension, packed."""
    counts = {r["d"]: r["count"] for r in rows.groupBy(F.size("q").alias("d")).count().collect()}     # one row for each vector length
    parts = F.lit(1)
    for d, n in counts.items():
        parts = F.when(F.size("q") == d, F.lit(max(1, math.ceil(n / SHARD_ROWS)))).otherwise(parts)
    dealt = rows.select("id", "label", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    total = sum(max(1, math.ceil(n / SHARD_ROWS)) for n in counts.values())
    schema = "dim int, part int, ids binary, labels binary, q binary, lists binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            if now is None:
                return
            ids, labels, q = (np.concatenate(c) for c in zip(*held))
            q = q.reshape(len(ids), -1)
            lists = np.ascontiguousarray(np.argsort(q, 0, kind="stable").T.astype(np.uint32))     # dimension by dimension, ascending
            blobs = [ids.tobytes(), labels.tobytes(), q.astype(np.int32).tobytes(), lists.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["dim", "part", "ids", "labels", "q", "lists"])

        for batch in batches:
            if not len(batch):
                continue
            dim, part = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(batch))):
                if (dim[a], part[a]) != now:
                    yield from close()
                    now, held = (dim[a], part[a]), []
                piece = batch.slice(a, b - a)
                held.append((piece.column(0).to_numpy(), piece.column(1).to_numpy(), piece.column(2).flatten().to_numpy()))
        yield from close()

    dealt = dealt.repartition(max(1, total), "dim", "part").sortWithinPartitions("dim", "part", "id")
    return materialise(dealt.mapInArrow(build, schema), "shards")


class Shard:
    """Sorted lists of one shard, read for one anchor at a time."""

    def __init__(self, ids: bytes, labels: bytes, q: bytes, lists: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.q = np.frombuffer(q, np.int32).reshape(len(self.ids), -1)
        self.lists = np.frombuffer(lists, np.uint32).reshape(self.q.shape[1], -1)
        # inner products in doubles are exact while they stay below 2**53, and much faster
        largest = int(np.abs(self.q).max(initial=0))
        self.dtype = np.float64 if largest * LARGEST * self.q.shape[1] < 1 << 53 else np.int64
        self.exact = self.q.astype(self.dtype)

    def search(self, anchor: np.ndarray, done) -> tuple[np.ndarray, np.ndarray]:
        """(rows met, their scores) once ``done(rows, scores, threshold)`` says so or the lists are read to their ends."""
        n = len(self.ids)
        dims = np.flatnonzero(anchor)                          # a zero component adds nothing to any score
        met = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = np.where((anchor[dims] > 0)[:, None], self.lists[dims, ::-1], self.lists[dims]) if len(dims) else np.zeros((0, n), np.uint32)
        a, depth = 0, max(1, n // 64)
        while a < n:
            b = min(n, a + depth)
            new = np.zeros(n, bool)
            if len(dims):
                new[lists[:, a:b].ravel()] = True
                new &= ~met
            else:
                new[:] = True
            at = np.flatnonzero(new)
            met[at] = True
            got = (self.exact[at] @ anchor.astype(self.dtype)).astype(np.int64)
            rows, scores = np.concatenate([rows, at]), np.concatenate([scores, got])
            threshold = int((anchor[dims] * self.q[lists[:, b - 1], dims]).sum())
            if len(rows) == n or done(rows, scores, threshold):
                break
            a, depth = b, depth * 2
        return rows, scores

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best: higher scores first, then smaller ids."""
        if len(rows) > k:
            at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            at = np.arange(len(rows))
        return at[np.lexsort((self.ids[rows[at]], -scores[at]))[:k]]

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best other rows of the label."""
        def mine(rows):
            return (self.labels[rows] == label) & (self.ids[rows] != anchor_id)

        def done(rows, scores, threshold):
            s = scores[mine(rows)]
            return len(s) >= k and threshold < np.partition(s, len(s) - k)[len(s) - k]

        rows, scores = self.search(anchor, done)
        ok = mine(rows)
        rows, scores = rows[ok], scores[ok]
        at = self.best(rows, scores, k)
        return self.ids[rows[at]], scores[at]

    def negatives(self, label: int, anchor: np.ndarray, tops: list[int], k: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive's score, (ids, scores) of the k best rows of other labels in its window; one pass for all of them."""
        def window(scores, top):
            return (high * scores <= high * top) & (low * top <= high * scores)

        def done(rows, scores, threshold):
            s = scores[self.labels[rows] != label]
            for top in tops:
                if high * threshold < low * top:
                    continue                                   # what is not met lies below the window
                w = s[window(s, top)]
                if len(w) < k or threshold >= np.partition(w, len(w) - k)[len(w) - k]:
                    return False
            return True

        if all(low * t > high * t for t in tops):              # negative scores have empty windows
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tops]
        rows, scores = self.search(anchor, done)
        other = self.labels[rows] != label
        rows, scores = rows[other], scores[other]
        out = []
        for top in tops:
            w = np.flatnonzero(window(scores, top))
            at = w[self.best(rows[w], scores[w], k)]
            out.append((self.ids[rows[at]], scores[at]))
        return out


def over_shards(index: DataFrame, schema: str, work) -> DataFrame:
    """Run ``work(shard, dim) -> rows`` on every shard, one shard in memory at a time."""
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                blobs = [batch.column(c)[i].as_buffer() for c in range(1, 5)]
                columns = list(zip(*work(Shard(*blobs), batch.column(0)[i].as_py())))
                if columns:
                    names = [c.split()[0] for c in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return index.select("dim", "ids", "labels", "q", "lists").mapInArrow(job, schema)


def mine(table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, low: int = LOW, high: int = HIGH, scale: int = SCALE, moved: int = MOVED, labels: int = LABELS,
         key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: see the module's text."""
    rows = materialise(usable(table, key, vector, label, scale, moved, labels), "rows")
    index = shards(rows)
    anchors = rows.where(F.col("id") % every == 0)
    blocks = math.ceil(anchors.count() / BLOCK)
    schema, path = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", scratch(table.sparkSession, "negatives")
    table.sparkSession.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        asked = [(r["id"], r["label"], np.array(r["q"], np.int64)) for r in block]

        def first(shard: Shard, dim: int, asked=asked):
            for id_, lab, q in asked:
                if len(q) == dim:
                    for other, score in zip(*shard.positives(id_, lab, q, positives)):
                        yield id_, other, score

        near = over_shards(index, "anchor_id long, positive_id long, positive_score long", first)
        order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        near = materialise(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n"), "positives")
        by_anchor: dict[int, list] = {}
        for r in near.collect():                               # at most `positives` rows for each anchor of the block
            by_anchor.setdefault(r["anchor_id"], []).append((r["positive_id"], r["positive_score"]))

        def second(shard: Shard, dim: int, asked=asked, by_anchor=by_anchor):
            for id_, lab, q in asked:
                wanted = by_anchor.get(id_)
                if wanted and len(q) == dim:
                    tops = [s for _, s in wanted]
                    for (positive, top), (ids, scores) in zip(wanted, shard.negatives(lab, q, tops, negatives, low, high)):
                        for other, score in zip(ids, scores):
                            yield id_, positive, other, top, score

        over_shards(index, schema, second).write.mode("append").parquet(path)
    found = table.sparkSession.read.schema(schema).parquet(path)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
