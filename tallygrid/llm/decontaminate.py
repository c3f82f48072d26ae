"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters and digits, lower-cased; weights are how often a five-word shingle occurs. For each number of words
that a benchmark item has, the windows of so many words of a document are compared with the items of that size: a window is
reduced to a 64-bit SimHash of its shingles, a multi-index over eight 8-bit blocks finds all items within ``RADIUS``
bits (some block then differs in at most RADIUS / 8 bits), and the weighted Jaccard similarity of the shingles,
exact, must reach ``SIMILARITY``.

A window of that similarity has at least 2 s / (1 + s) of its shingles in the benchmark, so windows with fewer
such shingles are passed over; nothing is lost by it.

The benchmark is sent to every task in blocks of at most ``BLOCK_BYTES``; larger benchmarks take more passes. A document
with fewer words than an item is one window. Texts with fewer than five words are one shingle, and so are the windows of
an item of that size in a longer document; items without words match nothing. Null texts count as empty; equal items each get their rows; repeated documents each get their rows.
"""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.chunks import Chunks

WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 22, 8
BLOCK_BYTES = 4 * 1024 * 1024
KEEP = 300_000
WORD = re.compile(r"\w+")
#: Shingles compared at a time.
STEP = 1 << 18
U = np.uint64
POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, i, 1 << 64) for i in range(WORDS)], U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in WORD.findall(text.lower())], U)


def _of_runs(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    per = [WORD.findall(r.decode().lower()) for r in runs]
    return np.array([xxhash.xxh3_64_intdigest(w) for ws in per for w in ws], U), np.fromiter(map(len, per), np.int64, len(per))


#: The hashes of the words in each run of text without white space.
_known_runs = Chunks(_of_runs, KEEP, U)


def batch_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts end to end, and where each begins; what ``word_hashes`` gives for each."""
    _known_runs.trim()
    numbers = [_known_runs.numbers(bytes(t.as_buffer()).split() if t.is_valid else []) for t in texts]
    _known_runs.learn()
    flat, sizes = [], []
    for at in range(0, len(numbers), 500):
        part = [_known_runs.gather(x) for x in numbers[at:at + 500]]
        sizes += map(len, part)
        flat += part
    return np.concatenate(flat) if flat else np.zeros(0, U), np.append(0, np.cumsum(sizes)).astype(np.int64)


def shingles(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A hash for each run of ``words`` words, five at most; fewer words make one."""
    words = min(words, len(h))
    if words == 0:
        return h[:0]
    last = len(h) - words + 1
    s = h[:last] * POWERS[0]
    for i in range(1, words):
        s = s + h[i:last + i] * POWERS[i]
    return _mix(s if words == WORDS else s + U(words))


def simhash(rows: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of shingle hashes, bits by majority of the weights."""
    bits = np.unpackbits(rows.astype("<u8").view(np.uint8).reshape(*rows.shape, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(1, dtype=np.int64) > rows.shape[1], axis=1, bitorder="little").view("<u8").ravel()


def needed(m: int, k: int, similarity: float) -> int:
    """Shingles that sets of m and k must share to be so similar."""
    return max(1, math.ceil(similarity * (m + k) / (1 + similarity) - 1e-9))


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.weights, by_size = [], defaultdict(list)
        same: dict[bytes, int] = {}
        self.ids: list[list] = []
        for item_id, text in items:
            h = word_hashes(text or "")
            if not len(h):
                continue
            known = same.get(h.tobytes())
            if known is not None:
                self.ids[known].append(item_id)
                continue
            same[h.tobytes()] = len(self.ids)
            by_size[len(h)].append(len(self.ids))
            self.ids.append([item_id])
            self.weights.append(Counter(shingles(h).tolist()))
        fps = [simhash(np.array([[*w.elements()]], U))[0] for w in self.weights]
        self.tables = {}
        for n, members in by_size.items():
            fp = np.array([fps[i] for i in members], U)
            near = [[[] for _ in range(256)] for _ in range(BLOCKS)]
            reach = [sum(1 << i for i in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(8), r)]
            for k, x in enumerate(fp.tolist()):
                for b in range(BLOCKS):
                    for flip in reach:
                        near[b][(x >> 8 * b & 255) ^ flip].append(k)
            self.tables[n] = (np.array(members), fp, near)
        self.all = np.unique(np.array([s for w in self.weights for s in w], U))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.all & U((1 << 20) - 1)).astype(np.int64)] = True

    def known(self, s: np.ndarray) -> np.ndarray:
        """Which shingles occur in the benchmark."""
        out = self.bitmap[(s & U((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at) and len(self.all):
            i = np.minimum(np.searchsorted(self.all, s[at]), len(self.all) - 1)
            out[at] = self.all[i] == s[at]
        return out

    def search(self, h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item number -> (similarity, first word, words) of its most similar window among the words hashed in ``h``, the first of equals."""
        best: dict[int, tuple[float, int, int]] = {}
        runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}     # by their words: shingles, how many before each are known
        for n, (members, fp, near) in self.tables.items():
            size = min(n, len(h))                               # words of a window
            m, k = max(1, size - WORDS + 1), max(1, n - WORDS + 1)
            words = min(size, WORDS)
            if words not in runs:
                s = shingles(h, words)
                runs[words] = s, np.append(0, np.cumsum(self.known(s)))
            s, before = runs[words]
            if not before[-1]:
                continue
            start = np.flatnonzero(before[m:] - before[:-m] >= needed(m, k, self.similarity))
            if m == 1:                                          # equal windows of one shingle: the first tells all
                start = start[np.sort(np.unique(s[start], return_index=True)[1])]
            for lo in range(0, len(start), 2000):
                part = start[lo:lo + 2000]
                rows = s[part[:, None] + np.arange(m)[None, :]]
                for at, row, f in zip(part.tolist(), rows, simhash(rows).tolist()):
                    found = {i for b in range(BLOCKS) for i in near[b][f >> 8 * b & 255]}
                    close = [i for i in found if (f ^ int(fp[i])).bit_count() <= self.radius]
                    if not close:
                        continue
                    have = Counter(row.tolist())
                    for i in close:
                        item = int(members[i])
                        share = sum((have & self.weights[item]).values())
                        similarity = share / (m + k - share)
                        if similarity >= self.similarity and similarity > best.get(item, (0.0,))[0]:
                            best[item] = (similarity, at, size)
        return best


    def search_batch(self, flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
        """(row, what ``search`` finds) of the texts with a shingle of the benchmark."""
        sizes = np.diff(offsets)
        rows = np.flatnonzero((sizes > 0) & (sizes < WORDS))
        for words in {min(n, WORDS) for n in self.tables}:
            for lo in range(0, len(flat) - words + 1, STEP):
                hit = lo + np.flatnonzero(self.known(shingles(flat[lo:lo + STEP + words - 1], words)))
                doc = np.searchsorted(offsets, hit, "right") - 1
                rows = np.union1d(rows, doc[hit + words <= offsets[doc + 1]])       # a run over the end of a text is none of its shingles
        for row in rows.tolist():
            h = flat[offsets[row]:offsets[row + 1]]
            found = self.search(h)
            if found:
                yield row, found


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of the benchmark, of bounded size each."""
    rows = benchmark.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield Index([tuple(r) for r in part.collect()])


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the most similar window of each document for each item it holds."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])
    found = None
    for index in blocks(benchmark):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols: list[list] = [[], [], [], [], []]
                for row, found in shared.value.search_batch(*batch_hashes(batch.column(1))):
                    doc = batch.column(0)[row].as_py()
                    for item, (similarity, start, n) in found.items():
                        for item_id in shared.value.ids[item]:
                            for c, x in zip(cols, (doc, item_id, similarity, start, n)):
                                c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types)], schema=out)

        part = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window similar to an item, with their columns."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text)
    for index in blocks(benchmark):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in shared.value.search_batch(*batch_hashes(batch.column(at)))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
