"""Which windows of a fixed length can occur twice at all.

Every window of ``width`` symbols names one of its grams, the one with the smallest hash (the leftmost of
equals): its anchor. Equal windows name equal anchors at the same offset, so a window whose anchor hash occurs
once in the corpus occurs once. Only the anchors, about two in (width - gram), are shuffled, and every decision is
exact: nothing is lost by the sampling.

The stretch around an anchor that the windows naming it can reach is its fragment. A fragment that occurs
again as a whole needs no closer look; where fragments differ around an equal anchor, the caller compares them.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import common as C

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 18
LOW = U((1 << 24) - 1)
#: Anchors with so many different fragments in one Arrow batch count as hot there.
HOT = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: What each byte value adds to a rolling hash.
BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


class Sampler:
    """Rolling (Rabin-Karp) hashes modulo 2**64 over symbols, and the anchors of all windows."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram, self.side = width, gram, width - gram
        self._p = self._q = np.ones(0, U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._p) < n:
            size = max(n, CHUNK + 4 * self.width)
            with np.errstate(over="ignore"):
                self._p = np.cumprod(np.full(size, BASE, U))
                self._q = np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), U))
        return self._p, self._q

    def __getstate__(self):
        return {"width": self.width, "gram": self.gram}

    def __setstate__(self, s):
        self.__init__(s["width"], s["gram"])

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * self.powers(len(symbols))[0][:len(symbols)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each stretch [start, end), wherever it lies."""
        return mix((prefix[end] - prefix[start]) * self.powers(len(prefix))[1][start] + (end - start).astype(U))

    def anchors(self, symbols: Callable[[int, int], np.ndarray], offsets: np.ndarray):
        """(position, document, anchor hash, fragment hash) of all anchors of documents laid end to end."""
        n, w, g, side = int(offsets[-1]), self.width, self.gram, self.side
        starts, ends = offsets[:-1], offsets[1:]
        whole = ends - starts >= w
        first, last = starts[whole], ends[whole] - w            # first and last window of each document
        out = []
        for c0 in range(0, n, CHUNK):
            c1 = min(n, c0 + CHUNK)
            a, b = np.searchsorted(last, c0), np.searchsorted(first, c1)
            if a >= b:
                continue
            lo, hi = max(0, c0 - side), min(n, c1 + 2 * w)
            h = self.prefix(symbols(lo, hi))
            inverse = self.powers(hi - lo + 1)[1]
            base = c0 - lo
            m = hi - c0 - g + 1                                  # grams that start in [c0, hi - g]
            if m < side + 1:
                continue
            x = (h[base + g:] - h[base:-g]) * inverse[base:base + m] * U(0xD6E8FEB86659FD93)
            x = (x & ~LOW) | np.arange(m, dtype=U)
            span, have = side + 1, 1
            while have < span:                                  # smallest of `span` neighbours by doubling
                step = min(have, span - have)
                x = np.minimum(x[:len(x) - step], x[step:])
                have += step
            edge = np.zeros(c1 - c0 + 1, np.int32)
            np.add.at(edge, np.maximum(first[a:b], c0) - c0, 1)
            np.add.at(edge, np.minimum(last[a:b] + 1, c1) - c0, -1)
            valid = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            at = (x[valid] & LOW).astype(np.int64)
            if not len(at):
                continue
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            doc = np.searchsorted(starts, at + c0, "right") - 1
            pos = at + c0
            frag_a, frag_b = np.maximum(starts[doc], pos - side), np.minimum(ends[doc], pos + w)
            ah = self.hashes(h, pos - lo, pos - lo + g)
            fh = mix(self.hashes(h, frag_a - lo, frag_b - lo) + (pos - frag_a).astype(U))
            out.append((pos, doc, ah, fh))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0, U), np.zeros(0, U)
        pos, doc, ah, fh = (np.concatenate(c) for c in zip(*out))
        keep = np.concatenate([[True], pos[1:] != pos[:-1]])     # the same anchor seen from two chunks
        return pos[keep], doc[keep], ah[keep], fh[keep]


# ---- exchange of anchors -------------------------------------------------------------------------------------------

ANCHOR = ("u8", "u8", "i8", "u4", "u1")                         # anchor, fragment, key, position, flag
DECIDED, MANY, SALTED, TOKEN = 1, 2, 4, 8
#: What the comparison finds, a row for each document, kind and bucket.
FOUND = "key long, kind int, payload binary"
FOUND_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Kinds: anchors of fragments that occur again, anchors to look at closer, starts of windows that occur again.
AGAIN, ASK, WINDOW = 0, 1, 2


def route(ah: np.ndarray, fh: np.ndarray, key: np.ndarray, pos: np.ndarray, buckets: int):
    """Bucket and columns (see ``ANCHOR``) of the anchors of one batch.

    Of equal fragments in the batch only the first goes to the anchor's bucket, marked as one of many; the others
    are decided and are spread by document. An anchor with many different fragments in the batch is spread by
    fragment, and one token row tells the anchor's own bucket of it."""
    order = np.lexsort((pos, key, fh, ah))
    ah, fh, key, pos = ah[order], fh[order], key[order], pos[order].astype(np.uint32)
    if not len(ah):
        return np.zeros(0, np.int32), [ah, fh, key, pos, np.zeros(0, np.uint8)]
    new_a = C.runs([ah])
    new_f = new_a | C.runs([fh])
    group_a, group_f = np.cumsum(new_a) - 1, np.cumsum(new_f) - 1
    many = np.bincount(group_f)[group_f] > 1
    hot = np.bincount(group_a, weights=new_f)[group_a] >= HOT
    flag = np.where(new_f, MANY * many + SALTED * hot, DECIDED).astype(np.uint8)
    by = np.where(new_f, np.where(hot, mix(ah ^ (fh << U(1))), ah), mix(key.astype(U)))
    cols = [ah, fh, key, pos, flag]
    token = np.flatnonzero(new_a & hot)
    if len(token):
        cols = [np.concatenate([c, c[token]]) for c in cols]
        cols[4][-len(token):] = TOKEN
        by = np.concatenate([by, ah[token]])
    return ((by >> U(20)) % U(buckets)).astype(np.int32), cols


def found_rows(key: np.ndarray, kind: int, *cols: np.ndarray) -> list[pa.RecordBatch]:
    """One row for each document: its packed columns."""
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    k, cols = key[order], [c[order] for c in cols]
    cuts = np.flatnonzero(C.runs([k]))
    ends = np.append(cuts[1:], len(k))
    blobs = [b"".join(c[a:b].tobytes() for c in cols) for a, b in zip(cuts, ends)]
    return [pa.RecordBatch.from_arrays([pa.array(k[cuts]), pa.array(np.full(len(cuts), kind, np.int32)), pa.array(blobs, pa.binary())], schema=FOUND_ARROW)]


def compare(cols: list[np.ndarray], every: bool, kind: int = AGAIN) -> list[pa.RecordBatch]:
    """Fragments that occur again (``every``: their first occurrence too), then the anchors to look at closer:
    one occurrence of each fragment where the fragments of an anchor differ. Position and a flag for hot anchors."""
    decided = (cols[4] & DECIDED) > 0
    out = found_rows(cols[2][decided], kind, cols[3][decided])
    ah, fh, key, pos, flag = (c[~decided] for c in cols)
    if not len(ah):
        return out
    order = np.argsort(ah, kind="stable")
    group = np.cumsum(C.runs([ah[order]])) - 1
    order = order[(np.bincount(group)[group] > 1) | (flag[order] > 0)]   # anchors that occur once go
    order = order[np.lexsort((pos[order], key[order], (flag[order] & TOKEN) > 0, fh[order], ah[order]))]
    ah, fh, key, pos, flag = (c[order] for c in (ah, fh, key, pos, flag))
    if not len(ah):
        return out
    new_a = C.runs([ah])
    new_f = new_a | C.runs([fh])
    ga, gf = np.cumsum(new_a) - 1, np.cumsum(new_f) - 1
    token = (flag & TOKEN) > 0                                  # stands for rows in other buckets
    twice = np.bincount(gf, weights=np.where(token, 0, 1 + ((flag & MANY) > 0)))[gf] > 1
    again = twice & ~token if every else ~new_f & ~token
    out += found_rows(key[again], kind, pos[again])
    kinds = np.bincount(ga, weights=new_f)
    spread = np.bincount(ga, weights=(flag & (TOKEN | SALTED)) > 0) > 0
    ask = new_f & ~token & ((kinds > 1) | spread)[ga]
    hot = (spread | (kinds > 16 * HOT))[ga]
    return out + found_rows(key[ask], ASK, pos[ask], hot[ask].astype(np.uint8))


def find(docs: DataFrame, anchors_of: Callable, buckets: int, every: bool) -> DataFrame:
    """``anchors_of(batch) -> (key, position, anchor hash, fragment hash)`` over (key, text) rows, compared; written once."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, pos, ah, fh = anchors_of(batch)
            yield C.blob_rows(*route(ah, fh, key, pos, buckets), schema=C.BLOB)

    blobs = docs.select("key", "text").mapInArrow(send, "bucket int, payload binary")
    return C.materialise(C.per_bucket(blobs, buckets, ANCHOR, lambda _, c: compare(c, every), FOUND), "anchors")


def asked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, text, payloads) of the documents with anchors to look at closer."""
    asks = found.where(F.col("kind") == ASK).groupBy("key").agg(F.collect_list("payload").alias("payloads"))
    return docs.select("key", "text").join(asks, "key")


def ask_columns(payloads) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hot flags of one document, ascending."""
    pos = np.concatenate([np.frombuffer(p, "u4", len(p) // 5) for p in payloads]).astype(np.int64)
    hot = np.concatenate([np.frombuffer(p, "u1", len(p) // 5, len(p) // 5 * 4) for p in payloads]) > 0
    order = np.argsort(pos, kind="stable")
    return pos[order], hot[order]


def count_windows(rows: Callable, docs: DataFrame, found: DataFrame, buckets: int, every: bool) -> DataFrame:
    """``rows(key, text, positions, hot) -> (start, hash, second hash)`` of the windows to be counted in Spark; those that occur again."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for key, text, payloads in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                start, h1, h2 = rows(text.as_buffer(), *ask_columns(payloads))
                if len(start):
                    parts.append((h1, h2, np.full(len(start), key, np.int64), start))
            if parts:
                yield C.blob_rows(*route(*(np.concatenate(c) for c in zip(*parts)), buckets), schema=C.BLOB)

    blobs = asked(docs, found).mapInArrow(send, "bucket int, payload binary")
    return C.per_bucket(blobs, buckets, ANCHOR, lambda _, c: compare(c, every, WINDOW), FOUND).where(F.col("kind") == WINDOW)


def spans_of(kinds, payloads, length: int, sampler: Sampler) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of one document covered by what was found, as starts and ends."""
    a, b = [], []
    for kind, p in zip(kinds, payloads):
        at = np.frombuffer(p, "u4").astype(np.int64)
        a.append(np.maximum(at - sampler.side, 0) if kind == AGAIN else at)
        b.append(np.minimum(at + sampler.width, length))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def with_marks(docs: DataFrame, *found: DataFrame) -> DataFrame:
    """(key, doc_id, text, kinds, payloads): every document with what was found in it."""
    every = found[0].where(F.col("kind") != ASK)
    for f in found[1:]:
        every = every.unionByName(f)
    marks = every.groupBy("key").agg(F.collect_list(F.struct("kind", "payload")).alias("m"))
    marks = marks.select("key", F.col("m.kind").alias("kinds"), F.col("m.payload").alias("payloads"))
    return docs.join(marks, "key", "left").select("key", "doc_id", "text", "kinds", "payloads")
