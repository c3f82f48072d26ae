"""Suffix-array dedup: remove every byte covered by a string of ``width`` bytes that also starts earlier.

The collection's suffixes are ordered by column-wise construction. Only stretches around repeated anchors
(see ``anchors``) can hold a repeated string; Spark deals them to buckets by anchor, so that all places of one
string meet. The stretches of a bucket are its documents, aligned at the anchor. Going from the last column to the first,
each round inserts one symbol per document: a stable sort of the running order by that symbol gives the
next column of the Burrows-Wheeler transform, and the common prefixes follow from range minima over those of
the round before. The columns are written to and read from one sequential file (in memory up to a bound, then on
the worker's disk, gone with the task). Neighbours with a common prefix of ``width`` or more hold the same string;
all but the earliest are removed.

Anchors with very many different stretches are not gathered: their windows are counted by hash (128 bits), spread
over all buckets.

Ties and odd input: a null text counts as empty; texts under ``width`` bytes lose nothing; rows with the same id and
text are one document, which is not its own repeat; an empty table gives an empty result.
"""
from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import anchors as A
from tallygrid.llm import common as C

WIDTH, GRAM = 100, 40
#: A task keeps its columns in memory up to this size.
MEMORY = 64 << 20


def removed_windows(matrix: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, width: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the windows of ``width`` symbols in aligned documents that an earlier row (by ``rank``) also holds
    in that column. Row i has symbols from column side - left[i] up to side + right[i]; windows start in columns 0..side."""
    m, columns = matrix.shape
    with tempfile.SpooledTemporaryFile(MEMORY) as file:
        for j in range(columns - 1, -1, -1):                    # written once, in the order in which the rounds read
            column = matrix[:, j].astype(np.uint16)
            column[(j < side - left) | (j >= side + right)] = 256
            file.write(column.tobytes())
        file.seek(0)
        order, lcp = np.arange(m), np.zeros(m + 1, np.int32)
        rows, starts = [], []
        for j in range(columns - 1, -1, -1):
            symbol = np.frombuffer(file.read(2 * m), np.uint16)[order]
            move = np.argsort(symbol, kind="stable")
            order, symbol = order[move], symbol[move]
            # common prefix with the row above: one more than the least on the way, in the round before, between the two
            ends = np.empty(2 * m, np.int64)
            ends[0], ends[1] = 0, 1
            ends[2::2] = move[:-1] + 1
            ends[3::2] = move[1:] + 1
            longer = np.minimum.reduceat(lcp, ends)[::2] + 1
            new = np.zeros(m + 1, np.int32)
            same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] < 256)) + 1
            new[same] = longer[same]
            lcp = new
            if j <= side:
                run = np.cumsum(lcp[:m] < width) - 1
                if run[-1] + 1 < m:
                    first = np.minimum.reduceat(rank[order], np.flatnonzero(lcp[:m] < width))
                    hit = order[rank[order] > first[run]]
                    rows.append(hit)
                    starts.append(np.full(len(hit), j))
    return (np.concatenate(rows), np.concatenate(starts)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _anchors_of(sampler: A.Sampler):
    def run(batch: pa.RecordBatch):
        key = batch.column(0).to_numpy(zero_copy_only=False)
        data, offs = C.string_parts(batch.column(1))
        pos, doc, ah, fh = sampler.anchors(lambda lo, hi: A.BYTE_SYMBOLS[data[lo:hi]], offs)
        return key[doc], pos - offs[doc], ah, fh
    return run


def repeats(rows: DataFrame, docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``rows`` and ``docs`` as ``common.keyed`` gives them: (key, doc_id, text, kinds, payloads), the marks of every row."""
    sampler = A.Sampler(width, gram)
    side, span = sampler.side, width + sampler.side
    buckets = C.bucket_count(docs)
    found = A.find(docs, _anchors_of(sampler), buckets, every=False)
    types = ("u8", "i8", "u4", "u1", "u1", f"{span}u1")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for key, text, payloads in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                pos, hot = A.ask_columns(payloads)
                pos = pos[~hot]
                if not len(pos):
                    continue
                left, right = np.minimum(pos, side), np.minimum(len(raw) - pos, width)
                padded = np.concatenate([np.zeros(side, np.uint8), raw, np.zeros(width, np.uint8)])
                rows = np.lib.stride_tricks.sliding_window_view(padded, span)[pos]
                h = sampler.prefix(A.BYTE_SYMBOLS[raw])
                parts.append((sampler.hashes(h, pos, pos + gram), np.full(len(pos), key, np.int64), pos.astype(np.uint32),
                              left.astype(np.uint8), right.astype(np.uint8), rows))
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts)]
                yield C.blob_rows(((cols[0] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32), cols, schema=C.BLOB)

    def order(_bucket: int, cols: list[np.ndarray]) -> list[pa.RecordBatch]:
        _, key, pos, left, right, rows = cols
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((pos, key))] = np.arange(len(key))
        row, start = removed_windows(rows, left.astype(int), right.astype(int), rank, width, side)
        return A.found_rows(key[row], A.WINDOW, (pos[row].astype(np.int64) - side + start).astype(np.uint32))

    blobs = A.asked(docs, found).mapInArrow(cut, "bucket int, payload binary")
    near = C.materialise(C.per_bucket(blobs, buckets, types, order, A.FOUND), "columns")

    def hot_rows(text, pos, hot):
        raw = np.frombuffer(text, np.uint8)
        pos = pos[hot]
        if not len(pos):
            return pos, pos, pos
        start = np.unique((pos[:, None] - np.arange(side, -1, -1)[None, :]).ravel())
        start = start[(start >= 0) & (start + width <= len(raw))]
        h = sampler.prefix(A.BYTE_SYMBOLS[raw])
        second = sampler.prefix(A.mix(A.BYTE_SYMBOLS[raw] ^ np.uint64(0x5555)))
        return start, sampler.hashes(h, start, start + width), sampler.hashes(second, start, start + width)

    spread = A.count_windows(hot_rows, docs, found, buckets, every=False)
    return A.with_marks(rows, found, near, spread)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (start and end pairs), kept (bytes, since a cut may
    fall inside a character)."""
    sampler = A.Sampler(width, gram)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept": []}
            for text_, kinds, payloads in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = memoryview(text_.as_buffer())
                a, b = A.spans_of(kinds or [], payloads or [], len(raw), sampler)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int((b - a).sum()))
                out["n_spans"].append(len(a))
                out["spans"].append(np.stack([a, b], 1).ravel().tolist())
                edges = [0, *out["spans"][-1], len(raw)]
                out["kept"].append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_pydict(out, schema=OUT)

    marked = repeats(*C.keyed(docs, key, text), width, gram)
    return marked.select("doc_id", "text", "kinds", "payloads").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
