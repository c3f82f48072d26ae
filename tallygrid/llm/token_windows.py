"""Substring dedup over words: remove every word covered by a window of ``width`` words that starts anywhere else too.

Rabin-Karp hashes are rolled over each document's words. Windows that can occur twice are found by their anchors
(see ``anchors``): a stretch of words that occurs again as a whole is decided there, and where the words around an equal
anchor differ, every window in question is counted in Spark under two 64-bit hashes. Repeated windows merge into
maximal intervals, which are cut out.

Ties and odd input: a null text has no words; texts under ``width`` words lose nothing; rows with the same id and
text are one document and no repeat of each other; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import anchors as A
from tallygrid.llm import common as C

WIDTH, GRAM = 35, 17
#: Words whose hashes a worker remembers.
CACHE = 200_000


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(raw) -> list[bytes]:
    """The words of a text given as UTF-8: bytes.split cuts at exactly these six characters."""
    return bytes(raw).split()


def word_symbols(raw, cache: WordHashes) -> np.ndarray:
    w = words(raw)
    return np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))


_CACHE = WordHashes()


def _anchors_of(sampler: A.Sampler):
    def run(batch: pa.RecordBatch):
        key = batch.column(0).to_numpy(zero_copy_only=False)
        per = [word_symbols(t.as_buffer(), _CACHE) for t in batch.column(1)]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in per])]).astype(np.int64)
        flat = A.mix(np.concatenate(per)) if per else np.zeros(0, np.uint64)
        pos, doc, ah, fh = sampler.anchors(lambda lo, hi: flat[lo:hi], offs)
        return key[doc], pos - offs[doc], ah, fh
    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, spans (word intervals cut out, start and end pairs), kept (the other words, joined by one space)."""
    sampler = A.Sampler(width, gram)
    side = sampler.side
    all_rows, docs = C.keyed(docs, key, text)
    buckets = C.bucket_count(docs)
    found = A.find(docs, _anchors_of(sampler), buckets, every=True)

    def rows(text_, pos, _hot):
        h = A.mix(word_symbols(text_, _CACHE))
        start = (pos[:, None] - np.arange(side, -1, -1)[None, :]).ravel()
        start = np.unique(start[(start >= 0) & (start + width <= len(h))])
        return start, sampler.hashes(sampler.prefix(h), start, start + width), sampler.hashes(sampler.prefix(A.mix(h ^ np.uint64(0x5555))), start, start + width)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "spans": [], "kept": []}
            for text_, kinds, payloads in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                w = words(text_.as_buffer())
                a, b = A.spans_of(kinds or [], payloads or [], len(w), sampler)
                spans = np.stack([a, b], 1).ravel().tolist()
                edges = [0, *spans, len(w)]
                out["n_words"].append(len(w))
                out["n_removed"].append(int((b - a).sum()))
                out["spans"].append(spans)
                out["kept"].append(b" ".join(x for p, q in zip(edges[::2], edges[1::2]) for x in w[p:q]).decode())
            yield pa.RecordBatch.from_pydict(out, schema=OUT)

    windows = A.count_windows(rows, docs, found, buckets, every=True)
    marked = A.with_marks(all_rows, found, windows)
    return marked.select("doc_id", "text", "kinds", "payloads").mapInArrow(apply, "doc_id long, n_words long, n_removed long, spans array<long>, kept string")


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())])


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
