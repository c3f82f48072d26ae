"""Spelling variants: words one edit apart, found through PartEnum signatures of their letter multisets.

A word is the binary vector of its letters, one dimension for each letter and copy of it (``aab`` sets a1, a2, b1). One inserted or
deleted letter changes one dimension, one replaced letter two, so near words lie within Hamming distance two. The dimensions
are dealt into ``PARTS`` parts; two vectors within distance two agree on all but two of them, so they share one of
the signatures that PARTS - 2 parts make. One edit also leaves either the first or the last half of the shortest word allowed
unchanged, so each signature goes with both ends and a near pair shares one of the two: this loses nothing and keeps the groups of
equal signatures small. Signatures meet in an equi-join, which verifies the pair; only verified pairs leave it.

Counting is a group sum over all runs, combined in each task. A frequent word is one row of the vocabulary however often it occurs, its
near words are bounded by its letters, and a signature that many words share is split by the skew handling of the join.

Null texts hold no words. A null id alters no run of its text. Every row counts, repeated rows too. Other columns play no part. An empty table
gives an empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import common as C
from tallygrid.llm.anchors import mix
from tallygrid.session import materialise

EVERY, MIN_CHARS, MIN_COUNT, RATIO = 199, 6, 5, 5
#: Parts of the letter dimensions; PARTS - 2 of them make a signature.
PARTS = 4
#: Letters from frequent to rare, so that every part gets frequent ones; the others follow by code point.
OFTEN = "etaoinshrdlcumwfgypbvkjxqz"
LETTERS = 26 + 64
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


#: Lower-cased bytes, and which of them belong to a letter; the second byte of a letter beyond z follows 0xC3.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[0xC3] = True
#: Bytes of text that are split at once, and the longest run, in bytes, whose checksum is taken along with others.
SLICE, LONG = 1 << 23, 64


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = crc_table()


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, continued from the checksum ``before`` of what precedes it; one byte of all runs at a time."""
    out = before.copy()
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[start[i]:start[i] + size[i]].tobytes(), int(before[i]))
    at = np.flatnonzero(size <= LONG)
    shorter = (LONG - size[at]).astype(np.uint8)
    order = np.argsort(shorter, kind="stable")
    at, shorter = at[order], shorter[order]
    first, state = start[at], ~before[at]
    for j, n in enumerate(np.searchsorted(shorter, LONG - np.arange(LONG), "left")):   # the runs longer than j
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ data[first[:n] + j]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[at] = ~state
    return out


def runs_of(ids: list, column: pa.Array, every: int, min_chars: int) -> Iterator[pa.Array]:
    """The altered runs of a batch of texts, a slice of texts at a time."""
    raw, offsets = C.string_parts(column)
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        low = LOWERED[raw[offsets[a]:offsets[b]]]
        inside = LETTER[low]
        inside[1:] |= low[:-1] == 0xC3
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets[a:b + 1] - offsets[a]] = True
        padded = np.concatenate([[False], inside, [False]])
        start = np.flatnonzero(padded[1:] & (~padded[:-1] | edge))
        end = np.flatnonzero(padded[:-1] & (~padded[1:] | edge))
        keep = end - start >= min_chars
        start, end = start[keep], end[keep]
        wide = np.flatnonzero(low == 0xC3)
        if len(wide):
            keep = end - start - (np.searchsorted(wide, end) - np.searchsorted(wide, start)) >= min_chars
            start, end = start[keep], end[keep]
        per_doc = np.diff(np.searchsorted(start, offsets[a:b + 1] - offsets[a]))
        before = np.repeat(np.array([zlib.crc32(f"{i}:".encode()) for i in ids[a:b]], np.uint32), per_doc)
        known = np.repeat(np.array([i is not None for i in ids[a:b]], bool), per_doc)
        hit = known & (checksums(low, start, end - start, before) % np.uint32(every) == 0)
        change = np.zeros(len(low) + 1, np.int8)
        change[start[~hit]] += 1
        change[end[~hit]] -= 1
        ends = np.concatenate([[0], np.cumsum((end - start)[~hit])])
        yield pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(low[np.cumsum(change[:-1], dtype=np.int8).view(bool)]))
        changed = []
        for i in np.flatnonzero(hit):
            word = low[start[i]:end[i]].tobytes().decode()
            at = zlib.crc32(word.encode(), int(before[i])) % len(word)
            changed.append(word[:at] + word[at + 1:])
        yield pa.array([w for w in changed if len(w) >= min_chars], pa.string())
        a = b


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters, one code point deleted where ``every`` divides the run's checksum in its document.

    Shorter runs cannot become words and are left out at once. Each slice of texts is counted before it leaves its task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs_of(batch.column(0).to_pylist(), batch.column(1), every, min_chars):
                found = words.value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

    return C.texts(docs, key, text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letter numbers end to end, offsets of the words): a-z are 0 to 25, U+00C0 to U+00FF follow."""
    raw, offsets = C.string_parts(column)
    keep = raw != 0xC3                                          # the lead byte of every letter beyond z
    before = np.concatenate([[0], np.cumsum(keep)])
    b = raw[keep].astype(np.int64)
    return np.where(b < 128, b - 97, b - 128 + 26), before[offsets]


def signatures(column: pa.Array, half: int, parts: int = PARTS) -> np.ndarray:
    """(words, signatures): 64-bit keys; words within distance two with a common end share at least one."""
    code, offsets = letters(column)
    n = len(column)
    row = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((code, row))
    c, r = code[order], row[order]
    new = C.runs([r, c])
    start = np.flatnonzero(new)
    copy = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    rank = np.array([OFTEN.index(x) for x in sorted(OFTEN)] + list(range(26, LETTERS)))
    part = (rank[c] + copy) % parts
    with np.errstate(over="ignore"):
        weight = mix((c * 1_000_003 + copy + 1).astype(U) * GOLD)
        sums = np.zeros((parts, n), U)
        for p in range(parts):
            at = part == p
            np.add.at(sums[p], r[at], weight[at])
        ends = []
        for side in (0, 1):
            at = offsets[:-1] if side == 0 else offsets[1:] - half
            h = np.full(n, side + 1, U)
            for i in range(half):
                h = h * U(LETTERS + 1) + code[at + i].astype(U)
            ends.append(mix(h * GOLD))
        out = []
        for number, chosen in enumerate(combinations(range(parts), parts - 2)):
            s = np.full(n, number + 1, U) * GOLD
            for p in chosen:
                s = mix(s + sums[p])
            out += [mix(s ^ e) for e in ends]
    return np.stack(out, 1).view(np.int64)


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, parts: int = PARTS) -> DataFrame:
    """(a, a_n, b, b_n), a < b: the words of (word, n) that differ by exactly one inserted, deleted or replaced code point."""
    half = min_chars // 2

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = signatures(batch.column(0), half, parts)
            at = pa.array(np.repeat(np.arange(len(batch)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["s", "word", "n"])

    signed = words.select("word", "n").mapInArrow(sign, "s long, word string, n long")
    a, b = (signed.select("s", F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab")
    # the estimate of the signed rows is that of the words, thirty times too low: never broadcast them
    return a.join(b.hint("merge"), "s").where((F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form reached. Forms grow in count at each step, so paths are short; each round doubles the step."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").limit(1).isEmpty():
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, root, n_near: every word with its near words' number, its form and the last form it leads to."""
    words = materialise(vocabulary(docs, key, text, every, min_chars, min_count), "words")
    pairs = near_pairs(words, min_chars)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")
    stats = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    rows = words.join(stats, "word", "left")
    takes = -F.col("best.m") >= ratio * F.col("n")
    rows = materialise(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n")), "forms")
    last = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
