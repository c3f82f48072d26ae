"""Byte-level BPE over a pair occurrence index.

The distinct chunks of text of an Arrow batch are laid end to end as symbols. An index maps each pair, through its
merge rank, to all its positions. The active ranks are taken in ascending order: all positions of the pair are
merged at once, then the pairs that the merged symbols form with their neighbours are added to the lists of
their ranks. Positions whose pair has changed meanwhile are skipped. A new pair never ranks before the merge that made it,
so the result is that of merging the best pair of each chunk again and again.

The vocabulary file is a parameter. Decoding joins the bytes of the ids; bytes that are no UTF-8 become U+FFFD.

Null and empty texts have no ids and decode to the empty string; rows and other columns are kept as they are.
"""
from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.chunks import Chunks

#: White space as the vocabulary's splitter has it, and the splitter's pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Coarser cuts at which no piece is divided: a run without white space and the blank before it, or white space.
CHUNKS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
NONE = np.iinfo(np.int32).max
KEEP = 300_000
#: Chunks gathered into one output batch.
BLOCK = 200_000
#: Texts whose new chunks are merged together.
ROWS = 4_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        back = {c: b for b, c in enumerate(alphabet)}
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NONE where the pair is not merged."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_all(symbols: np.ndarray, first: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Merge within the pieces that begin where ``first`` is true. -1 where a symbol was merged into the one before."""
    n = len(symbols)
    sym = symbols.copy()
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[np.append(np.flatnonzero(first)[1:] - 1, n - 1)] = n
    prv[first] = -1
    sym = np.append(sym, -1)
    rank = np.full(n, NONE, np.int32)
    pairs = np.flatnonzero(nxt < n)
    rank[pairs] = v.rank(sym[pairs], sym[pairs + 1])
    pairs = pairs[rank[pairs] < NONE]
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        """Enter positions under the ranks of their pairs."""
        r = rank[at]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for x, part in zip(r[np.append(0, cuts)].tolist(), np.split(at, cuts)):
            if x in index:
                index[x].append(part)
            else:
                index[x] = [part]
                heapq.heappush(active, x)

    if len(pairs):
        add(pairs)
    while active:
        x = heapq.heappop(active)
        lists = index.pop(x)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[rank[at] == x]
        if not len(at):
            continue
        if len(lists) > 1:
            at = np.unique(at)
        if sym[at[0]] == sym[nxt[at[0]]] and len(at) > 1:       # aaa: every second position of a run, from the left
            new = np.append(True, at[1:] != nxt[at[:-1]])
            begin = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = v.merged[x]
        sym[gone] = -1
        rank[gone] = NONE
        nxt[at] = after
        inner = after < n
        prv[after[inner]] = at[inner]
        before = prv[at]
        left = before[before >= 0]
        touched = np.concatenate([at, left])
        rank[touched] = NONE
        touched = touched[nxt[touched] < n]
        if len(touched):
            rank[touched] = v.rank(sym[touched], sym[nxt[touched]])
            touched = touched[rank[touched] < NONE]
            if len(touched):
                add(touched)
    return sym[:n]


def encode_chunks(chunks: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many chunks at once, one after the other, and their number for each chunk."""
    pieces, per = [], np.empty(len(chunks), np.int64)
    for i, c in enumerate(chunks):
        if c.lstrip(" ").isalpha():                             # one piece of letters, the usual case
            pieces.append(c)
            per[i] = 1
        else:
            found = PIECES.findall(c)
            pieces += found
            per[i] = len(found)
    raw = "".join(pieces).encode("utf-8", "surrogatepass")
    sizes = np.fromiter((len(p.encode("utf-8", "surrogatepass")) for p in pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    first = np.zeros(len(raw), bool)
    first[ends - sizes] = True
    ids = merge_all(v.byte_ids[np.frombuffer(raw, np.uint8)], first, v)
    alive = np.cumsum(ids >= 0)
    chunk_ends = ends[np.cumsum(per) - 1]
    return ids[ids >= 0], np.diff(np.append(0, alive[chunk_ends - 1]))


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(4)
def memory(path: str) -> Chunks:
    v = vocabulary(path)

    def encode(chunks: list) -> tuple[np.ndarray, np.ndarray]:
        # strings of added tokens have an id of their own and stand in the memory as one-element tuples
        plain = [c for c in chunks if isinstance(c, str)]
        ids, n = encode_chunks(plain, v) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(plain) == len(chunks):
            return ids, n
        parts = iter(np.split(ids, np.cumsum(n)[:-1]) if plain else [])
        out = [next(parts) if isinstance(c, str) else np.array([v.added[c[0]]], np.int32) for c in chunks]
        return np.concatenate(out), np.array([len(x) for x in out])

    return Chunks(encode, KEEP)


def cut(text: str, v: Vocabulary) -> list:
    if v.split is None or not any(t in text for t in v.added):
        return CHUNKS.findall(text)
    out: list = []
    for part in v.split.split(text):
        out += [(part,)] if part in v.added else CHUNKS.findall(part)
    return out


def text_of(ids: list[int], table: dict[int, bytes]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` without the text, with its token ids as an array of int. ``decoded``: a column for the text of these ids,
    made in the same pass (one worker then holds the vocabulary, and the ids cross to Spark once)."""
    rest = [c for c in docs.columns if c not in (text, ids, decoded)]
    names = [*rest, ids, *([decoded] if decoded else [])]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn(ids, F.array(F.lit(0)))
    schema = (schema.withColumn(decoded, F.lit("")) if decoded else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary(path), memory(path)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                known.trim()
                numbers = [known.numbers(cut(t.as_py() or "", v)) for t in batch.column(batch.num_columns - 1)]
                known.learn()
                at = 0
                while at < len(numbers):
                    end, size = at, 0
                    while end < len(numbers) and (end == at or size + len(numbers[end]) <= BLOCK):
                        size += len(numbers[end])
                        end += 1
                    parts = [known.gather(x) for x in numbers[at:end]]
                    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))]
                    if decoded:
                        out.append(pa.array([text_of(p.tolist(), v.bytes) for p in parts], pa.string()))
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns[:-1]), *out], names=names)
                    at = end

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text)).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of its token ids; null ids decode to the empty string."""
    rest = [c for c in docs.columns if c not in (text, ids)]
    names = [*rest, ids]
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path).bytes
        for batch in batches:
            out = []
            for x in batch.column(batch.num_columns - 1):
                out.append(text_of(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else [], table))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, text])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode: doc_id, n_tokens and the digests of ids and text."""
    both = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
