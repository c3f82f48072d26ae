"""Token ids in binary shards, each one a wavelet matrix in one compressed file.

A shard holds the ids of a range of documents in ascending doc_id order, every document followed by an end id.
Its bit planes, most significant bit first, are stably partitioned by the bits of the plane above; with counts of
ones per block they answer access (the id at a place), rank and count (how often an id occurs before a
place) and select (where it occurs) without the ids themselves.

File: magic, header length, header (JSON), then the parts that the header lists, each compressed on its own:
document ids, their validity, the places where documents end, and for each plane its bits and its counts.

Ids come from the tokenizers library with a vocabulary file that is a parameter; each distinct chunk of text is
encoded once per worker. Null and empty texts hold just the end id. Null doc_ids come first; rows with equal
doc_ids are ordered by their ids. An empty table makes no shard.
"""
from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm import common as C
from tallygrid.llm.bpe_index import byte_alphabet
from tallygrid.llm.chunks import Chunks
from tallygrid.session import materialise, scratch

END_ID = 2
MAGIC = b"WVM1"
BLOCK_BITS = 512
KEEP = 700_000


# ---- one shard -----------------------------------------------------------------------------------------------------

def _counts(bits: np.ndarray) -> np.ndarray:
    """Ones before each block of packed bits."""
    padded = np.zeros(-(-len(bits) // (BLOCK_BITS // 8)) * (BLOCK_BITS // 8), np.uint8)
    padded[:len(bits)] = bits
    ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(1)
    return np.append(0, np.cumsum(ones)).astype(np.uint32)


def build(ids: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of a shard: ids (unsigned), documents in order and the places where they end."""
    x = ids
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    parts, zeros = [doc_ids.astype("<i8"), valid.astype("u1"), ends.astype("<u8")], []
    for b in range(bits - 1, -1, -1):
        one = (x & x.dtype.type(1 << b)) != 0
        packed = np.packbits(one, bitorder="little")
        parts += [packed, _counts(packed)]
        low = np.flatnonzero(~one)
        zeros.append(len(low))
        x = np.concatenate([x.take(low), x.take(np.flatnonzero(one))])      # by place: much faster than by mask
    blobs = [zstandard.compress(np.ascontiguousarray(p).tobytes(), 1) for p in parts]
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "sizes": [len(b) for b in blobs]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *blobs])


class Shard:
    """A shard read back from its file's bytes."""

    def __init__(self, raw: bytes):
        raw = memoryview(raw)
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<I", raw[4:8])[0]
        h = json.loads(bytes(raw[8:8 + size]))
        self.n, self.bits, self.zeros = h["n"], h["bits"], h["zeros"]
        at, parts = 8 + size, []
        for s in h["sizes"]:
            parts.append(zstandard.decompress(raw[at:at + s]))
            at += s
        self.doc_ids = np.frombuffer(parts[0], "<i8")
        self.valid = np.frombuffer(parts[1], "u1") > 0
        self.ends = np.frombuffer(parts[2], "<u8").astype(np.int64)
        self.planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
        self.ones = [np.frombuffer(p, np.uint32) for p in parts[4::2]]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK_BITS
        tail = self.planes[plane][block * BLOCK_BITS // 8:-(-i // 8)]
        ones = int(np.unpackbits(tail, bitorder="little")[:i - block * BLOCK_BITS].sum())
        return int(self.ones[plane][block]) + ones

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for p in range(self.bits):
            bit = int(self.planes[p][i // 8]) >> (i % 8) & 1
            out = out << 1 | bit
            r = self._rank1(p, i)
            i = self.zeros[p] + r if bit else i - r
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the first i places' occurrences of an id lie after the last plane."""
        a, b = 0, i
        for p in range(self.bits):
            ra, rb = self._rank1(p, a), self._rank1(p, b)
            a, b = (self.zeros[p] + ra, self.zeros[p] + rb) if token >> (self.bits - 1 - p) & 1 else (a - ra, b - rb)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often an id occurs before place i."""
        a, b = self._range(token, i) if token >> self.bits == 0 else (0, 0)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a kind: the block by its count, then within the block."""
        ones = self.ones[plane].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK_BITS - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        tail = np.unpackbits(self.planes[plane][block * BLOCK_BITS // 8:(block + 1) * BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(tail == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids: the partitions undone from the last plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~one)] = x[:self.zeros[p]]
            y[np.flatnonzero(one)] = x[self.zeros[p]:] | x.dtype.type(1 << (self.bits - 1 - p))
            x = y
        return x


# ---- the corpus ----------------------------------------------------------------------------------------------------

#: Latin scripts end before U+0250. Their letters have one lower-case letter each, but for a few that the length gives away.
NOT_LATIN = re.compile(r"[^\x00-\u024f]")
_LETTERS, _NUMBERS = (re.escape("".join(chr(i) for i in range(0x250) if unicodedata.category(chr(i))[0] == k)) for k in "LN")
#: What the vocabulary's splitter comes to for printable Latin text, after lower-casing.
PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^ \n{_LETTERS}{_NUMBERS}]+")


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(4)
def memory(path: str) -> Chunks:
    """Ids of what ``cut`` gives: pieces (str) go straight to the library's model, chunks (bytes) the library's whole way."""
    whole, alphabet = tokenizer(path), byte_alphabet()
    model = whole.model

    def of_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        n = np.empty(len(pieces), np.int64)
        for i, c in enumerate(pieces):
            tokens = model.tokenize(c if c.isascii() else "".join([alphabet[b] for b in c.encode()]))
            n[i] = len(tokens)
            flat += [x.id for x in tokens]
        return np.array(flat, np.int32), n

    def of_chunks(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in whole.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(chunks: list) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([type(c) is str for c in chunks])
        if plain.all():
            return of_pieces(chunks)
        # the two kinds apart, then each chunk's ids at its place
        sizes, ids = np.empty(len(chunks), np.int64), []
        for kind, run in ((True, of_pieces), (False, of_chunks)):
            at = np.flatnonzero(plain == kind)
            flat, n = run([chunks[i] for i in at])
            sizes[at] = n
            ids.append((at, flat, n))
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]), np.int32)
        for at, flat, n in ids:
            out[np.repeat(ends[at] - n - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return out, sizes

    return Chunks(encode, KEEP)


def cut(raw: bytes) -> list:
    """What a text's ids are made of, one after the other. A printable Latin text is cut into the vocabulary's pieces here (str);
    any other text only between blanks and line ends, which the vocabulary drops and no piece reaches over (bytes)."""
    s = raw.decode()
    low = s.lower()
    if len(low) == len(s) and "<|" not in s and s.replace("\n", " ").isprintable() and (s.isascii() or not NOT_LATIN.search(low) and unicodedata.is_normalized("NFC", s)):
        return PIECES.findall(low)
    return [c for c in raw.replace(b"\n", b" ").split(b" ") if c]


def bounds(docs: DataFrame, key: str, shards: int) -> list[int]:
    """At most shards - 1 ascending doc_ids that part the rows evenly (quantiles over all rows)."""
    if shards < 2:
        return []
    at = [i / shards for i in range(1, shards)]
    got = docs.select(F.percentile_approx(F.col(key).cast("long"), at, max(10_000, 20 * shards)).alias("b")).first()["b"]
    return sorted(set(got or []))


def write_shards(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the shards below ``folder``, a URI that pyarrow.fs opens, and return their list: shard, path, n_docs, n_tokens."""
    shards = C.bucket_count(docs)
    edges = np.array(bounds(docs, key, shards), np.int64)
    kind = np.dtype("<u2" if max(tokenizer(path).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(path)
        for batch in batches:
            known.trim()
            numbers = [known.numbers(cut(bytes(t.as_buffer()))) for t in batch.column(1)]
            known.learn()
            ids = batch.column(0)
            shard = np.where(np.asarray(ids.is_valid()), np.searchsorted(edges, np.asarray(ids.fill_null(0)), "right"), 0).astype(np.int32)
            blobs = [np.append(known.gather(x), end_id).astype(kind).tobytes() for x in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(blobs, pa.binary())], schema=out)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        now, docs_, blobs = None, [], []

        def close():
            if not blobs:
                return
            sizes = np.array([len(b) // kind.itemsize for b in blobs], np.int64)
            valid = np.array([d is not None for d in docs_])
            raw = build(np.frombuffer(b"".join(blobs), kind), np.array([d or 0 for d in docs_], np.int64), valid, np.cumsum(sizes))
            name = f"{root}/shard-{now:08d}.wvm"
            with fs.open_output_stream(part := f"{root}/.{now}-{os.getpid()}-{np.random.default_rng().integers(1 << 62)}") as f:
                f.write(raw)
            fs.move(part, name)                                 # a task that runs again puts the same file in place
            yield pa.RecordBatch.from_pydict({"shard": [now], "path": [name], "n_docs": [len(sizes)], "n_tokens": [int(sizes.sum())]},
                                             schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for s, d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if s != now:
                    yield from close()
                    now, docs_, blobs = s, [], []
                docs_.append(d)
                blobs.append(b)
        yield from close()

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    dealt = rows.mapInArrow(encode, "shard int, doc_id long, ids binary").repartition(shards, "shard")
    listed = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(write, "shard int, path string, n_docs long, n_tokens long")
    return materialise(listed, "shards")


def starts(listed: DataFrame, group: int = 1024) -> DataFrame:
    """(shard, first): ids in all shards before. Totals of groups of shards first, then inside each group."""
    rows = listed.select("shard", "n_tokens", F.expr(f"shard div {group}").alias("g"))
    totals = rows.groupBy("g").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("g", (F.sum("t").over(Window.orderBy("g")) - F.col("t")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("g").orderBy("shard")) - F.col("n_tokens")
    return rows.withColumn("own", inside).join(before, "g").select("shard", (F.col("own") + F.col("base")).alias("first"))


def read_documents(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """Read the files below ``folder``: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    shard = F.regexp_extract("path", r"shard-(\d+)\.wvm$", 1).cast("int")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(raw.as_buffer())
                ids = s.tokens().astype("<u4")
                begin = np.append(0, s.ends[:-1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin, s.ends)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=~s.valid), pa.array(begin + first), pa.array(s.ends - begin), pa.array(crc, pa.int64())], schema=out)

    firsts = F.broadcast(starts(listed)) if listed.count() < 100_000 else starts(listed)
    joined = files.select(shard.alias("shard"), "content").join(firsts, "shard")
    return joined.select("first", "content").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode, write, read back: one row per document, from the files."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()      # with the scheme of the cluster's file system
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return read_documents(spark, uri, write_shards(docs, path, uri))
