"""Language-model scores by a hidden Markov model.

Texts are token sequences: lower-cased words (A-Z only), then one end. A latent state follows each step; a
state draws the next state and a token. Baum-Welch trains it: every task runs scaled forward and backward recursions over its training
texts and adds up its expected counts, Spark adds up those of all tasks, the driver divides. The score is the exact log-likelihood, all state paths summed,
by the scaled forward recursion.

What a state can draw: a token whose share of the training tokens is at least ``SHARE`` has a probability of its own in each state, so there are at most
1 / SHARE of them at any corpus size. The others are drawn by class (checksum of their last two code points), and within the class by their own
smoothed counts, which all training texts have made. A token never seen in training is one symbol with its base probability. Every state's
probabilities thus sum to one over the vocabulary and the unseen symbol, as those of the base score do. Counts are smoothed towards the base distribution.

Spark's part: texts are packed into blocks with the block's distinct words and written once; each block sends its distinct words and their
counts (not its tokens) to the buckets of a word hash, which add up and send the corpus counts back. Broadcast are the tokens of large share with their parameters, at most 1 / SHARE of them and ``CLASSES``.
The driver holds sums for these symbols only. Start values are the base distribution, tilted at random for each state; every round uses all training texts.

Rows are scored one by one, repeated ids and texts too; a null text is empty and holds the end alone. A null id has no checksum: it is training text. Without any training
text nothing is known, and every token is the unseen symbol. An empty table gives an empty result. Other columns play no part.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm import common as C
from tallygrid.llm.spelling import checksums
from tallygrid.session import materialise

MODULO, HELD = 7, 2
STATES, ROUNDS, SEED = 8, 6, 11
SHARE, CLASSES = 1 / 65_536, 1_024
#: Weight of the base distribution in every state, in tokens; weight of even transitions.
PRIOR, EVEN = 200.0, 1.0
#: Text bytes of a block (a longer text is a block of its own), tokens that step together, tokens whose states are kept at once.
BLOCK_BYTES, BATCH_TOKENS, KEPT_TOKENS = 1 << 23, 1 << 21, 1 << 16
#: Expected counts leave a task as integers of this unit, so that their sum does not depend on the order of tasks.
UNIT = 1 << 16
#: The end; no word holds a space.
END = " "


def words_of(column: pa.Array) -> pa.ListArray:
    """Lower-cased words of each text."""
    raw, offsets = C.string_parts(column)
    low = LOWER[raw]                                            # ASCII capitals down, all ASCII white space to one kind
    texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low))
    return pc.split_pattern(texts, " ")


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32


def planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, byte by byte of all: the high bytes are nearly all zero."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_words(column: pa.Array) -> bytes:
    raw, offsets = C.string_parts(column)
    size = np.diff(offsets).astype("<u4")
    return zstandard.compress(len(size).to_bytes(8, "little") + size.tobytes() + raw.tobytes(), 1)


def unpack_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets)"""
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, np.uint8, -1, 8 + 4 * n), np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64)])


def crc(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return checksums(data, start, end - start, np.zeros(len(start), np.uint32)).astype(np.int64)


def class_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of every word: checksum of its last two code points."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(lead, offsets[:-1]), np.searchsorted(lead, offsets[1:])
    return crc(data, lead[np.maximum(first, last - 2)], offsets[1:]) % CLASSES


def pack_blocks(docs: DataFrame, key: str, text: str, modulo: int, held: int, buckets: int) -> DataFrame:
    """Texts of a task in blocks, and what the blocks ask, written once.

    Block rows (block, docs, tokens, words, train): ``docs`` has id, tokens, whether null, whether held out of each text, ``tokens`` the numbers of
    distinct words, ``train`` the number of training tokens. Request rows (block, bucket, asked): words of the block that the bucket adds up, with their places
    and how often they stand in training text."""
    names = ["block", "docs", "tokens", "words", "train", "bucket", "asked"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            offsets = C.string_parts(batch.column(1))[1]
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
                yield from block(number, batch.slice(a, b - a))
                number += 1
                a = b

    def block(number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = words_of(batch.column(1))
        flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        keep = pc.not_equal(flat, "")
        kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)])
        coded = flat.filter(keep).dictionary_encode()
        del flat, lists
        n = len(coded.dictionary)
        ends = kept[ends]
        sizes = np.diff(ends)
        tokens = np.insert(coded.indices.to_numpy().astype(np.uint32), ends[1:], n)           # the end after each text
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        out = ~null & (np.array([zlib.crc32(str(i).encode()) % modulo for i in ids.tolist()], np.int64) == held)
        train = np.repeat(~out, sizes + 1)
        counts = np.bincount(tokens[train], minlength=n + 1)
        words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])])
        yield rows(1, block=[number], docs=[C.pack(ids, sizes + 1, null, out)], tokens=[planes(tokens)], words=[pack_words(words)], train=[int(train.sum())])
        raw, offsets = C.string_parts(words)
        dealt = list(C.split_by((crc(raw, offsets[:-1], offsets[1:]) >> 7) % buckets))
        asked = [C.pack(at.astype("<u4"), counts[at]) for _, at in dealt]
        spelled = [pack_words(words.take(pa.array(at))) for _, at in dealt]
        yield rows(len(dealt), block=[number] * len(dealt), bucket=[x for x, _ in dealt], asked=asked, words=spelled)

    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialise(texts.mapInArrow(send, "block long, docs binary, tokens binary, words binary, train long, bucket int, asked binary"), "blocks")


def count_words(packed: DataFrame, total: int, buckets: int) -> DataFrame:
    """Counts of all words, added up bucket by bucket, written once: replies (block, got: places and counts of its words), words of large
    share (word, c), and for every class the sum of c + 1 (class, c), with the number of distinct training words as class -1."""
    types = [pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    names = ["block", "got", "word", "class", "c"]

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def count(held: list) -> Iterator[pa.RecordBatch]:
        blocks, places, counts, texts = zip(*held)
        column = pa.chunked_array([pa.LargeStringArray.from_buffers(len(o) - 1, pa.py_buffer(o), pa.py_buffer(d)) for d, o in texts]).combine_chunks().dictionary_encode()
        sums = np.zeros(len(column.dictionary), np.int64)
        which = column.indices.to_numpy()
        np.add.at(sums, which, np.concatenate(counts))
        a = 0
        for number, at in zip(blocks, places):
            yield rows(1, block=[number], got=[C.pack(at, sums[which[a:a + len(at)]])])
            a += len(at)
        seen = sums > 0
        large = np.flatnonzero(seen & (sums >= total * SHARE))
        if len(large):
            yield rows(len(large), word=column.dictionary.take(pa.array(large)).cast(pa.string()), c=sums[large])
        per_class = np.zeros(CLASSES, np.int64)
        np.add.at(per_class, class_of(*C.string_parts(column.dictionary))[seen], sums[seen] + 1)
        yield rows(CLASSES + 1, **{"class": np.arange(-1, CLASSES), "c": np.append(int(seen.sum()), per_class)})

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now and held:
                    yield from count(held)
                    held = []
                now = bucket
                at, c = C.unpack(batch.column(2)[i].as_buffer(), "<u4", "i8")
                held.append((batch.column(1)[i].as_py(), at, c, unpack_words(batch.column(3)[i].as_buffer())))
        if held:
            yield from count(held)

    dealt = packed.where("bucket is not null").select("bucket", "block", "asked", "words").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return materialise(dealt.mapInArrow(job, "block long, got binary, word string, class int, c long"), "counts")


def code(packed: DataFrame, counted: DataFrame, total: int, distinct: int, own: list[str], class_sums: np.ndarray) -> DataFrame:
    """(docs, symbols, sums): blocks with their tokens as symbols. ``sums``: known tokens, base score and constant part of the score of each text. Symbols: words of large share, then classes, then the unseen one."""
    m = len(own)
    floor = math.log10(total + distinct + 1)
    back = counted.where("block is not null").groupBy("block").agg(F.collect_list("got").alias("got"))   # as much as the block has asked
    shipped = packed.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(own)})
    schema = "docs binary, symbols binary, sums binary"

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value
        for batch in batches:
            for i in range(len(batch)):
                data, offsets = unpack_words(batch.column(2)[i].as_buffer())
                count = np.zeros(len(offsets) - 1, np.int64)
                for got in batch.column(3)[i].values:
                    at, c = C.unpack(got.as_buffer(), "<u4", "i8")
                    count[at] = c
                symbol = np.where(count > 0, m + class_of(data, offsets), m + CLASSES)
                large = np.flatnonzero((count > 0) & (count >= total * SHARE))
                symbol[large] = [number[data[offsets[j]:offsets[j + 1]].tobytes().decode()] for j in large]
                base = np.log10(count + 1.0) - floor
                # a rarer word is drawn within its class by its share of the class
                extra = np.where((symbol >= m) & (count > 0), np.log10(count + 1.0) - np.log10(class_sums[np.clip(symbol - m, 0, CLASSES - 1)]), 0.0)
                sizes = C.unpack(batch.column(0)[i].as_buffer(), "i8", "i8", "?", "?")[1]
                tokens = from_planes(batch.column(1)[i].as_buffer())
                starts = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x[tokens], starts) for x in ((count > 0).astype(np.int64), base, extra)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([planes(symbol.astype(np.uint32)[tokens])]), pa.array([C.pack(*sums)])], names=["docs", "symbols", "sums"])

    blocks = packed.where("docs is not null").select("block", "docs", "tokens", "words")
    return materialise(blocks.join(back.hint("merge"), "block").select("docs", "tokens", "words", "got").mapInArrow(turn, schema), "coded")


# ---- recursions ----------------------------------------------------------------------------------------------------

class Model:
    """Start, transitions and draws: draw[symbol, state]."""

    def __init__(self, start: np.ndarray, move: np.ndarray, draw: np.ndarray):
        self.start, self.move, self.draw = start, move, draw


def in_step(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts that step together: of similar length, BATCH_TOKENS at most unless one alone is longer; longest first in each."""
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH_TOKENS, "right")))
        yield order[a:b]
        a = b


def interleave(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts (longest first) step by step, and the number of texts in each step."""
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    offset = np.cumsum(live) - live
    at = np.arange(live.sum()) - np.repeat(offset, live)
    return symbols[starts[at] + np.repeat(np.arange(len(live)), live)], live


def stretches(live: np.ndarray) -> list[tuple[int, int]]:
    """Steps in stretches of about KEPT_TOKENS tokens."""
    group = (np.cumsum(live) - live) // KEPT_TOKENS
    cuts = np.append(np.flatnonzero(C.runs([group])), len(live))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def forward(model: Model, draws: np.ndarray, live: np.ndarray, state: np.ndarray | None, keep: bool):
    """One stretch of steps from ``state``: the last state of every text, the scales of all tokens and, if kept, all states.

    Texts that have ended keep their last state."""
    scales = np.empty(len(draws))
    every = np.empty_like(draws) if keep else None
    ones = np.ones(draws.shape[1])
    last = np.empty((live[0], draws.shape[1])) if state is None else state.copy()
    now, a = state, 0
    for n in live.tolist():
        x = draws[a:a + n]
        if now is None:
            new = x * model.start
        else:
            new = now[:n] @ model.move
            new *= x
        scale = np.dot(new, ones, out=scales[a:a + n])
        new /= scale[:, None]
        if keep:
            every[a:a + n] = new
        if now is not None and n < len(now):
            last[n:len(now)] = now[n:]
        now = new
        a += n
    last[:len(now)] = now
    return last, scales, every


def by_text(scales: np.ndarray, live: np.ndarray, texts: int) -> np.ndarray:
    """log10 of the scales, added up for each text."""
    text = np.arange(len(scales)) - np.repeat(np.cumsum(live) - live, live)
    return np.bincount(text, np.log10(scales), texts)


def score(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of every text."""
    out = np.zeros(len(sizes))
    starts = np.cumsum(sizes) - sizes
    for group in in_step(sizes):
        x, live = interleave(symbols, starts[group], sizes[group])
        log, state, a = np.zeros(len(group)), None, 0
        for s, t in stretches(live):
            b = a + int(live[s:t].sum())
            state, scales, _ = forward(model, model.draw[x[a:b]], live[s:t], state, False)
            log += by_text(scales, live[s:t], len(group))
            a = b
        out[group] = log
    return out


def expect(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over texts: starts, transitions, draws, and the log10 likelihood."""
    k = len(model.start)
    start, move, draw, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.draw), 0.0
    starts = np.cumsum(sizes) - sizes
    for group in in_step(sizes):
        x, live = interleave(symbols, starts[group], sizes[group])
        ends = np.concatenate([[0], np.cumsum(live)])
        parts = stretches(live)
        states = [None]                                        # before each stretch; the stretches are run again, last first
        for s, t in parts[:-1]:
            states.append(forward(model, model.draw[x[ends[s]:ends[t]]], live[s:t], states[-1], False)[0])
        ahead = None                                           # draw times backward value, scaled, in the first step of the later stretch
        for (s, t), state in zip(reversed(parts), reversed(states)):
            part, offset = live[s:t], (ends[s:t + 1] - ends[s]).tolist()
            draws = model.draw[x[ends[s]:ends[t]]]
            _, scales, alpha = forward(model, draws, part, state, True)
            total += float(np.log10(scales).sum())
            draws /= scales[:, None]
            beta, weight, back = np.ones_like(alpha), draws, np.ascontiguousarray(model.move.T)
            if ahead is not None:
                beta[offset[-2]:offset[-2] + len(ahead)] = ahead @ back
            for i in range(len(part) - 1, -1, -1):
                lo, hi = offset[i], offset[i + 1]
                weight[lo:hi] *= beta[lo:hi]
                if i:
                    beta[offset[i - 1]:offset[i - 1] + hi - lo] = weight[lo:hi] @ back
            # neighbouring steps: the text at place i of a step stands at place i of the one before
            n = int(part[0])
            before = np.arange(n, len(alpha)) - np.repeat(part[:-1], part[1:])
            move += model.move * (alpha[before].T @ weight[n:])
            if state is None:
                start += (alpha[:n] * beta[:n]).sum(0)
            else:
                move += model.move * (state[:n].T @ weight[:n])
            alpha *= beta
            at = x[ends[s]:ends[t]]
            for j in range(k):
                draw[:, j] += np.bincount(at, alpha[:, j], len(draw))
            ahead = weight[:n].copy()
    return start, move, draw, total


def renew(start: np.ndarray, move: np.ndarray, draw: np.ndarray, base: np.ndarray) -> Model:
    """Parameters from expected counts, smoothed; the unseen symbol keeps its base probability."""
    k = len(start)
    start = (start + EVEN / k) / (start.sum() + EVEN)
    move = (move + EVEN / k) / (move.sum(1, keepdims=True) + EVEN)
    seen = draw[:-1] + PRIOR * (base[:-1] / max(base[:-1].sum(), 1e-300))[:, None]
    seen *= (1 - base[-1]) / seen.sum(0)
    return Model(start, move, np.vstack([seen, np.full(k, base[-1])]))


def first_model(base: np.ndarray, _texts: list, states: int) -> Model:
    """Start values, the same whatever texts there are: states that tend to stay, draws of the base tilted at random."""
    rng = np.random.default_rng(SEED)
    draw = base[:, None] * rng.gamma(2.0, 0.5, (len(base), states))
    draw[-1] = base[-1]
    draw[:-1] *= (1 - base[-1]) / np.maximum(draw[:-1].sum(0), 1e-300)
    return Model(np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), draw)


def train(coded: DataFrame, base: np.ndarray, total: int, states: int, rounds: int) -> Model:
    """Baum-Welch, every round over all training texts."""
    spark = coded.sparkSession
    model = first_model(base, [], states)
    names = [f"s{j}" for j in range(states)]
    for _ in range(rounds if total else 0):
        shipped = spark.sparkContext.broadcast((model.start, model.move, model.draw))

        def count(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            model, sums = Model(*shipped.value), None
            for batch in batches:
                for docs, symbols in zip(batch.column(0), batch.column(1)):
                    _, sizes, _, out = C.unpack(docs.as_buffer(), "i8", "i8", "?", "?")
                    x = from_planes(symbols.as_buffer())
                    got = expect(model, x[np.repeat(~out, sizes)], sizes[~out])
                    got = np.vstack([got[2], got[0][None], got[1]])
                    sums = got if sums is None else sums + got
            if sums is not None:
                at = np.flatnonzero(sums.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.rint(c[at] * UNIT).astype(np.int64)) for c in sums.T)], names=["i", *names])

        counted = coded.select("docs", "symbols").mapInArrow(count, "i long, " + ", ".join(f"{n} long" for n in names))
        rows = counted.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toArrow()          # symbols, a start row, a row for each state
        sums = np.zeros((len(base) + 1 + states, states))
        sums[rows.column("i").to_numpy()] = np.stack([rows.column(n).to_numpy() for n in names], 1) / UNIT
        shipped.unpersist()
        model = renew(sums[len(base)], sums[len(base) + 1:], sums[:len(base)], base)
    return model


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulo: int = MODULO, held: int = HELD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each text."""
    spark = docs.sparkSession
    buckets = C.bucket_count(docs)
    packed = pack_blocks(docs, key, text, modulo, held, buckets)
    total = packed.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    counted = count_words(packed, total, buckets)
    rows = counted.where("word is not null").select("word", "c").orderBy("word").collect()      # at most 1 / SHARE
    own, own_counts = [r["word"] for r in rows], np.array([r["c"] for r in rows], np.int64)
    sums = {r["class"]: r["c"] for r in counted.where("class is not null").groupBy("class").agg(F.sum("c").alias("c")).collect()}   # CLASSES + 1 rows
    distinct, class_sums = sums.get(-1, 0), np.array([sums.get(g, 0) for g in range(CLASSES)], np.float64)
    if own:
        np.subtract.at(class_sums, class_of(*C.string_parts(pa.array(own, pa.string()))), own_counts + 1)
    all_ = total + distinct + 1
    base = np.concatenate([own_counts + 1.0, class_sums, [1.0]]) / all_
    coded = code(packed, counted, total, distinct, own, np.maximum(class_sums, 1))
    model = train(coded, base, total, states, rounds)
    shipped = spark.sparkContext.broadcast((model.start, model.move, model.draw))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shipped.value)
        for batch in batches:
            for docs, symbols, sums in zip(*batch.columns):
                ids, sizes, null, out = C.unpack(docs.as_buffer(), "i8", "i8", "?", "?")
                known, base, extra = C.unpack(sums.as_buffer(), "i8", "f8", "f8")
                got = score(model, from_planes(symbols.as_buffer()), sizes) + extra
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(out), pa.array(sizes), pa.array(known), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(got)],
                                                 names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.select("docs", "symbols", "sums").mapInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
