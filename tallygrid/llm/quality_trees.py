"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (lengths, character classes, words, lines, repetition) are computed in tasks. The trees are fitted on a
bounded sample of labelled rows: the ``SAMPLE`` rows with the smallest hash of their doc_id, all of them where there are
fewer. Features are cut into at most ``BINS`` histogram bins; trees grow level by level on sums of gradients and
curvatures. The fitted trees are flattened into arrays (feature, threshold, value; children of node i are 2i + 1 and
2i + 2), which travel to the tasks, where numpy walks all rows of a batch down all trees at once.

Only the text makes a score. A null text counts as empty and gets a score too. Labels that are null or name no document
play no part; of several labels of a document the lowest counts. Without labels of both kinds every
score is the share of good ones (one half without any). Rows and ids, null ones and repeated ones, are kept.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 20_000, 64, 80, 4, 0.15, 10.0, 1.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

FEATURES = ["chars", "bytes_per_char", "words", "mean_word", "long_words", "short_words", "upper", "digit", "space", "punct", "symbol", "caps_words", "end_marks", "distinct_words", "top_word",
            "lines", "mean_line", "short_lines", "ended_lines", "repeated_lines", "distinct_bigrams", "pipe", "bang", "percent_star_hash", "comma_stop", "brace_markup", "vowel", "entropy", "longest_word", "title_words"]

_KIND = np.zeros((9, 256), np.int64)
_KIND[0, ord("A"):ord("Z") + 1] = 1
_KIND[1, ord("0"):ord("9") + 1] = 1
_KIND[2, [9, 10, 11, 12, 13, 32]] = 1
_KIND[3, [i for i in range(33, 127) if not chr(i).isalnum()]] = 1
_KIND[4, [ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = 1
_KIND[5, [ord(c) for c in ".!?"]] = 1
_KIND[6, [ord(c) for c in "%*#$&"]] = 1
_KIND[7, [ord(c) for c in "{}<>[]"]] = 1
_KIND[8, [ord(c) for c in "aeiouAEIOU"]] = 1


def statistics(raw: bytes) -> list[float]:
    """The features of one text given as UTF-8."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(data, minlength=256)
    chars = int(n - count[128:192].sum())
    upper, digit, space, punct, symbol, ends, mix, brace, vowel = (_KIND @ count).tolist()
    words = raw.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    # runs of capitals and of capital first letters, by the byte before and after
    is_space = _KIND[2][data] > 0
    is_upper = _KIND[0][data] > 0
    first = np.flatnonzero(~is_space & np.append(True, is_space[:-1]))
    title = int(is_upper[first].sum())
    second = np.minimum(first + 1, n - 1)
    caps = int((is_upper[first] & is_upper[second] & (second > first)).sum())
    lines = raw.split(b"\n")
    sizes_l = np.fromiter(map(len, lines), np.int64, len(lines))
    ended = sum(x.endswith((b".", b"!", b"?")) for x in lines)
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    share = count[count > 0] / n
    stop = count[ord(",")] + count[ord(".")]
    return [np.log1p(chars), n / chars, np.log1p(len(words)), float(sizes.mean()), float((sizes > 12).sum()) / w, float((sizes < 4).sum()) / w, upper / n, digit / n, space / n, punct / n, symbol / n,
            caps / w, ends / w, distinct / w, float(np.bincount(np.minimum(sizes, 64)).max()) / w, np.log1p(len(lines)), float(sizes_l.mean()), float((sizes_l < 40).mean()), ended / len(lines),
            1 - len(set(lines)) / len(lines), pairs / max(1, len(words) - 1), count[ord("|")] / w, count[ord("!")] / w, mix / w, stop / w, brace / w, vowel / n, float(-(share * np.log2(share)).sum()),
            float(sizes.max()), title / w]


# ---- trees ---------------------------------------------------------------------------------------------------------

@dataclass
class Trees:
    """Flattened trees: row t of each array is a complete binary tree."""
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(v) + 1)) - 1):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosting of the logistic loss with histograms."""
    nodes = (1 << depth + 1) - 1
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(feature[:0], threshold[:0], value[:0], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)      # bin b: x <= cuts[b]
    flat = binned + np.arange(x.shape[1]) * BINS
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            at, size = (1 << level) - 1, 1 << level
            place = ((node - at)[:, None] * (x.shape[1] * BINS) + flat).ravel()
            shape = (size, x.shape[1], BINS)
            g = np.bincount(place, np.repeat(grad, x.shape[1]), size * x.shape[1] * BINS).reshape(shape).cumsum(2)
            h = np.bincount(place, np.repeat(hess, x.shape[1]), size * x.shape[1] * BINS).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt ** 2 / (ht + RIDGE)
            gain[(h < LEAST / 10) | (ht - h < LEAST / 10)] = -1
            best = gain.reshape(size, -1).argmax(1)
            for i, b in enumerate(best):
                j, c = divmod(int(b), BINS)
                if gain[i, j, c] > 1e-9 and c < len(cuts[j]):
                    feature[k, at + i], threshold[k, at + i] = j, cuts[j][c]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[k][node]] > threshold[k][node])
        leaf = (1 << depth) - 1
        g = np.bincount(node - leaf, grad, 1 << depth)
        h = np.bincount(node - leaf, hess, 1 << depth)
        value[k, leaf:] = -rate * g / (h + RIDGE)
        total += value[k][node]
    return Trees(feature, threshold, value, base)


# ---- Spark ---------------------------------------------------------------------------------------------------------

def held_out(doc_id):
    """True for the fold that no label is learnt from."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % FOLDS) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Fit on the bounded sample. The sample's ids, at most ``sample``, are the only thing that is broadcast."""
    chosen = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("double").alias("y")).where("key is not null and y is not null").where(~held_out(F.col("key")))
    chosen = chosen.groupBy("key").agg(F.min("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key").select("key", "y", "text")
    out = pa.schema([("key", pa.int64()), ("y", pa.float64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(statistics(bytes(t.as_buffer())), "<f8").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], schema=out)

    # repeated rows of an id could pass the bound: one for each id
    got = rows.mapInArrow(run, "key long, y double, x binary").groupBy("key").agg(F.min(F.struct("x", "y")).alias("r")).select("key", "r.x", "r.y").collect()
    got.sort(key=lambda r: r["key"])
    x = np.array([np.frombuffer(r["x"], "<f8") for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], float))


def score(docs: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every text."""
    rest = [c for c in docs.columns if c != name]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn(name, F.lit(0.0)).schema
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(bytes(t.as_buffer()) if t.is_valid else b"") for t in batch.column(at)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.score(x))], names=[*rest, name])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name=name).where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
