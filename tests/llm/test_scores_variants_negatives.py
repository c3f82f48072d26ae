"""Operators 11 to 13: language-model scores, spelling variants, hard negatives."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import hard_negatives, hidden_markov, spelling

D = "/root/testdata/sf0.001"


def got(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: tuple((x is not None, x) for x in r))


# ---- 11 ------------------------------------------------------------------------------------------------------------

def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", low(text or "")), None]


def base_rows(rows):
    """Everything but the score, by counting."""
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(t for i, x in rows if not out[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in rows:
        t = tokens(x)
        yield i, out[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)


ODD = [None, "", " \t\n", "One ONE one", "x" * 9000, "é É naïve 漢字 \x1f\xa0 word", "a b " * 20_000, "END", " end "]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["red", "blue", "Green", f"r{rng.randrange(90)}"]) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["same text twice"] * 4
    rows = [*((i * 5, t) for i, t in enumerate(texts)), (10, "a repeated id"), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", n, "k", [n], .5, 3) for n, (i, t) in enumerate(rows)], "doc_id long, text string, word string, block long, key string, docs array<int>, score double, n int")
    return docs, rows


def test_scores_count_all_tokens(spark, odd):
    given = spark.read.parquet(f"{D}/documents.parquet")
    for docs, rows in (odd, (given, [(r[0], r[1]) for r in given.select("doc_id", "text").collect()])):
        found = got(hidden_markov.scores(docs, rounds=1), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
        want = sorted(base_rows(rows), key=lambda r: tuple((x is not None, x) for x in r))
        assert [r[:5] for r in found] == [r[:5] for r in want]
        assert all(abs(a[5] - b[5]) <= 1e-9 * (1 + abs(b[5])) for a, b in zip(found, want))


def test_scores_beat_the_base_on_held_out_text(spark):
    rows = hidden_markov.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    n = sum(r["n_tokens"] for r in rows)
    assert len(rows) > 100 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in rows) / n > sum(r["base_score"] for r in rows) / n + 0.2
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.9 * len(rows)


def slow_forward(model, x):
    """Sum over all state paths."""
    a = model.start * model.draw[x[0]]
    for s in x[1:]:
        a = (a @ model.move) * model.draw[s]
    return math.log10(a.sum())


def small_model(symbols=6, states=3, seed=1):
    rng = np.random.default_rng(seed)
    draw = rng.random((symbols, states)) + .05
    move = rng.random((states, states)) + .05
    start = rng.random(states)
    return hidden_markov.Model(start / start.sum(), move / move.sum(1, keepdims=True), draw / draw.sum(0))


def test_forward_sums_all_paths(monkeypatch):
    rng, model = np.random.default_rng(2), small_model()
    sizes = np.array([1, 5, 30, 2, 30, 17, 1])
    x = rng.integers(0, 6, sizes.sum()).astype(np.uint32)
    parts = np.split(x, np.cumsum(sizes)[:-1])
    want = [slow_forward(model, p) for p in parts]
    for kept, batch in ((1 << 17, 1 << 20), (7, 1 << 20), (1, 40)):
        monkeypatch.setattr(hidden_markov, "KEPT_TOKENS", kept)
        monkeypatch.setattr(hidden_markov, "BATCH_TOKENS", batch)
        assert np.allclose(hidden_markov.score(model, x, sizes), want, atol=1e-9)


def test_expected_counts_equal_all_paths(monkeypatch):
    """Against the sum over every state path of short texts."""
    from itertools import product
    model, sizes = small_model(4, 2), np.array([1, 3, 6, 4])
    x = np.random.default_rng(5).integers(0, 4, sizes.sum()).astype(np.uint32)
    start, move, draw, total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for p in np.split(x, np.cumsum(sizes)[:-1]):
        paths = list(product(range(2), repeat=len(p)))
        w = np.array([model.start[h[0]] * np.prod([model.draw[s, j] for s, j in zip(p, h)]) * np.prod([model.move[i, j] for i, j in zip(h, h[1:])]) for h in paths])
        total += math.log10(w.sum())
        for h, v in zip(paths, w / w.sum()):
            start[h[0]] += v
            for s, j in zip(p, h):
                draw[s, j] += v
            for i, j in zip(h, h[1:]):
                move[i, j] += v
    for kept in (1 << 17, 4, 1):
        monkeypatch.setattr(hidden_markov, "KEPT_TOKENS", kept)
        found = hidden_markov.expect(model, x, sizes)
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(found, (start, move, draw, total)))


def test_training_raises_the_likelihood_and_draws_sum_to_one():
    rng, base = np.random.default_rng(3), np.append(np.full(8, 0.12), 0.04)
    sizes = np.full(60, 25)
    x = np.concatenate([rng.integers(0, 4, 25) + 4 * (i % 2) for i in range(60)]).astype(np.uint32)
    model = hidden_markov.first_model(base, [], 3)
    last = -math.inf
    for _ in range(8):
        start, move, draw, total = hidden_markov.expect(model, x, sizes)
        assert total > last - 1e-6
        last, model = total, hidden_markov.renew(start, move, draw, base)
        assert np.allclose(model.draw.sum(0), 1) and np.allclose(model.move.sum(1), 1) and math.isclose(model.start.sum(), 1) and (model.draw[-1] == base[-1]).all()


def test_the_model_is_that_of_plain_rounds_over_all_training_texts(spark, monkeypatch):
    seen, train = {}, hidden_markov.train

    def keep(coded, base, total, states, rounds):
        seen.update(coded=coded, base=base, states=states, model=train(coded, base, total, states, rounds))
        return seen["model"]

    monkeypatch.setattr(hidden_markov, "train", keep)
    hidden_markov.scores(spark.read.parquet(f"{D}/documents.parquet"), rounds=2)
    sizes, texts = [], []
    for docs, symbols in seen["coded"].select("docs", "symbols").collect():
        _, n, _, out = hidden_markov.C.unpack(docs, "i8", "i8", "?", "?")
        sizes.append(n[~out])
        texts.append(hidden_markov.from_planes(symbols)[np.repeat(~out, n)])
    want = hidden_markov.first_model(seen["base"], [], seen["states"])
    for _ in range(2):
        want = hidden_markov.renew(*hidden_markov.expect(want, np.concatenate(texts), np.concatenate(sizes))[:3], seen["base"])
    assert all(np.allclose(getattr(seen["model"], k), getattr(want, k), rtol=1e-4, atol=1e-6) for k in ("start", "move", "draw"))


def test_scores_without_training_text_and_of_nothing(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = got(hidden_markov.scores(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [(i, True, 3, 0, 0) for i in held] and all(r[5] == 0 and abs(r[6]) < 1e-9 for r in rows)
    assert got(hidden_markov.scores(spark.createDataFrame([], "doc_id long, text string"))) == []


# ---- 12 ------------------------------------------------------------------------------------------------------------

def words_by_hand(rows, every=199, least=6, times=5):
    c = Counter()
    for i, x in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            r = low(r)
            h = zlib.crc32(f"{i}:{r}".encode())
            if i is not None and h % every == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            c[r] += 1
    return {w: n for w, n in c.items() if len(w) >= least and n >= times}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(rows, **kw):
    n = words_by_hand(rows, **kw)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), n.get(form[w])


def test_variants_of_odd_texts(spark, odd, monkeypatch):
    rng = random.Random(7)
    stem = ["mountain", "éclairées", "ÿÿÿÿÿÿ", "river×bank", "aaaaaaaa", "ALPHAbet"]
    edits = []
    for s in stem:
        for times in (400, 50, 7, 2):                           # each one edit from the one before
            edits += [s] * times
            j = rng.randrange(len(s))
            s = s[:j] + rng.choice(["q", "é" + s[j:j + 1]]) + s[j + 1:]
    rng.shuffle(edits)
    rows = [(i, " ".join(edits[i::40]) + "-" + "".join(rng.choice("abé") for _ in range(7)) + "." + "z" * (5000 if i < 6 else 3)) for i in range(40)] + odd[1] + [(None, "mountain mountan")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, word string, s int").repartition(3)
    for every in (199, 2):
        want = sorted(variants_by_hand(rows, every=every))
        assert any(r[1] for r in want) and (every < 199 or any(r[2] not in (r[0], r[1]) for r in want))
        assert got(spelling.variants(docs, every=every)) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    monkeypatch.setattr(spelling, "SLICE", 50)                  # texts cut into many slices
    assert got(spelling.vocabulary(docs)) == sorted(words_by_hand(rows).items())


def test_variants_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert got(spelling.variants(docs)) == sorted(variants_by_hand(rows), key=lambda r: tuple((x is not None, x) for x in r))
    assert got(spelling.variants(docs.limit(0))) == []


def test_signatures_lose_no_near_pair():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(1500)})
    for parts in (3, 4, 5):
        keys = [set(r) for r in spelling.signatures(pa.array(words), 3, parts).tolist()]
        assert all(keys[i] & keys[j] for i in range(len(words)) for j in range(i) if one_edit(words[i], words[j]))


def test_checksums_equal_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    start, size = rng.integers(0, 3000, 300), rng.integers(0, 130, 300)
    before = rng.integers(0, 1 << 32, 300, dtype=np.uint32)
    want = [zlib.crc32(data[a:a + n].tobytes(), int(b)) for a, n, b in zip(start, size, before)]
    assert spelling.checksums(data, start, size, before).tolist() == want


# ---- 13 ------------------------------------------------------------------------------------------------------------

def mined_by_hand(rows, positives=5, negatives=5):
    ok = {}
    for i, x, label in rows:
        if i is None or label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(v)) for v in x])
        ok[i] = min(ok.get(i, r), r)
    for a, (la, qa) in ok.items():
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(qa, q)), i, lab) for i, (lab, q) in ok.items() if i != a and len(q) == len(qa))
        for p, pid, _ in [r for r in s if r[2] == la][:positives]:
            took = [r for r in s if r[2] != la and 80 * -p <= 100 * -r[0] <= 100 * -p][:negatives]
            yield from ((a, pid, k + 1, n, -p, -sc) for k, (sc, n, _) in enumerate(took))


def test_negatives_with_ties_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((900, 5)) * .4 + rng.integers(0, 2, (900, 1))).round(1)
    x[300:520] = x[300]                                         # many ties, several labels
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1100, [], 1), (1200, [0.0] * 5, 1), (1300, [float("nan")] * 5, 1), (1400, [None] * 5, 1), (1500, [float("inf")] * 5, 1), (1600, [.5] * 5, None), (None, [.5] * 5, 1),
             (1700, [.5] * 3, 2), (1800, [.25] * 3, 2), (1801, [.5] * 3, 1), (-100, [-.5] * 5, 1), (200, [.1] * 5, 3), (200, [.1] * 5, 3), (301, [9.0] * 5, 0), (2100, [1.0] * 2, 5)]
    table = spark.createDataFrame([(i, v, lab, 1, "x", 2, 3) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, id int, q string, part int, rank int").repartition(4)
    want = sorted(mined_by_hand(rows))
    assert len(want) > 150 and got(hard_negatives.mine(table)) == want
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    assert got(hard_negatives.mine(table)) == want
    assert got(hard_negatives.mine(table, positives=2, negatives=9)) == sorted(mined_by_hand(rows, 2, 9))
    assert got(hard_negatives.mine(table.limit(0))) == []


def test_threshold_stops_before_the_ends_of_the_lists():
    rng = np.random.default_rng(4)
    n = 4000
    q = np.floor(256 * rng.standard_normal((n, 3))).astype(np.int32)
    q[:10] = [3000, 3000, 3000]
    lists = np.ascontiguousarray(np.argsort(q, 0, kind="stable").T.astype(np.uint32))
    shard = hard_negatives.Shard(np.arange(n).tobytes(), np.zeros(n, np.int64).tobytes(), q.tobytes(), lists.tobytes())
    met = []
    search = shard.search
    shard.search = lambda a, done: met.append(search(a, done)) or met[-1]
    ids, scores = shard.positives(-1, 0, np.array([5, 7, 9]), 5)
    assert ids.tolist() == [0, 1, 2, 3, 4] and set(scores.tolist()) == {63000} and len(met[0][0]) < n / 2


def test_negatives_of_the_given_vectors(spark):
    table = spark.read.parquet(f"{D}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert got(hard_negatives.mine(table)) == sorted(mined_by_hand(rows))
