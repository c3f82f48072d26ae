"""Near copies by wide SimHash against exact Jaccard similarity of all pairs."""
import random

import numpy as np
import pytest
from brute import similar

from tallygrid.llm import simhash_similar as S


def copies(seed=5):
    """Texts with copies of 1 to 30 changed words, a hub with many copies, odd and long ones."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    rows, n = [], 0
    for size in (6, 12, 40, 150, 400) * 6:
        base = [word() for _ in range(size)]
        rows.append((n, " ".join(base)))
        for share in (.0, .005, .01, .015, .02, .03, .06):
            n += 1
            rows.append((n, " ".join(word() if rng.random() < share else w for w in base).upper()))
        n += 1
    hub = [word() for _ in range(300)]
    for k in range(60):
        rows.append((1000 + k, " ".join(word() if k and rng.random() < .012 else w for w in hub)))
    long = [word() for _ in range(60_000)]
    rows += [(2000, " ".join(long)), (2001, " ".join(long[:-900])), (2002, " ".join(long[:30_000]))]
    return rows + [(3000, None), (3001, ""), (3002, " \t "), (3003, "one two"), (3004, "ONE  two"), (3005, "one two three")]


@pytest.mark.parametrize("crowded", [512, 4])
def test_equal_to_exact_similarity(spark, monkeypatch, crowded):
    monkeypatch.setattr(S, "CROWD", crowded)
    rows = copies()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, fp string, node long").repartition(5)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(set(similar(rows).values()))


def test_crowd_finds_all_that_pairs_find():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (6, S.LANES), dtype=np.uint64)
    bits = np.unpackbits(base.repeat(50, 0).view(np.uint8), axis=1) ^ (rng.random((300, S.BITS)) < rng.choice([.03, .08, .12], (300, 1)))
    fp = np.packbits(bits, axis=1).view("<u8")
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1)
    link = lambda a, b, x, least: {(min(p), max(p)) for p in zip(a[x > least].tolist(), b[x > least].tolist())}
    a, b, x = S.linked(fp, np.zeros(300, int))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if S.SURE < d[i, j] <= S.RADIUS}
    assert link(a, b, x, S.SURE) == want and len(want) > 1000
    root = S.stars(300, a[x <= S.SURE], b[x <= S.SURE])
    a, b, x = S.crowd(fp)
    assert S.stars(300, a[x <= S.SURE], b[x <= S.SURE]).tolist() == root.tolist()
    # pairs that sure links join need no comparison
    assert {p for p in want if root[p[0]] != root[p[1]]} == {p for p in link(a, b, x, S.SURE) if root[p[0]] != root[p[1]]}


def test_shape_keeps_groups_small_and_recall():
    for n in (0, 1, 1000, 10 ** 6, 10 ** 10):
        bits, tables = S.shape(n)
        assert n / 2 ** bits <= S.GROUP and 1 - (1 - (1 - S.differing(.8)) ** bits) ** tables > .98


def test_empty_table_and_odd_ids(spark):
    schema = "doc_id long, text string, lang string"
    assert S.keep_one(spark.createDataFrame([], schema)).count() == 0
    text = "some words that are written down more than once " * 3
    rows = [(None, text, "a"), (None, text, "b"), (1, text, "c"), (1, "another text of the same id", "d"), (1, "another text of the same id", "d"), (2, None, "e"), (3, "", "f")]
    assert sorted(r[2] for r in S.keep_one(spark.createDataFrame(rows, schema)).collect())[1:] == ["d", "e"]
