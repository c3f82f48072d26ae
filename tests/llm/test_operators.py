import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import (earlier_bytes, leaks, lines, near, nearest, repeated_words, sha, shard_rows)
from pyspark.sql import functions as F

from tallygrid.llm import (anchors, bpe_index, column_suffix, common, decontaminate, graph, line_bloom, pstable,
                           quality_trees, simhash_pivot, token_windows, wavelet)

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
D = "/root/testdata/sf0.001"


def got(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    return docs, sorted((r[0], r[1]) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, ties, and columns with names that operators use inside."""
    rng = random.Random(5)
    common = "a passage that many of the documents share word for word and line by line, far longer than a window " * 2
    texts = [None, "", " \n\t\n", "x", "The SAME line\nthe same LINE \n  other", common, common.upper(), "ab" * 300, "a" * 500, "é" * 120 + " naïve ﷽ 漢字 😀 " * 9]
    texts += [f"{''.join(rng.choice('abc ') for _ in range(40))}\nShared line\n{common if i % 3 else ''}{i}" for i in range(30)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(6000)) + common]
    rows = [(i * 3, t, "en", i, f"k{i}", [i], 1.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key long, payload string, kinds array<int>, score double")
    return docs, [(r[0], r[1]) for r in rows]


def test_bytes_removed(given, odd):
    for docs, rows in (given, odd):
        assert got(column_suffix.digest(column_suffix.remove_repeats(docs))) == sorted(earlier_bytes(rows))


def test_words_removed(given, odd):
    for docs, rows in (given, odd):
        assert got(token_windows.digest(token_windows.remove_repeats(docs))) == sorted(repeated_words(rows))


def test_crowded_anchors_are_spread(spark, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", 3)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "the common passage of text " * rng.randint(0, 2) + "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60)))) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width, gram in ((20, 8), (20, 13)):
        assert got(column_suffix.digest(column_suffix.remove_repeats(docs, width, gram))) == sorted(earlier_bytes(rows, width))
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) + " x y z q r s t " * rng.randint(0, 2) + " ".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(token_windows.digest(token_windows.remove_repeats(docs, 9, 4))) == sorted(repeated_words(rows, 9))


def test_column_wise_construction():
    rng = np.random.default_rng(4)
    side, width = 5, 6
    rows = rng.integers(0, 2, (60, side + width)).astype(np.uint8)
    left, right = rng.integers(0, side + 1, 60), rng.integers(1, width + 1, 60)
    rank = rng.permutation(60)
    found = set(zip(*(x.tolist() for x in column_suffix.removed_windows(rows, left, right, rank, width, side))))
    want = set()
    for c in range(side + 1):
        ok = [i for i in range(60) if c >= side - left[i] and c + width <= side + right[i]]
        for i in ok:
            if any((rows[j, c:c + width] == rows[i, c:c + width]).all() and rank[j] < rank[i] for j in ok):
                want.add((i, c))
    assert found == want


def test_lines(given, odd):
    for docs, rows in (given, odd):
        assert got(line_bloom.digest(line_bloom.drop_lines(docs))) == sorted(lines(rows))
    docs, rows = odd
    assert got(line_bloom.digest(line_bloom.drop_lines(docs, 3, 2, keep_first=True))) == sorted(lines(rows, 3, 2, True))


def test_near_duplicates(given, odd):
    for docs, rows in (given, odd):
        assert got(simhash_pivot.near_duplicates(docs)) == sorted(near(rows))
    docs, rows = odd
    kept = simhash_pivot.keep_one(docs)
    assert kept.columns == docs.columns
    assert got(kept, "doc_id") == sorted({(c,) for _, _, c in near(rows)})


def test_pivot_search_finds_every_pair():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre ^ sum(np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64) for _ in range(k)) for k in (0, 1, 1, 2, 2, 3, 4)]))
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fp.tolist()) for b in fp.tolist()[:i] if (a ^ b).bit_count() <= 2}
    for blocks in (3, 4, 5, 6):
        mask = np.array(simhash_pivot.masks(blocks), np.uint64)
        assert all(any((a ^ b) & int(m) == 0 for m in mask) for a, b in want)
    a, b = simhash_pivot.linked(fp, np.zeros(len(fp), int))
    assert {tuple(sorted(p)) for p in zip(fp[a].tolist(), fp[b].tolist())} == want
    root = simhash_pivot.stars(6, np.array([5, 3, 4]), np.array([3, 1, 2]))
    assert root.tolist() == [0, 1, 2, 1, 2, 1]


def test_finer_blocks_give_the_same_links(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fp = sorted({base ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 62, (150, 2))})
    distinct = spark.createDataFrame([(x,) for x in fp], "fp long")
    a = got(graph.components(simhash_pivot.links(distinct)))
    assert a == got(graph.components(simhash_pivot.links(distinct, group_rows=1))) and len(a) > 100


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long")
    assert got(graph.components(edges)) == sorted([(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)])
    assert got(graph.components(edges.limit(0))) == []


def _library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


NASTY = "ab c  \n\t\r\x0b\x1c\x1f\x85\xa0 　'sétrllve19²½Ⅷ漢字́😀!?-_,.  aaaa'S İßΣςABZ"
EXTRA = ["<|endoftext|>", "<|startoftext|>", " the", "'ll", "  ", " \n", "A. ", "b, ", ".,"]


@pytest.fixture(scope="module")
def nasty(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 1009, "".join(rng.choice(NASTY) if rng.random() < .9 else rng.choice(EXTRA) for _ in range(rng.randint(0, 80)))) for i in range(1009)]
    rows += [(5000, None), (5001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows


def test_bpe_equals_the_library(given, odd, nasty):
    t = _library(BYTE)
    for docs, rows in (given, odd, nasty):
        want = []
        for i, x in rows:
            ids = t.encode(x or "", add_special_tokens=False).ids
            want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
        assert got(bpe_index.digest(docs, BYTE)) == sorted(want)


def test_bpe_keeps_other_columns(odd):
    docs, rows = odd
    e = bpe_index.encode(docs, BYTE)
    assert e.columns == [*[c for c in docs.columns if c != "text"], "ids"]
    assert got(bpe_index.encode(docs, BYTE, decoded="back"), "doc_id", "back") == sorted((i, x or "") for i, x in rows)
    back = bpe_index.decode(e, BYTE)
    assert got(back, "doc_id", "decoded", "payload") == sorted((i, x or "", f"k{n}") for n, (i, x) in enumerate(rows))


def test_bpe_of_random_ids_decodes_like_the_library(spark):
    rng = random.Random(8)
    t = _library(BYTE)
    rows = [(i, [rng.randrange(50257) for _ in range(6)]) for i in range(200)]
    df = bpe_index.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), BYTE)
    assert got(df, "doc_id", "decoded") == [(i, t.decode(x, skip_special_tokens=False)) for i, x in rows]


def test_shards_equal_the_library(given, odd, nasty):
    t = _library(WORD)
    for docs, rows in (given, odd, nasty):
        assert got(wavelet.digest(docs, WORD)) == shard_rows(rows, lambda x: t.encode(x, add_special_tokens=False).ids)


def test_wavelet_shard_answers():
    x = np.random.default_rng(1).integers(0, 900, 3000).astype(np.uint32)
    s = wavelet.Shard(wavelet.build(x, np.array([1, 2]), np.array([1, 0]), np.array([1500, 3000])))
    assert (s.tokens() == x).all() and s.doc_ids.tolist() == [1, 2] and s.valid.tolist() == [True, False]
    assert all(s.access(i) == x[i] for i in range(0, 3000, 17))
    for c in (0, 5, 899, 500, 1000, 70000):
        at = np.flatnonzero(x == c).tolist()
        assert s.occurrences(c) == at and s.count(c) == len(at) and s.rank(c, 1234) == sum(i < 1234 for i in at)
    with pytest.raises(IndexError):
        s.select(5, 3000)


def _vectors(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((700, 8)) * .3 + c for c in rng.standard_normal((3, 8)) * 3]).astype(np.float32)
    x[900:1300] = x[900]                                        # one vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5100, []), (5200, [0.0] * 8), (5300, [float("nan")] * 8), (5400, [None] * 8), (5500, [float("inf")] * 8), (None, x[0].tolist())]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4), rows


def test_nearest(spark):
    table, rows = _vectors(spark)
    found, want = got(pstable.nearest(table)), nearest(rows)
    assert len(found) == len(want) and {(r[0], r[1]) for r in found} == {(r[0], r[1]) for r in want}
    hit = {(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in want}
    assert len(hit) >= 0.9 * len(want)
    exact = {(q, v): s for q, _, v, s in want}
    assert all(abs(exact[q, v] - s) < 1e-9 for q, _, v, s in found if (q, v) in exact)


def test_nearest_split_cells_and_exact_rest(spark, monkeypatch):
    table, rows = _vectors(spark)
    whole = got(pstable.nearest(table))
    monkeypatch.setattr(pstable, "CELL_ROWS", 50)
    assert got(pstable.nearest(table)) == whole
    # cells so narrow that nothing is found: every query takes the exact way
    exact = got(pstable.nearest(table, width=1e-6, probes=1))
    assert [r[:3] for r in exact] == [r[:3] for r in sorted(nearest(rows))]
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert [r[:3] for r in got(pstable.nearest(few))] == [r[:3] for r in nearest(rows[:4])]


def test_leaks(spark, given):
    docs, rows = given
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    want = leaks(rows, items)
    assert len(want) > 2 and got(decontaminate.matches(docs, bench), "doc_id", "item_id") == want
    clean = got(decontaminate.drop_contaminated(docs, bench), "doc_id")
    assert clean == sorted({(i,) for i, _ in rows} - {(i,) for i, _ in want})


def test_leaks_near_copies_and_odd_rows(spark, odd, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(40)]
    near_ = base[:37] + ["new"] + base[37:]
    far = [w if i % 4 else "z" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, "Before. " + ", ".join(near_).upper() + " after"), (3, " ".join(far)), (4, " ".join(base[:38])), (5, None), (6, ""), (7, "one two"), (8, "pad " * 3000 + " ".join(base)), (1, " ".join(base))]
    items = [(10, " ".join(base)), (11, " ".join(base)), (12, None), (13, ""), (14, "one two"), (15, "never seen here at all")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks(rows, items)
    assert (2, 10) in want and (3, 10) not in want and (7, 14) in want
    assert got(decontaminate.matches(docs, bench).distinct(), "doc_id", "item_id") == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)      # several passes
    assert got(decontaminate.matches(docs, bench).distinct(), "doc_id", "item_id") == want
    assert got(decontaminate.matches(docs, bench.limit(0))) == []


def test_leaks_of_short_items_in_long_documents(spark, monkeypatch):
    rng = random.Random(3)
    pad = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (400, 7, 0)]
    rows = [(1, f"{pad[0]} Paris, of course! {pad[1]}"), (2, f"{pad[0]} paris of {pad[1]} course"), (3, f"of course {pad[0]} forty-two"), (4, f"{pad[1]} to be or not"), (5, "be or not to"), (6, "to be or"), (7, "paris of"), (8, "course"), (9, f"course {pad[0]} ends with a five word item"), (10, None)]
    items = [(20, "Paris of course"), (21, "forty two"), (22, "to be or not"), (23, "course"), (24, "a five word item here"), (25, "with a five word item"), (26, f"paris of course and {pad[1]}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    want = leaks(rows, items)
    assert {(1, 20), (3, 21), (4, 22), (9, 23), (9, 25)} <= set(want) and not {(2, 20), (5, 22), (9, 24)} & set(want)
    assert got(decontaminate.matches(docs, bench), "doc_id", "item_id") == want
    assert got(decontaminate.drop_contaminated(docs, bench), "doc_id") == sorted({(i,) for i, _ in rows} - {(i,) for i, _ in want})
    monkeypatch.setattr(decontaminate, "STEP", 16)              # runs over the ends of texts and of steps
    index = decontaminate.Index(items)
    local = index.search_batch(*decontaminate.batch_hashes(pa.array([t for _, t in rows], pa.string())))
    assert sorted((rows[r][0], items[i][0]) for r, f in local for i in f) == want
    found = {(r[0], r[1]): tuple(r[2:]) for r in decontaminate.matches(docs, bench).collect()}
    assert found[1, 20] == (1.0, 400, 3) and found[9, 23] == (1.0, 0, 1)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_trees.classify(docs, labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == docs.count()
    held = rows.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    right = sum(r["predicted"] == r["quality"] for r in held)
    assert len(held) > 50 and right / len(held) >= 0.95


def test_quality_edges(spark, odd):
    docs, rows = odd
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r[2] for r in got(quality_trees.classify(docs, none))} == {0.5}
    one = spark.createDataFrame([(r[0], 1) for r in rows] + [(None, 0), (3, None)], "doc_id long, quality int")
    out = got(quality_trees.classify(docs, one))
    assert len(out) == len(rows) and all(r[2] > 0.9 and r[3] == 1 for r in out)
    kept = quality_trees.keep_good(docs, one)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > .5) ^ (x[:, 2] > .3)).astype(float)
    t = quality_trees.fit(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > .5) == y[2000:]).mean() > .97


@pytest.mark.parametrize("name", ["bytes", "words", "lines", "near", "bpe", "shards", "leaks", "quality"])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels, bench = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    run = {"bytes": lambda: column_suffix.digest(column_suffix.remove_repeats(docs)), "words": lambda: token_windows.digest(token_windows.remove_repeats(docs)), "lines": lambda: line_bloom.digest(line_bloom.drop_lines(docs)),
           "near": lambda: simhash_pivot.near_duplicates(docs), "bpe": lambda: bpe_index.digest(docs, BYTE), "shards": lambda: wavelet.digest(docs, WORD), "leaks": lambda: decontaminate.matches(docs, bench),
           "quality": lambda: quality_trees.classify(docs, labels)}[name]
    assert run().collect() == []


def test_repeated_rows_and_null_ids(spark):
    a, b = "a text that stands twice " * 12, "another text of some length " * 12
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, b), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = {k: len(v.encode()) for k, v in (("a", a), ("b", b))}
    r = got(column_suffix.remove_repeats(docs), "doc_id", "n_bytes", "n_removed")
    assert len(r) == 7 and (2, n["a"], n["a"]) in r and (3, n["b"], n["b"]) in r and (3, 0, 0) in r
    assert [x for x in r if x[0] == 1][0] == [x for x in r if x[0] == 1][1] and r[0] == r[1]
    w = got(token_windows.remove_repeats(docs), "doc_id", "n_words", "n_removed")
    assert len(w) == 7 and all(x[1] == x[2] for x in w)
    c = got(simhash_pivot.near_duplicates(docs), "doc_id", "component_id")
    assert len(c) == 7 and (2, 1) in c and c.count((1, 1)) == 2
    assert simhash_pivot.keep_one(docs).count() == 3
    assert line_bloom.drop_lines(docs, 2).count() == 7
    s = got(wavelet.digest(docs, WORD))
    assert len(s) == 7 and s[0][0] is None and s[0][1] == 0 and sum(x[2] for x in s[:-1]) == max(x[1] for x in s)
    assert bpe_index.digest(docs, BYTE).count() == 7


def test_repeated_rows_of_a_table_keep_the_bucket_count(spark, given, tmp_path):
    """One repeated row and one null id in a table on disk: the same exchange widths, results equal to brute force."""
    docs, rows = given
    more = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    more.write.parquet(str(tmp_path / "d"))
    more = spark.read.parquet(str(tmp_path / "d"))
    every, unique = common.keyed(more)
    assert every.count() == len(rows) + 2 and unique.count() == len(rows) + 1
    assert common.bucket_count(every) == common.bucket_count(unique) == common.bucket_count(docs)
    # the null id comes first, so ids shifted by one stand for it in the brute force
    first = next(t for i, t in rows if i == docs.first()["doc_id"])
    shifted = [(-1, first), *rows]
    found = got(column_suffix.digest(column_suffix.remove_repeats(more)))
    want = sorted(earlier_bytes(shifted))
    assert {r[1:] for r in found if r[0] is None} == {r[1:] for r in want if r[0] == -1}
    assert {r for r in found if r[0] is not None} == {r for r in want if r[0] != -1} and len(found) == len(want) + 1
    found, want = got(token_windows.digest(token_windows.remove_repeats(more))), sorted(repeated_words(shifted))
    assert {r for r in found if r[0] is not None} == {r for r in want if r[0] != -1} and len(found) == len(want) + 1
