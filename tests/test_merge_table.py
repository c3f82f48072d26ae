"""Merge-on-read tables."""
import os
import random

import pytest
from pyspark.sql import functions as F

from tallygrid.sources import merge_table as M
from tallygrid.sources.merge_table import MergeTable


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _files(path):
    return {os.path.join(p, f) for p, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_changes_merge_like_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    now = {k: (k, f"s{k}") for k in range(40)}
    t = MergeTable.create(spark.createDataFrame([(k, *v) for k, v in now.items()], "k long, a int, b string"), str(tmp_path / "t"), ["k"], 4)
    for step in range(5):
        change = []
        for k in rng.sample(range(60), 12):
            how = rng.choice([M.REPLACE, M.UPDATE, M.UPDATE, M.REMOVE])
            a, b = rng.choice([None, step * 100 + k]), rng.choice([None, f"n{step}"])
            change.append((k, a, b, how))
            if how == M.REMOVE:
                now.pop(k, None)
            else:
                old = now.get(k, (None, None)) if how == M.UPDATE else (None, None)
                now[k] = (a if a is not None else old[0], b if b is not None else old[1])
        t.apply(spark.createDataFrame(change, "k long, a int, b string, how int"), F.col("how"))
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(map(tuple, t.read().collect()), key=key) == sorted(((k, *v) for k, v in now.items()), key=key)
        if step == 2:
            assert t.compact(commits=1)
    assert _rows(t.read(columns=["a"]).select("k")) == sorted((k,) for k in now)


def test_untouched_buckets_keep_their_files_and_compaction_takes_the_due_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    t = MergeTable.create(spark.range(400).select(F.col("id").alias("k"), F.lit("x" * 50).alias("v")), path, ["k"], 8)
    before = _files(path)
    m = t.apply(spark.createDataFrame([(7, "new")], "k long, v string"), M.UPDATE)
    assert before < _files(path) and len(_files(path)) == len(before) + 1
    touched = [b for b, c in m.live.items() if len(c) > 1]
    assert len(touched) == 1 and t.compact(commits=9, share=9.0) == [] and t.compact(commits=0) == touched
    after = t.manifest()
    assert all(len(c) == 1 for c in after.live.values()) and {b for b, c in after.live.items() if c != m.live[b]} == set(touched)
    assert before < _files(path) and t.read().where("v = 'new'").count() == 1 and t.read().count() == 400
    # buckets that nothing has changed are read without an exchange
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<k:bigint,_how:int" in t.read(columns=["k"])._jdf.queryExecution().executedPlan().toString()


def test_failed_and_late_writes_leave_the_old_version(spark, tmp_path):
    t = MergeTable.create(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v")), str(tmp_path / "t"), ["k"], 2)
    want, read_at = _rows(t.read()), t.manifest()
    broken = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") == 30, F.raise_error(F.lit("broken"))).otherwise(2).cast("int").alias("v"))
    with pytest.raises(Exception, match="broken"):
        t.apply(broken)
    assert t.manifest().version == 0 and _rows(t.read()) == want
    t.apply(spark.createDataFrame([(1, 5)], "k long, v int"))
    with pytest.raises(M.Conflict):                             # made from the version before
        t.apply(spark.createDataFrame([(1, 6)], "k long, v int"), at=read_at)
    assert t.read().where("k = 1").first()["v"] == 5 and _rows(t.read(t.manifest(0))) == want


def test_empty_tables_and_changes(spark, tmp_path):
    t = MergeTable.create(spark.createDataFrame([], "k string, v int"), str(tmp_path / "t"), ["k"])
    assert t.read().collect() == [] and t.compact() == []
    t.apply(spark.createDataFrame([], "k string, v int"))
    t.apply(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"))
    assert {tuple(r) for r in t.read().collect()} == {("a", 1), (None, 2)}
