import random

from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators import asof as A
from tallygrid.operators import grid as G
from tallygrid.operators import keyed as K
from tallygrid.operators import metrics as M
import pytest

Q = ["2025-03-31", "2025-06-30", "2025-09-30", "2025-12-31", "2026-03-31"]


def quarters(spark, vals, entity="a"):
    return spark.createDataFrame([(entity, p, v) for p, v in zip(Q, vals)], "entity string, p string, v double").select("entity", F.col("p").cast("date").alias("period"), "v")


def test_strict_windows(spark, rows):
    g = G.Grid("entity")
    x = quarters(spark, [1.0, 2.0, None, 4.0, -8.0]).select("period", g.ttm("v").alias("t"), g.rolling_sum("v", 2).alias("s"), g.yoy("v").alias("y"), g.lag("v", 1).alias("l"))
    r = [tuple(z)[1:] for z in x.orderBy("period").collect()]
    assert r == [(None, None, None, None), (None, 3.0, None, 1.0), (None, None, None, 2.0), (None, None, None, None), (None, -4.0, -9.0, 4.0)]
    ann = G.Grid("entity", annual=True)
    assert [z[0] for z in quarters(spark, [1.0, -2.0]).orderBy("period").select(ann.yoy("v")).collect()] == [None, -3.0]


def test_spikes_tint_pad(spark, rows):
    y = spark.createDataFrame([("a", i, v) for i, v in enumerate([10.0, 50.0, 12.0, 0.0, 9.0, 30.0])], "entity string, period int, v double")
    assert [r.period for r in G.Grid("entity", annual=True).spikes(y, "v").collect()] == [1]
    assert rows(spark.range(1).select(G.tint(F.lit(12.0), F.lit(10.0)), G.tint(F.lit(8.0), F.lit(10.0)), G.tint(F.lit(1.0), F.lit(0.0)))) == [("up", "down", "")]
    p = G.Grid("entity", annual=True).pad_left(y.where("period >= 4"), 4).orderBy("slot").collect()
    assert [(r.slot, r.period) for r in p] == [(1, None), (2, None), (3, 4), (4, 5)]
    assert [r.period for r in G.downsample(y, ["entity"], "period", 3).orderBy("period").collect()] == [0, 2, 4, 5]
    dense = G.Grid("entity").densify(quarters(spark, [1.0, 2.0, 3.0]).where("period <> date'2025-06-30'"))
    assert dense.count() == 3


def test_prior_year_is_calendar_safe(spark, rows):
    x = spark.createDataFrame([("a", 2024, 1, 10.0), ("a", 2025, 1, 12.0), ("a", 2025, 2, 5.0)], "entity string, fy bigint, q bigint, v double")
    assert rows(G.prior_year(x, "entity", "fy", "q", ["v"]).where("fy = 2025"), "q", "prev_v") == [(1, 10.0), (2, None)]


def test_next_sibling_over_blocks(spark):
    m = spark.createDataFrame([("x", i) for i in (1, 5, 12, 13, 40)] + [("y", 3)], "g string, m bigint")
    got = {r.m: r.n for r in G.next_sibling(m, "g", "m", F.floor(F.col("m") / 10), "n").where("g = 'x'").collect()}
    assert got == {1: 5, 5: 12, 12: 13, 13: 40, 40: 1}
    assert G.next_sibling(m, "g", "m", F.floor(F.col("m") / 10), "n").where("g = 'y'").first().n is None


def test_asof_against_brute_force_with_hot_key(spark):
    rnd = random.Random(3)
    days = lambda n: f"20{rnd.randint(20, 24)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"
    facts = [("hot" if rnd.random() < .6 else f"k{rnd.randint(0, 5)}", days(0), i, rnd.random() if rnd.random() < .9 else None) for i in range(400)]
    probes = [("hot" if rnd.random() < .6 else f"k{rnd.randint(0, 7)}", days(0), i) for i in range(300)]
    f = spark.createDataFrame(facts, "k string, t string, id int, v double").withColumn("t", F.col("t").cast("date"))
    p = spark.createDataFrame(probes, "k string, t string, id int").withColumn("t", F.col("t").cast("date"))
    for grain, cut in (("day", 10), ("month", 7)):
        got = {r.id: r.v for r in A.asof(p, f, ["k"], "t", "t", ["v"], grain=grain, tie=["id"]).collect()}
        for k, t, i in probes:
            c = [(ft, fid, v) for fk, ft, fid, v in facts if fk == k and ft[:cut] <= t[:cut] and v is not None]
            assert got[i] == (max(c)[2] if c else None)


def test_fiscal_year_visible_from_december(spark, rows):
    q = quarters(spark, [1.0] * 5).select("entity", "period")
    y = spark.createDataFrame([("a", 2024, 380.0), ("a", 2025, 430.0)], "entity string, fy int, v double")
    got = A.fiscal_year_on_grid(q, y, ["entity"], "period", "fy", "v", "fyv").orderBy("period").collect()
    assert [r.fyv for r in got] == [380.0, 380.0, 380.0, 430.0, 430.0]


def test_valuation_replaces_outlier_counts(spark):
    d = lambda df: df.withColumn("period", F.col("period").cast("date"))
    q = d(spark.createDataFrame([("a", "2025-03-31", 1.0, 5.0, 100.0, 50.0), ("a", "2025-06-30", 1.0, 5.0, 100000.0, 40.0)], "entity string, period string, net_income double, revenue double, shares double, equity double"))
    y = d(spark.createDataFrame([("a", "2024-12-31", 10.0, 0.0, 100.0, None)], "entity string, period string, net_income double, revenue double, shares double, equity double"))
    px = spark.createDataFrame([("a", "2024-11-01", 9.0), ("a", "2025-07-01", 2.0)], "entity string, month string, close double").withColumn("month", F.col("month").cast("date"))
    base = spark.createDataFrame([("a", 100.0)], "entity string, base_shares double")
    got = A.valuation_history(px, q, y, base).collect()
    assert [(str(r.month), r.static_pe, r.static_ps, r.pb) for r in got] == [("2025-07-01", 20.0, None, 5.0)]
    m = A.quarterly_multiples(q.withColumn("fcf", F.lit(-2.0)), px, base).orderBy("period").collect()
    assert [(r.pqe, r.pqfcf) for r in m] == [(9.0 * 100 / 4, -9.0 * 100 / 8)] * 2


def test_running_total_blocks_equal_plain(spark):
    rnd = random.Random(1)
    data = [("hot", i, rnd.randint(0, 9)) for i in range(500)] + [("b", i, 1) for i in range(7)]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint")
    for desc in (False, True):
        got = {(r.k, r.i): r.t for r in K.running_total(df, ["k"], "i", "v", "t", block=16, descending=desc).collect()}
        for k in ("hot", "b"):
            tot = 0
            for _, i, v in sorted((x for x in data if x[0] == k), key=lambda x: x[1], reverse=desc):
                tot += v
                assert got[(k, i)] == tot


def test_metric_rules(spark, rows):
    g = M.MetricGrid("entity")
    with pytest.raises(M.MetricError):
        g.ttm_of("equity")
    with pytest.raises(M.MetricError):
        M.Chart("x", (), 4)
    with pytest.raises(M.MetricError):
        M.Chart("x", (M.Metric("a", "1"),), 41)
    grid = quarters(spark, [100.0, 110.0, 120.0, 130.0, 140.0]).withColumnRenamed("v", "revenue").withColumn("net_income", F.when(F.month("period") == 6, None).otherwise(10.0)).withColumn("mcap", F.lit(1000.0))
    x = grid.select("period", g.derived("ps").alias("ps"), g.derived("pe").alias("pe")).orderBy("period").collect()
    assert x[3].ps == 1000 / 460 and x[3].pe is None and x[4].ps == 2.0
    need = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a")], "metric string, series string")
    have = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e2", "a"), ("e2", "a")], "entity string, series string")
    assert rows(M.applicable(need, have)) == [("m", "e1"), ("n", "e1"), ("n", "e2")]
    pts = spark.createDataFrame([("e1", "2025-03-31", 1.0), ("e1", "2025-06-30", 2.0), ("e1", "2025-09-30", 3.0), ("e1", "2025-12-31", None), ("e2", "2025-03-31", 1.0), ("e2", "2025-06-30", 1.0), ("e2", "2025-09-30", 1.0), ("e2", "2025-12-31", 1.0)], "entity string, period string, value double")
    assert rows(M.complete_years(pts, ["entity"])) == [("e1", "2025", None), ("e2", "2025", 4.0)]
