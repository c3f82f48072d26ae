import re

import duckdb
import pytest

import __spark_entry__ as E
import check

D = "/root/testdata/sf0.001"
TABLES = check.TABLES


def test_names_and_sql():
    from tallygrid.plans import catalog
    q, s = catalog.QUERIES, catalog.SQL
    assert set(s) == set(q) and len(q) > 200 and set(q) <= set(E.queries()) and set(s) <= set(E.oracle_sql())
    assert all(re.fullmatch(r"[a-z]{2,3}\d\d[a-z0-9_]*", n) for n in q)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["entity", "period", "revenue", "ttm", "yoy"] and df.count() > 0


SAMPLE = ["win03_04_ttm_yoy", "jn03_cell_merge", "jn06_nearest_period", "jn07_asof_latest", "kpi01_snapshot", "kpi15_quarterly_metrics", "agg21_22_derived_cells", "dq16_udx05_all_rules", "txt03_win21_item_toc",
          "win15_plan_pick", "snk08_save_series", "inc03_restatement_stream"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql_for_any_partitioning(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    rel = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted((tuple(check.norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = E.queries()[name](spark, D)
            got = sorted((tuple(check.norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
            assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want] or sorted(map(str, got)) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_plans_have_no_cartesian_product_or_local_window(spark):
    for name in ("kpi01_snapshot", "jn06_nearest_period", "jn21_mentions", "win14_set05_greedy_pick", "jn07_asof_latest"):
        plan = E.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = E.queries()["top08_newest_reports"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan                      # top-n is cut before the shuffle
    plan = E.queries()["agg03_latest_close"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "ReadSchema" in plan      # column pruning reaches the scan
