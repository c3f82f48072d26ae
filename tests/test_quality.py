from datetime import date

from pyspark.sql import functions as F

from tallygrid.operators import quality as Q
from tallygrid.operators import rank as T
from tallygrid.operators import reconcile as RC

D = date.fromisoformat
YEAR = "entity string, fy int, start date, end date, revenue double, cogs double, gross_profit double, op_income double, net_income double, shares double, eps double, assets double, equity double, spike boolean"


def year(entity="a", fy=2024, **k):
    v = dict(revenue=2e7, cogs=1e7, gross_profit=None, op_income=1.0, net_income=1e6, shares=1e6, eps=1.0, assets=1.0, equity=1.0, spike=False)
    v.update(k)
    return (entity, fy, date(fy, 1, 1), date(fy, 12, 31), *[v[c.split()[0]] for c in YEAR.split(", ")[4:]])


def inputs(spark, years, quarters=(), companies=(("a", 1e6, 1.0, "2025-05-20"),)):
    co = spark.createDataFrame([(e, c, p, D(x) if x else None) for e, c, p, x in companies], "entity string, market_cap double, price double, price_date date")
    q = spark.createDataFrame([(e, D(s), D(t), r, n) for e, s, t, r, n in quarters], "entity string, start date, end date, revenue double, net_income double")
    return Q.Inputs(co, spark.createDataFrame(years, YEAR), q, F.lit("2025-06-01").cast("date"))


QS = [("a", f"2024-{m:02d}-01", f"2024-{m + 2:02d}-28", 5e6, 1.0) for m in (1, 4, 7, 10)] + [("a", "2025-01-01", "2025-03-31", 5e6, 1.0)]


def test_clean_company_has_no_issue(spark):
    assert Q.run_rules(inputs(spark, [year()], QS)).count() == 0


def test_presence(spark, rows):
    i = inputs(spark, [year(revenue=None, op_income=None, shares=None, assets=None, equity=None, cogs=None, net_income=None)], [])
    assert rows(Q.presence(i), "severity", "rule") == sorted([("error", "missing_annual_revenue"), ("error", "missing_annual_net_income"), ("warn", "missing_quarterly_net_income"), ("error", "missing_operating_income"),
                                                             ("error", "missing_diluted_shares"), ("error", "missing_total_assets"), ("error", "missing_stockholders_equity"), ("warn", "no_gross_profit_source")])
    assert rows(Q.presence(inputs(spark, [year(revenue=0.0), year(fy=2023, revenue=5.0)], QS)), "severity", "rule") == [("info", "zero_annual_revenue")]
    assert rows(Q.presence(inputs(spark, [year(revenue=-1.0)], QS)), "rule") == [("negative_annual_revenue",)]
    assert Q.presence(inputs(spark, [], [])).count() == 8                       # an entity without any row


def test_thresholds(spark):
    n = lambda rule, ys, qs=QS, **k: rule(inputs(spark, ys, qs, **k)).count()
    assert n(Q.gross_margin, [year(cogs=2.2e7)]) == 1 and n(Q.gross_margin, [year(cogs=2.1e7)]) == 0 and n(Q.gross_margin, [year(revenue=9e5, cogs=9e6)]) == 0
    assert n(Q.income_size, [year(net_income=3.1e7)]) == 1 and n(Q.income_size, [year(net_income=-3.1e7)]) == 1 and n(Q.income_size, [year(net_income=3e7)]) == 0 and n(Q.income_size, [year(revenue=9e6, net_income=9e7)]) == 0
    assert n(Q.share_range, [year(shares=0.0)]) == 1 and n(Q.share_range, [year(shares=1.1e11)]) == 1 and n(Q.share_range, [year(shares=1e11)]) == 0
    assert n(Q.price_history, [year()], companies=[("a", 1.0, 1.0, "2025-04-02")]) == 0 and n(Q.price_history, [year()], companies=[("a", 1.0, 1.0, "2025-04-01")]) == 1 and n(Q.price_history, [year()], companies=[("a", 1.0, None, None)]) == 1
    assert n(Q.filing_age, [year()], [("a", "2024-10-01", "2024-12-03", 1.0, 1.0)]) == 0 and n(Q.filing_age, [year()], [("a", "2024-09-01", "2024-12-02", 1.0, 1.0)]) == 1
    assert n(Q.eps_match, [year(eps=1.06)]) == 1 and n(Q.eps_match, [year(eps=1.04)]) == 0 and n(Q.eps_match, [year(eps=0.04)]) == 0
    assert n(Q.cap_match, [year()], companies=[("a", 1e6, 1.31, "2025-05-01")]) == 1 and n(Q.cap_match, [year()], companies=[("a", 1e6, 1.3, "2025-05-01")]) == 0
    jump = [year(fy=2022, revenue=2e6), year(fy=2024, revenue=6.1e6)]
    assert n(Q.revenue_jump, jump) == 1 and n(Q.revenue_jump, [jump[0], year(fy=2024, revenue=6e6)]) == 0 and n(Q.revenue_jump, [year(fy=2022, revenue=2e6, spike=True), jump[1]]) == 0
    assert n(Q.quarter_sum, [year(revenue=2.2e7)]) == 1 and n(Q.quarter_sum, [year(revenue=2.1e7)]) == 0 and n(Q.quarter_sum, [year(revenue=9e7)], QS[:3]) == 0


def test_status(spark, rows):
    i = spark.createDataFrame([("a", "info", "r", "d"), ("a", "warn", "s", "d"), ("b", "info", "r", "d")], "entity string, severity string, rule string, detail string")
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    st = Q.worst(i, e)
    assert rows(st) == [("a", "warn"), ("b", "info"), ("c", "ok")]
    assert rows(Q.visible_issues(i, st, limit=4), "entity", "rule") == [("a", "s")]
    only = Q.run_rules(inputs(spark, [], []), filed_only=e.where("entity = 'zzz'"))
    assert only.count() == 0


def test_reconcile(spark, rows):
    f = [("a", "annual", "2024", "revenue", s, v) for s, v in (("tushare", 100.0), ("eastmoney", 100.05), ("yfinance", 103.0))] + [("a", "annual", "2024", "gross_profit", s, v) for s, v in (("tushare", 10.0), ("yfinance", 1.0))] \
        + [("a", "annual", "2020", "cash", s, v) for s, v in (("tushare", 5.0), ("eastmoney", -5.0))] + [("a", "annual", "2023", "cash", "tushare", 1.0)]
    df = spark.createDataFrame(f, "entity string, grid string, period string, metric string, source string, val double")
    c = RC.compare(df, last_n=None)
    assert rows(c, "metric", "n_sources", "severity") == [("cash", 2, "error"), ("revenue", 3, "warn")]
    assert rows(RC.compare(df, last_n=2), "metric") == [("revenue",)]
    v = RC.compare_valuation(spark.createDataFrame([("a", 10.0, 7.0, 5.0, None, 1.0)], "entity string, market_cap double, per_usd double, ttm_pe double, static_pe double, pb double"),
                             spark.createDataFrame([("a", 0.007, 5.4, 1.0, 1.0)], "entity string, total_mv double, pub_ttm_pe double, pub_pe double, pub_pb double"))
    assert rows(v, "metric", "severity") == [("market_cap", "ok"), ("pb", "ok"), ("ttm_pe", "error")]
    assert rows(RC.as_issues(c, v, 2025), "severity", "rule", "detail") == [("error", "valuation_reconcile", "ttm_pe"), ("info", "source_disagreement", "cash 2020"), ("warn", "source_disagreement", "revenue 2024")]
    assert rows(RC.report(c, v), "cells", "valuations", "disagreements", "worst") == [(2, 3, 2, "error")]


def test_asset_and_liability_ranking(spark, rows):
    cells = [("a", "annual", "2025-12-31", "Goodwill", 99.0), ("a", "quarterly", "2025-09-30", "Net PPE", 5.0), ("a", "quarterly", "2025-09-30", "Gross PPE", 50.0), ("a", "quarterly", "2025-09-30", "Inventory", 7.0), ("a", "quarterly", "2025-09-30", "Goodwill", -1.0),
             ("b", "quarterly", "2025-09-30", "Current Debt", 0.0), ("b", "annual", "2024-12-31", "Current Debt", 3.0), ("b", "annual", "2024-12-31", "Long Term Debt", 4.0)]
    df = spark.createDataFrame(cells, "entity string, grid string, period string, item string, val double")
    assert rows(T.top_assets(df, T.line_dimension(spark)), "item", "rn") == [("Inventory", 1), ("Net PPE", 2)]
    assert rows(T.top_liabilities(df, T.line_dimension(spark, [(k, k) for k in T.LIABILITY_LINES])), "entity", "item", "rn") == [("b", "Current Debt", 2), ("b", "Long Term Debt", 1)]


def test_rules_together_equal_rules_alone(spark, rows):
    from datetime import date
    d = date.fromisoformat
    years = spark.createDataFrame([("a", y, d(f"{y}-01-01"), d(f"{y}-12-31"), rev, None, gp, 1.0, ni, sh, eps, 1.0, None, False) for y, rev, gp, ni, sh, eps in (
        (2020, 2e7, 1e7, 4e7, 10.0, 9.0), (2021, None, None, 1.0, -1.0, None), (2022, 9e7, -9e7, 1e6, 2e11, 1.0), (2023, 0.0, None, None, None, None))] + [("b", 2023, d("2023-01-01"), d("2023-12-31"), -5e7, 1e7, None, None, None, None, None, None, 1.0, False)],
        "entity string, fy int, start date, end date, revenue double, cogs double, gross_profit double, op_income double, net_income double, shares double, eps double, assets double, equity double, spike boolean")
    quarters = spark.createDataFrame([("a", d(f"2022-0{m}-01"), d(f"2022-0{m}-28"), 1e7, None) for m in (1, 4, 7, 9)] + [("b", d("2023-01-01"), d("2023-03-31"), None, 2.0)], "entity string, start date, end date, revenue double, net_income double")
    companies = spark.createDataFrame([("a", 1e9, 5.0, d("2024-01-05")), ("b", 1.0, None, None), ("c", None, 1.0, d("2020-01-01"))], "entity string, market_cap double, price double, price_date date")
    inp = Q.Inputs(companies, years, quarters, F.lit("2024-01-10").cast("date"))
    for filed in (None, spark.createDataFrame([("a",), ("c",), ("c",)], "entity string")):
        alone = Q.run_rules(inp, Q.RULES, filed.distinct() if filed is not None else None)
        assert rows(Q.run_rules(inp, filed_only=filed)) == rows(alone)
    assert {r.rule for r in alone.collect()} >= {"yoy_revenue_jump", "q_sum_vs_annual", "eps_mismatch", "shares_out_of_range", "stale_filings", "no_price_history"} - {"no_price_history"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_sheet_is_a_group_limit(spark):
    """TOP-01, 02: cells are neither joined with their own aggregate nor sorted for it; a sheet without a period is no sheet."""
    rows = [("a", "annual", "2024-12-31", "Net PPE", 7.0), ("a", "quarterly", "2024-03-31", "Net PPE", 5.0), ("a", "quarterly", "2024-06-30", "Net PPE", 6.0),
            ("a", "quarterly", "2024-06-30", "Inventory", 6.0), ("b", "annual", "2023-12-31", "Inventory", 1.0), ("b", "annual", None, "Inventory", 2.0), ("c", "quarterly", None, "Inventory", 2.0)]
    df = spark.createDataFrame(rows, "entity string, grid string, period string, item string, val double").repartition(3)
    x = T.top_assets(df, T.line_dimension(spark))
    assert sorted((r["entity"], r["item"], r["val"], r["rn"]) for r in x.collect()) == [("a", "Inventory", 6.0, 2), ("a", "Net PPE", 6.0, 1), ("b", "Inventory", 1.0, 1)]
    assert "WindowGroupLimit" in plan(x) and "SortMergeJoin" not in plan(x)


def test_lines_travel_in_partitions_of_bounded_size(spark, monkeypatch):
    """Statements and prices: the table's size gives the number of partitions; the aggregates after it need no exchange of their own."""
    from tallygrid.plans import bindings as B
    d = "/root/testdata/sf0.001"
    frames = lambda: [B.quarter_sums(spark, d), B.prices(spark, d)]
    want = [sorted(map(tuple, x.collect())) for x in frames()]
    monkeypatch.setattr(B, "PARTITION_BYTES", 20_000)
    for x, w in zip(frames(), want):
        assert B.partitions(spark, d) > 3 and x.rdd.getNumPartitions() == B.partitions(spark, d)
        assert sorted(map(tuple, x.collect())) == w


def test_companies_of_shared_inputs_are_written_once(spark):
    from tallygrid.plans import q_quality
    assert "Join" not in plan(q_quality.inputs(spark, "/root/testdata/sf0.001", shared=True).companies)


def test_company_page_keeps_statements_wide_until_its_arrays(spark, monkeypatch):
    """RM-04: one pair of statements for page and issues; the arrays hold exactly the labelled rows."""
    from tallygrid.plans import bindings as B
    from tallygrid.plans import company, q_store
    calls, pair = [], B.statement_pair
    monkeypatch.setattr(B, "statement_pair", lambda *a: calls.append(1) or pair(*a))
    d = "/root/testdata/sf0.001"
    page = q_store._company_pages(spark, d)
    assert len(calls) == 1
    q, y = pair(spark, d)
    assert "Expand" not in plan(company.statement_lists(y, q))
    key = lambda r: (r["entity"], r["grid"], str(r["period"]), r["item"], r["val"])
    found = page.select("entity", "statements").collect()
    want = sorted(key(r) for r in company.labelled(y, "annual").unionByName(company.labelled(q, "quarterly")).collect())
    assert sorted((r["entity"], *key({**s.asDict(), "entity": 0})[1:]) for r in found for s in r["statements"] or []) == want
    for r in found:
        newest = [(s["grid"], s["period"], s["item"]) for s in r["statements"] or []]
        assert newest == sorted(newest, reverse=True) and r["statements"] != []
