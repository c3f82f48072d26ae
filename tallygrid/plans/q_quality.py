"""Data-quality, reconciliation and top-k queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import findings as FD
from tallygrid.operators import quality as Q
from tallygrid.operators import rank as T
from tallygrid.operators import reconcile as RC
from tallygrid.plans import bindings as B
from tallygrid.plans.registry import query, table
from tallygrid.session import scratch
from tallygrid.sources import payloads as P

LIMITS = {"min_revenue": 50000.0, "min_revenue_income": 50000.0, "income_factor": 0.5, "max_shares": 300.0}
TODAY = "2001-09-15"

INPUT_SQL = f"""{B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')}, {B.PRICES_SQL},
  y0 AS (SELECT entity, year(period) AS fy, make_date(year(period)::bigint, 1, 1) AS start, period AS "end", ocf AS revenue, cogs * 8 AS cogs, gross_profit AS gp, rd AS op_income, net_income, shares - 100 AS shares, net_income/nullif(shares - 100, 0) * case when year(period) % 2 = 0 then 1.1::double else 1.0::double end AS eps, cash AS assets, lt_debt AS equity FROM sty),
  y AS (SELECT *, coalesce(revenue <> 0 and p <> 0 and n <> 0 and abs(revenue)/greatest(abs(p),1) > 2 and abs(revenue)/greatest(abs(n),1) > 2, false) AS spike FROM (SELECT *, lag(revenue) over (partition by entity order by fy) p, lead(revenue) over (partition by entity order by fy) n FROM y0)),
  q AS (SELECT entity, cast(date_trunc('quarter', period) as date) AS start, period AS "end", case when quarter(period) <> 4 or year(period) % 3 > 0 then ocf * case when year(period) % 2 = 0 then 1.1::double else 1.0::double end end AS revenue, sga AS net_income FROM st),
  co AS (SELECT c_custkey AS entity, c_acctbal * 10 AS market_cap, price, price_date FROM customer LEFT JOIN (SELECT entity, arg_max(close, month) AS price, max(month) AS price_date FROM px GROUP BY 1) z ON z.entity = c_custkey)"""


def inputs(spark, d, shared=False, pair=None):
    """Rule inputs; ``shared`` writes what several rules read (statements, years and companies) once, ``pair`` are statements already written."""
    from pyspark.sql import Window as W

    from tallygrid.session import materialise
    st, sty = pair or B.statement_pair(spark, d) if shared else (B.statements(spark, d), B.statements(spark, d, "year"))
    c = F.col
    y = sty.select("entity", F.year("period").alias("fy"), F.make_date(F.year("period"), F.lit(1), F.lit(1)).alias("start"), c("period").alias("end"), c("ocf").alias("revenue"), (c("cogs") * 8).alias("cogs"),
                   "gross_profit", c("rd").alias("op_income"), "net_income", (c("shares") - 100).alias("shares"), c("cash").alias("assets"), c("lt_debt").alias("equity"))
    y = y.withColumn("eps", c("net_income") / F.nullif(c("shares"), F.lit(0.0)) * F.when(c("fy") % 2 == 0, 1.1).otherwise(1.0))
    w = W.partitionBy("entity").orderBy("fy")
    p, n, r = F.lag("revenue").over(w), F.lead("revenue").over(w), c("revenue")
    one = F.lit(1.0)
    y = y.withColumn("_p", p).withColumn("_n", n)
    y = y.withColumn("spike", F.coalesce((r != 0) & (c("_p") != 0) & (c("_n") != 0) & (F.abs(r) / F.greatest(F.abs("_p"), one) > 2) & (F.abs(r) / F.greatest(F.abs("_n"), one) > 2), F.lit(False))).drop("_p", "_n")
    filed_ = (F.quarter("period") != 4) | (F.year("period") % 3 > 0)
    q = st.select(
        "entity", F.to_date(F.trunc("period", "quarter")).alias("start"), c("period").alias("end"), F.when(filed_, c("ocf") * F.when(F.year("period") % 2 == 0, 1.1).otherwise(1.0)).alias("revenue"), c("sga").alias("net_income"))
    px = B.prices(spark, d).groupBy("entity").agg(F.max_by("close", "month").alias("price"), F.max("month").alias("price_date"))
    co = table(spark, d, "customer").select(c("c_custkey").alias("entity"), (c("c_acctbal") * 10).alias("market_cap")).join(px, "entity", "left")
    return Q.Inputs(materialise(co, "companies") if shared else co, materialise(y, "years") if shared else y, q, F.lit(TODAY).cast("date"), LIMITS)


PRES_SQL = """pres AS (SELECT entity, unnest(list_filter([case when nr = 0 then {'s': 'error', 'r': 'missing_annual_revenue'} end, case when rv < 0 then {'s': 'warn', 'r': 'negative_annual_revenue'} end, case when rv = 0 then {'s': 'info', 'r': 'zero_annual_revenue'} end,
   case when nn = 0 then {'s': 'error', 'r': 'missing_annual_net_income'} end, case when nq = 0 then {'s': 'warn', 'r': 'missing_quarterly_net_income'} end, case when no_ = 0 then {'s': 'error', 'r': 'missing_operating_income'} end, case when ns = 0 then {'s': 'error', 'r': 'missing_diluted_shares'} end,
   case when na = 0 then {'s': 'error', 'r': 'missing_total_assets'} end, case when ne = 0 then {'s': 'error', 'r': 'missing_stockholders_equity'} end, case when ng = 0 and nc = 0 then {'s': 'warn', 'r': 'no_gross_profit_source'} end], lambda i: i is not null)) AS i
  FROM (SELECT co.entity, coalesce(a.nr, 0) nr, rv, coalesce(nn, 0) nn, coalesce(nq, 0) nq, coalesce(no_, 0) no_, coalesce(ns, 0) ns, coalesce(na, 0) na, coalesce(ne, 0) ne, coalesce(ng, 0) ng, coalesce(nc, 0) nc FROM co
   LEFT JOIN (SELECT entity, count(revenue) nr, arg_max(revenue, fy) FILTER (WHERE revenue is not null) rv, count(net_income) nn, count(op_income) no_, count(shares) ns, count(assets) na, count(equity) ne, count(gp) ng, count(cogs) nc FROM y GROUP BY 1) a USING (entity)
   LEFT JOIN (SELECT entity, count(net_income) nq FROM q GROUP BY 1) b USING (entity)))"""
RULE_SQL = {
    "dq01_06_presence": "SELECT entity, i.s AS severity, i.r AS rule FROM pres",
    "dq07_price_history": f"SELECT entity, case when price_date is null then 'error' else 'warn' end AS severity, case when price_date is null then 'no_price_history' else 'stale_price' end AS rule FROM co WHERE price_date is null or date '{TODAY}' - price_date > 60",
    "dq08_gross_margin": "SELECT entity, 'warn' AS severity, 'gross_margin_out_of_range' AS rule FROM y WHERE abs(revenue) >= 50000 and (coalesce(gp, revenue - cogs)/nullif(revenue,0) < -0.05 or coalesce(gp, revenue - cogs)/nullif(revenue,0) > 1.05)",
    "dq09_income_size": "SELECT entity, 'warn' AS severity, 'ni_exceeds_revenue' AS rule FROM y WHERE abs(revenue) >= 50000 and abs(net_income) > abs(revenue) * 0.5",
    "dq10_share_range": "SELECT entity, 'warn' AS severity, 'shares_out_of_range' AS rule FROM y WHERE shares <= 0 or shares > 300",
    "dq11_filing_age": f"SELECT entity, 'warn' AS severity, 'stale_filings' AS rule FROM (SELECT entity, max(\"end\") AS e FROM q WHERE revenue is not null GROUP BY 1) WHERE date '{TODAY}' - e > 180",
    "dq12_win23_revenue_jump": "SELECT entity, 'warn' AS severity, 'yoy_revenue_jump' AS rule FROM (SELECT entity, revenue, spike, lag(revenue) over w pr, lag(spike) over w ps FROM y WHERE revenue is not null WINDOW w AS (PARTITION BY entity ORDER BY fy)) WHERE abs(revenue) >= 50000 and abs(pr) >= 50000 and not spike and not ps and (revenue/pr > 3 or revenue/pr < 1/3.0::double)",
    "dq13_quarter_sum": "SELECT entity, 'warn' AS severity, 'q_sum_vs_annual' AS rule FROM (SELECT y.entity, y.fy, y.revenue AS a, count(*) n, sum(q.revenue) s FROM y JOIN q ON q.entity = y.entity and q.start >= y.start and q.\"end\" <= y.\"end\" and q.revenue is not null WHERE y.revenue <> 0 GROUP BY 1, 2, 3) WHERE n = 4 and abs((s - a)/a) > 0.05",
    "dq14_eps_match": "SELECT entity, 'info' AS severity, 'eps_mismatch' AS rule FROM y WHERE abs(eps) >= 0.05 and abs((net_income/nullif(shares,0) - eps)/abs(eps)) > 0.05",
    "dq15_cap_match": "SELECT entity, 'info' AS severity, 'mcap_reconciliation' AS rule FROM (SELECT entity, arg_max(shares, fy) AS sh FROM y WHERE shares is not null GROUP BY 1) JOIN co USING (entity) WHERE sh <> 0 and abs((price * sh - market_cap)/nullif(market_cap,0)) > 0.30",
}
_FUNCS = {"dq01_06_presence": Q.presence, "dq07_price_history": Q.price_history, "dq08_gross_margin": Q.gross_margin, "dq09_income_size": Q.income_size, "dq10_share_range": Q.share_range,
          "dq11_filing_age": Q.filing_age, "dq12_win23_revenue_jump": Q.revenue_jump, "dq13_quarter_sum": Q.quarter_sum, "dq14_eps_match": Q.eps_match, "dq15_cap_match": Q.cap_match}


def _rule_query(name):
    def run(spark, d):
        return _FUNCS[name](inputs(spark, d)).select("entity", "severity", "rule")
    run.__module__ = __name__
    query(name, f"WITH {INPUT_SQL}, {PRES_SQL} {RULE_SQL[name]}")(run)


for _n in RULE_SQL:
    _rule_query(_n)

_FILED_ONLY = " WHERE entity IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE')"
ALL_SQL = f"WITH {INPUT_SQL}, {PRES_SQL}, issues AS (" + " UNION ALL ".join(
    f"SELECT * FROM ({s})" + ("" if n == "dq07_price_history" else _FILED_ONLY) for n, s in RULE_SQL.items()) + ")"


def all_issues(spark, d, written=False, pair=None):
    """Issues of all rules; ``written`` keeps them as a table for jobs that read them twice."""
    filers = table(spark, d, "customer").where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("entity"))
    out = Q.run_rules(inputs(spark, d, shared=True, pair=pair), filed_only=filers)
    if not written:
        return out
    from tallygrid.session import materialise
    return materialise(out, "issues")


@query("dq16_udx05_all_rules", f"{ALL_SQL} SELECT rule, severity, count(*) AS n, count(DISTINCT entity) AS entities FROM issues GROUP BY 1, 2")
def dq16(spark, d):
    return all_issues(spark, d).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


@query("rm04_company_issues", f"{ALL_SQL} SELECT entity, severity, rule, count(*) AS n FROM issues WHERE entity IN (SELECT c_custkey FROM customer) GROUP BY 1, 2, 3")
def rm04_issues(spark, d):
    from tallygrid.plans.q_store import _company_pages
    return _company_pages(spark, d).select("entity", F.inline("issues"))


WORST_SQL = "w AS (SELECT c_custkey AS entity, coalesce(max(case severity when 'error' then 3 when 'warn' then 2 when 'info' then 1 end), 0) AS r FROM customer LEFT JOIN issues ON entity = c_custkey GROUP BY 1), wst AS (SELECT entity, ['ok', 'info', 'warn', 'error'][r + 1] AS status FROM w)"


@query("agg26_worst_severity", f"{ALL_SQL}, {WORST_SQL} SELECT * FROM wst")
def agg26(spark, d):
    return Q.worst(all_issues(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("entity")))


@query("flt27_visible_issues", f"{ALL_SQL}, {WORST_SQL} SELECT entity, count(*) AS n FROM issues JOIN wst USING (entity) WHERE severity <> 'info' and status in ('warn', 'error') GROUP BY 1")
def flt27(spark, d):
    i = all_issues(spark, d, written=True)              # read twice below
    st = Q.worst(i, table(spark, d, "customer").select(F.col("c_custkey").alias("entity")))
    return Q.visible_issues(i, st).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("flt27_strict_entities", f"{ALL_SQL}, {WORST_SQL} SELECT entity FROM wst WHERE status <> 'error'")
def flt27b(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    return Q.strict_entities(c, Q.worst(all_issues(spark, d), c))


def kept_findings(spark, d, label):
    """A findings table of the inputs as they were before the cash flow of every hundredth company was restated, brought up to today's."""
    from dataclasses import replace
    filers = table(spark, d, "customer").where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("entity"))
    now = inputs(spark, d, shared=True)
    before = replace(now, years=now.years.withColumn("revenue", F.when(F.col("entity") % 100 == 7, F.col("revenue") * 5).otherwise(F.col("revenue"))))
    t = FD.create(spark, scratch(spark, label))
    FD.refresh(t, before, filers)
    return t, FD.refresh(t, now, filers)


@query("dq16_kept_findings", f"{ALL_SQL} SELECT rule, severity, count(*) AS n, count(DISTINCT entity) AS entities FROM issues GROUP BY 1, 2")
def dq16_kept(spark, d):
    t, _ = kept_findings(spark, d, "dq16")
    return FD.issues(t).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


@query("agg26_kept_status", f"{ALL_SQL}, {WORST_SQL} SELECT * FROM wst")
def agg26_kept(spark, d):
    return FD.status(kept_findings(spark, d, "agg26")[0])


@query("flt27_kept_visible", f"{ALL_SQL}, {WORST_SQL} SELECT entity, count(*) AS n FROM issues JOIN wst USING (entity) WHERE severity <> 'info' and status in ('warn', 'error') GROUP BY 1")
def flt27_kept(spark, d):
    return FD.visible(kept_findings(spark, d, "flt27")[0]).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


# --- reconciliation ------------------------------------------------------------------------------------------------

RECON_SQL = """raw AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, quarter(o_orderdate) AS qn, cast(round(o_totalprice) as bigint) AS v, o_orderstatus AS s FROM orders),
  fc AS (SELECT entity, 'annual' AS grid, cast(y as varchar) AS period, case s when 'P' then 'gross_profit' else 'revenue' end AS metric, sum(v) AS t FROM raw GROUP BY ALL UNION ALL SELECT entity, 'quarterly', y || 'Q' || qn, case s when 'P' then 'gross_profit' else 'revenue' end, sum(v) FROM raw GROUP BY ALL),
  facts AS (SELECT entity, grid, period, metric, source, case source when 'tushare' then cast(t as double) when 'eastmoney' then cast(t - t % 2500 as double) when 'yfinance' then case when t % 3 > 0 then cast(t + entity % 7 * 900 as double) end else case when t % 11 = 0 then -cast(t as double) end end AS val FROM fc, (VALUES ('tushare'), ('eastmoney'), ('yfinance'), ('other')) x(source)),
  k AS (SELECT DISTINCT entity, grid, period FROM facts QUALIFY dense_rank() over (partition by entity, grid order by period desc) <= case grid when 'annual' then 6 else 8 end),
  cells AS (SELECT *, case when n_sources < 2 then null when flip then 'error' when spread <= 0.001::double then 'ok' when spread <= 0.01::double then 'info' when spread <= 0.05::double then 'warn' else 'error' end AS severity FROM (
   SELECT entity, grid, period, metric, count(*) AS n_sources, case when max(abs(val)) = 0 then 0 else (max(val) - min(val))/max(abs(val)) end AS spread, max(val) > 0 and min(val) < 0 AS flip FROM facts JOIN k USING (entity, grid, period)
   WHERE val is not null and not (source = 'yfinance' and metric = 'gross_profit') GROUP BY 1, 2, 3, 4) WHERE n_sources >= 2)"""


def recon_facts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("string").alias("y"), F.quarter("o_orderdate").cast("string").alias("qn"),
                                         F.round("o_totalprice").cast("bigint").alias("v"), F.when(F.col("o_orderstatus") == "P", "gross_profit").otherwise("revenue").alias("metric"))
    q = o.groupBy("entity", "y", "qn", "metric").agg(F.sum("v").alias("t"))
    a = q.groupBy("entity", "y", "metric").agg(F.sum("t").alias("t"))                   # rolled up from the quarters
    f = a.select("entity", F.lit("annual").alias("grid"), F.col("y").alias("period"), "metric", "t").unionByName(
        q.select("entity", F.lit("quarterly").alias("grid"), F.concat("y", F.lit("Q"), "qn").alias("period"), "metric", "t"))
    t = F.col("t")
    src = lambda n, v: F.struct(F.lit(n).alias("source"), v.cast("double").alias("val"))
    each = F.array(src("tushare", t), src("eastmoney", t - t % 2500), src("yfinance", F.when(t % 3 > 0, t + F.col("entity") % 7 * 900)), src("other", F.when(t % 11 == 0, -t)))
    return f.select("entity", "grid", "period", "metric", F.inline(each))


def recon_cells(spark, d):
    return RC.compare(recon_facts(spark, d), RC.WINDOWS)


@query("agg24_compare_sources", f"WITH {RECON_SQL} SELECT entity, grid, period, metric, n_sources, round(spread, 8) AS spread, flip AS sign_flip, severity FROM cells")
def agg24(spark, d):
    return recon_cells(spark, d).select("entity", "grid", "period", "metric", "n_sources", F.round("spread", 8).alias("spread"), "sign_flip", "severity")


VAL_SQL = """val AS (SELECT entity, m AS metric, o AS ours, p AS published, case when greatest(abs(o), abs(p)) = 0 then 0 else (greatest(o, p) - least(o, p))/greatest(abs(o), abs(p)) end AS spread FROM (
  SELECT c_custkey AS entity, unnest(['market_cap', 'ttm_pe', 'static_pe', 'pb']) AS m, unnest([c_acctbal * 7.0::double, cast(c_nationkey as double), case when c_nationkey % 2 = 0 then 10.0::double end, 1.5::double]) AS o,
   unnest([round(c_acctbal) * 7 / 10000.0::double * 10000, case when c_custkey % 5 = 0 then -cast(c_nationkey as double) else cast(c_nationkey as double) end, 10.05::double, 1.5::double]) AS p FROM customer) WHERE o is not null and p is not null),
  vs AS (SELECT *, case when sign(ours) * sign(published) < 0 then 'error' when spread <= 0.001::double then 'ok' when spread <= 0.01::double then 'info' when spread <= 0.05::double then 'warn' else 'error' end AS severity FROM val)"""


def recon_valuation(spark, d):
    c = F.col
    x = table(spark, d, "customer")
    n = c("c_nationkey").cast("double")
    ours = x.select(c("c_custkey").alias("entity"), c("c_acctbal").alias("market_cap"), F.lit(7.0).alias("per_usd"), n.alias("ttm_pe"), F.when(c("c_nationkey") % 2 == 0, 10.0).alias("static_pe"), F.lit(1.5).alias("pb"))
    pub = x.select(c("c_custkey").alias("entity"), (F.round("c_acctbal") * 7 / 10000.0).alias("total_mv"), F.when(c("c_custkey") % 5 == 0, -n).otherwise(n).alias("pub_ttm_pe"), F.lit(10.05).alias("pub_pe"), F.lit(1.5).alias("pub_pb"))
    return RC.compare_valuation(ours, pub)


@query("agg25_valuation_reconcile", f"WITH {VAL_SQL} SELECT entity, metric, round(ours, 4) AS ours, round(spread, 8) AS spread, severity FROM vs")
def agg25(spark, d):
    return recon_valuation(spark, d).select("entity", "metric", F.round("ours", 4).alias("ours"), F.round("spread", 8).alias("spread"), "severity")


@query("agg28_44_recon_report", f"""WITH {RECON_SQL}, {VAL_SQL}, u AS (SELECT entity, severity, 1 AS c FROM cells UNION ALL SELECT entity, severity, 0 FROM vs) SELECT entity, cast(sum(c) as bigint) AS cells, cast(sum(1 - c) as bigint) AS valuations, count(case when c = 1 and severity <> 'ok' then 1 end) AS disagreements,
  ['ok', 'info', 'warn', 'error'][max(case severity when 'error' then 3 when 'warn' then 2 when 'info' then 1 else 0 end) + 1] AS worst FROM u GROUP BY 1""")
def agg28(spark, d):
    return RC.report(recon_cells(spark, d), recon_valuation(spark, d))


@query("top03_recon_issues", f"""WITH {RECON_SQL}, {VAL_SQL} SELECT entity, case when 2001 - cast(substr(period, 1, 4) as integer) > 3 then 'info' else severity end AS severity, 'source_disagreement' AS rule, metric || ' ' || period AS detail FROM cells WHERE severity <> 'ok'
  QUALIFY row_number() over (partition by entity order by spread desc, grid, period, metric) <= 5 UNION ALL SELECT entity, severity, 'valuation_reconcile', metric FROM vs WHERE severity in ('warn', 'error')""")
def top03(spark, d):
    return RC.as_issues(recon_cells(spark, d), recon_valuation(spark, d), 2001)


@query("rm11_agreement", f"WITH {RECON_SQL} SELECT entity, grid, count(case when severity = 'ok' then 1 end) AS agreed, count(*) AS compared FROM cells GROUP BY 1, 2")
def rm11(spark, d):
    return recon_cells(spark, d).groupBy("entity", "grid").agg(F.count_if(F.col("severity") == "ok").alias("agreed"), F.count(F.lit(1)).alias("compared"))


@query("dq17_validation_job", f"""{ALL_SQL.replace('issues AS (', 'iss0 AS (')}, {RECON_SQL.replace('raw AS', 'rraw AS').replace('FROM raw', 'FROM rraw')}, {VAL_SQL}, issues AS (SELECT entity, severity, rule FROM iss0 UNION ALL
  SELECT entity, severity, rule FROM (SELECT entity, case when 2001 - cast(substr(period, 1, 4) as integer) > 3 then 'info' else severity end AS severity, 'source_disagreement' AS rule FROM cells WHERE severity <> 'ok' QUALIFY row_number() over (partition by entity order by spread desc, grid, period, metric) <= 5)
  UNION ALL SELECT entity, severity, 'valuation_reconcile' FROM vs WHERE severity in ('warn', 'error')), {WORST_SQL} SELECT status, count(*) AS n, cast(sum(k) as bigint) AS issues FROM wst LEFT JOIN (SELECT entity, count(*) AS k FROM issues GROUP BY 1) USING (entity) GROUP BY 1""")
def dq17(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    i = all_issues(spark, d).unionByName(RC.as_issues(recon_cells(spark, d), recon_valuation(spark, d), 2001))
    per = i.groupBy("entity").agg(F.count(F.lit(1)).alias("k"), F.max(Q.severity_rank()).alias("r"))
    x = c.join(per, "entity", "left").select(Q.severity_name(F.coalesce("r", F.lit(0))).alias("status"), "k")
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("issues"))


# --- top-k ------------------------------------------------------------------------------------------------------------

_LINES = {"Goodwill": "cash", "Net PPE": "sti", "Gross PPE": "lt_debt", "Inventory": "st_debt", "Receivables": "debt_legacy"}
_LIABS = {"Long Term Debt": "lt_debt", "Current Debt": "st_debt", "Accounts Payable": "debt_legacy", "Accrued Liabilities": "sga", "Deferred Revenue": "rd", "Lease Obligations": "sm"}


def _cells_sql(m):
    cols = ", ".join(f'{v} AS "{k}"' for k, v in m.items())
    names = ", ".join(f'"{k}"' for k in m)
    return (f"wide AS (SELECT entity, 'quarterly' AS grid, period, {cols} FROM st UNION ALL SELECT entity, 'annual', period, {cols} FROM sty), "
            f"cells AS (UNPIVOT wide ON {names} INTO NAME item VALUE val)")


def _cells(spark, d, m):
    def one(df, grid):
        return df.select("entity", F.lit(grid).alias("grid"), "period", *[F.col(v).alias(k) for k, v in m.items()])
    st, sty = B.statement_pair(spark, d)
    return P.melt(one(st, "quarterly").unionByName(one(sty, "annual")), ["entity", "grid", "period"], list(m), "item", "val")


@query("top01_asset_classes", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')}, {_cells_sql(_LINES)}, dim(item, cat, ord) AS (VALUES ('Goodwill','goodwill',0), ('Net PPE','ppe',3), ('Gross PPE','ppe',6), ('Inventory','inventory',7), ('Receivables','receivables',8)),
  nw AS (SELECT entity, max({{'q': grid = 'quarterly', 'p': period}}) AS b FROM cells GROUP BY 1), c AS (SELECT cells.*, cat, ord FROM cells JOIN dim USING (item) JOIN nw ON nw.entity = cells.entity and nw.b.q = (grid = 'quarterly') and nw.b.p = period WHERE val > 0 QUALIFY row_number() over (partition by cells.entity, cat order by ord) = 1)
  SELECT entity, cat AS category, item, val, row_number() over (partition by entity order by val desc, ord) AS rn FROM c""")
def top01(spark, d):
    return T.top_assets(_cells(spark, d, _LINES), T.line_dimension(spark)).select("entity", "category", "item", "val", "rn")


@query("top02_liabilities", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')}, {_cells_sql(_LIABS)}, dim(item, ord) AS (VALUES {', '.join(f"('{k}', {i})" for i, k in enumerate(T.LIABILITY_LINES))}),
  pos AS (SELECT cells.*, ord FROM cells JOIN dim USING (item) WHERE val > 0), nw AS (SELECT entity, max({{'q': grid = 'quarterly', 'p': period}}) AS b FROM pos GROUP BY 1)
  SELECT pos.entity, item, val, row_number() over (partition by pos.entity order by val desc, ord) AS rn FROM pos JOIN nw ON nw.entity = pos.entity and nw.b.q = (grid = 'quarterly') and nw.b.p = period QUALIFY rn <= 3""")
def top02(spark, d):
    dim = T.line_dimension(spark, [(k, k) for k in T.LIABILITY_LINES])
    return T.top_liabilities(_cells(spark, d, _LIABS), dim).select("entity", "item", "val", "rn")


@query("top04_06_newest_records", """SELECT user_id, event_type AS kind, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) AS rn FROM events QUALIFY rn <= case event_type when 'error' then 3 when 'view' then 2 when 'click' then 4 when 'signup' then 2 else 6 end""")
def top04(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), "event_id", "ts")
    lim = {"error": 3, "view": 2, "click": 4, "signup": 2, "purchase": 6}
    return T.newest_records(e, "user_id", "kind", [F.col("ts").desc(), F.col("event_id").desc()], lim).select("user_id", "kind", "event_id", "rn")


@query("top04_top_in_newest", """WITH m AS (SELECT user_id, max(cast(ts as date)) AS dy FROM events GROUP BY 1) SELECT e.user_id, cast(dy as varchar) AS day, event_id, row_number() over (partition by e.user_id order by value desc, event_id) AS rn FROM events e JOIN m ON m.user_id = e.user_id and cast(ts as date) = dy QUALIFY rn <= 5""")
def top04b(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    return T.top_in_newest(e, "user_id", "day", [F.col("value").desc(), F.col("event_id")], 5).select("user_id", F.col("day").cast("string").alias("day"), "event_id", "rn")


@query("top05_holders", """WITH o AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, o_orderkey, o_totalprice AS v, o_orderstatus AS s FROM orders), w AS (SELECT entity, max(y) AS want FROM o WHERE s = 'F' GROUP BY 1),
  p AS (SELECT o.entity, coalesce(max(case when y = want then y end), max(y)) AS pick FROM o LEFT JOIN w USING (entity) WHERE s <> 'F' GROUP BY 1)
  SELECT o.entity, 'holders' AS list, o_orderkey, row_number() over (partition by o.entity order by v desc, o_orderkey) AS rn FROM o JOIN w ON w.entity = o.entity and y = want WHERE s = 'F' QUALIFY rn <= 10
  UNION ALL SELECT o.entity, 'float', o_orderkey, row_number() over (partition by o.entity order by v desc, o_orderkey) AS rn FROM o JOIN p ON p.entity = o.entity and y = pick WHERE s <> 'F' QUALIFY rn <= 10""")
def top05(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y"), "o_orderkey", F.col("o_totalprice").alias("v"), "o_orderstatus")
    x = T.holders(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "entity", "y", [F.col("v").desc(), F.col("o_orderkey")])
    return x.select("entity", "list", "o_orderkey", "rn")


@query("top07_indicators", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, l AS (SELECT entity, max(period) AS p FROM st WHERE year(period) = 2000 GROUP BY 1), n AS (SELECT st.entity, period, cogs, rd, sm, cash FROM st JOIN l ON l.entity = st.entity and period = p)
  SELECT entity, cast(period as varchar) AS period, indicator, value FROM (UNPIVOT n ON cogs, rd, sm, cash INTO NAME indicator VALUE value)""")
def top07(spark, d):
    x = T.indicator_row(B.statements(spark, d).select("entity", "period", "cogs", "rd", "sm", "cash"), "entity", "period", ["cogs", "rd", "sm", "cash"], "2000")
    return x.select("entity", F.col("period").cast("string").alias("period"), "indicator", "value")


@query("top08_newest_reports", """SELECT o_custkey AS entity, o_orderkey AS accession, case o_orderpriority when '1-URGENT' then '10-K' else '20-F' end AS form, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) AS rn FROM orders WHERE o_orderpriority in ('1-URGENT', '2-HIGH') QUALIFY rn <= 3""")
def top08(spark, d):
    p = F.col("o_orderpriority")
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("accession"), F.col("o_orderdate").alias("filed"),
                                         F.when(p == "1-URGENT", "10-K").when(p == "2-HIGH", "20-F").otherwise("10-K/A").alias("form"))
    return T.newest_reports(f, "entity", 3).select("entity", "accession", "form", "rn")
