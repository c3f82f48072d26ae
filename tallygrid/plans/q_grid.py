"""Period-grid, as-of, ratio and user-metric queries on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators import asof as A
from tallygrid.operators import grid as G
from tallygrid.operators import metrics as M
from tallygrid.operators import ratios as R
from tallygrid.operators import shares as H
from tallygrid.plans import bindings as B
from tallygrid.plans.registry import query, table

iso = lambda c: F.col(c).cast("string").alias(c)
r4 = lambda c, n=None: F.round(F.col(c) if isinstance(c, str) else c, 4).alias(n or c)
r6 = lambda c, n=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(n or c)
W4 = "(PARTITION BY entity ORDER BY period ROWS 3 PRECEDING)"
WE = "(PARTITION BY entity ORDER BY period)"


@query("win03_04_ttm_yoy", f"""WITH {B.NATION_SQL} SELECT entity, cast(period as varchar) AS period, revenue,
  round(case when count(revenue) over {W4} = 4 then sum(revenue) over {W4} end, 2) AS ttm,
  round((revenue - lag(revenue, 4) over {WE}) / nullif(abs(lag(revenue, 4) over {WE}), 0), 6) AS yoy FROM nq""")
def win03_04(spark, d):
    g = G.Grid("entity")
    return B.nation_quarters(spark, d).select("entity", iso("period"), "revenue",
                                              F.round(g.ttm("revenue"), 2).alias("ttm"), r6(g.yoy("revenue"), "yoy"))


@query("win01_rolling_strict", f"""WITH {B.LINES_SQL}, {B.statements_sql()} SELECT entity, cast(period as varchar) AS period,
  round(case when count(cogs) over {W4.replace('3','2')} = 3 then sum(cogs) over {W4.replace('3','2')} end, 3) AS sum3,
  round(case when count(cogs) over {W4.replace('3','1')} = 2 then avg(cogs) over {W4.replace('3','1')} end, 6) AS avg2 FROM st""")
def win01(spark, d):
    g = G.Grid("entity")
    return B.statements(spark, d).select("entity", iso("period"), F.round(g.rolling_sum("cogs", 3), 3).alias("sum3"),
                                         r6(g.rolling_avg("cogs", 2), "avg2"))


@query("win02_lag_rows", f"""WITH {B.LINES_SQL}, {B.statements_sql()} SELECT entity, cast(period as varchar) AS period,
  lag(revenue, 2) over {WE} AS lag2 FROM st""")
def win02(spark, d):
    return B.statements(spark, d).select("entity", iso("period"), G.Grid("entity").lag("revenue", 2).alias("lag2"))


ST = f"WITH {B.LINES_SQL}, {B.statements_sql()}"
STY = f"WITH {B.LINES_SQL}, {B.statements_sql('year')}"
BOTH = f"WITH {B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')}, {B.DERIVED_SQL}, {B.PRICES_SQL}"
RECENT_SQL = """rec AS (SELECT entity, list(shares order by period desc) r, median(shares) med FROM (
  SELECT entity, period, shares, row_number() over (partition by entity order by period desc) rn
  FROM st WHERE shares is not null and shares <> 0) WHERE rn <= 6 GROUP BY 1)"""
BASE_SQL = RECENT_SQL + """, base AS (SELECT entity, case when med = 0 then r[1]
  else coalesce(list_filter(r, lambda x: x between med/2 and med*2)[1], med) end AS base_shares FROM rec)"""
LASTPX_SQL = "lastpx AS (SELECT entity, arg_max(close, month) AS price FROM px WHERE close is not null GROUP BY 1)"


def _base(spark, d, st=None):
    return H.reliable_shares(B.statements(spark, d) if st is None else st)


@query("win11_isolated_spikes", f"""{STY}, w AS (SELECT entity, cast(year(period) as bigint) AS fy, revenue v,
  lag(revenue) over {WE} p, lead(revenue) over {WE} n FROM st)
  SELECT entity, fy, v AS revenue FROM w WHERE p <> 0 and n <> 0 and v <> 0
  and abs(v)/greatest(abs(p),1) > 2 and abs(v)/greatest(abs(n),1) > 2""")
def win11(spark, d):
    y = B.statements(spark, d, "year")
    return G.Grid("entity", annual=True).spikes(y, "revenue").select("entity", F.year("period").cast("bigint").alias("fy"), "revenue")


@query("win12_last_periods", f"""{ST} SELECT entity, cast(period as varchar) AS period, revenue FROM st
  QUALIFY row_number() over (partition by entity order by period desc) <= 8""")
def win12(spark, d):
    return G.Grid("entity").last_n(B.statements(spark, d), 8).select("entity", iso("period"), "revenue")


@query("win13_jn18_prior_year_tint", f"""{ST}, x AS (SELECT entity, year(period) fy, quarter(period) q, revenue FROM st)
  SELECT a.entity, cast(a.fy as bigint) AS fy, cast(a.q as bigint) AS q, a.revenue, b.revenue AS prev_revenue,
  round((a.revenue - b.revenue)/nullif(abs(b.revenue),0), 6) AS delta,
  case when (a.revenue - b.revenue)/nullif(abs(b.revenue),0) >= 0.20 then 'up'
       when (a.revenue - b.revenue)/nullif(abs(b.revenue),0) <= -0.20 then 'down' else '' end AS tint
  FROM x a LEFT JOIN x b ON a.entity = b.entity and a.q = b.q and b.fy = a.fy - 1""")
def win13(spark, d):
    x = B.statements(spark, d).select("entity", F.year("period").cast("bigint").alias("fy"), F.quarter("period").cast("bigint").alias("q"), "revenue")
    y = G.prior_year(x, "entity", "fy", "q", ["revenue"])
    return y.select("entity", "fy", "q", "revenue", "prev_revenue", r6(S.change("revenue", "prev_revenue"), "delta"),
                    G.tint("revenue", "prev_revenue").alias("tint"))


@query("win18_downsample", f"""WITH {B.LINES_SQL}, {B.PRICES_SQL}, w AS (SELECT entity, month, close,
  count(*) over (partition by entity) n, row_number() over (partition by entity order by month) - 1 i FROM px)
  SELECT entity, cast(month as varchar) AS month, close FROM w
  WHERE i % greatest(ceil(n/10.0)::bigint, 1) = 0 or i = n - 1""")
def win18(spark, d):
    return G.downsample(B.prices(spark, d), ["entity"], "month", 10).select("entity", iso("month"), "close")


@query("win19_next_sibling", """SELECT c_custkey AS entity, c_mktsegment AS industry,
  case when count(*) over (partition by c_mktsegment) > 1 then coalesce(lead(c_custkey) over (partition by c_mktsegment order by c_custkey),
   min(c_custkey) over (partition by c_mktsegment)) end AS next_entity FROM customer""")
def win19(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("industry"))
    return G.next_sibling(c, "industry", "entity", F.floor(F.col("entity") / 100000), "next_entity")


@query("win24_pad_slots", f"""{STY}, r AS (SELECT *, 11 - row_number() over (partition by entity order by period desc) AS slot FROM st)
  SELECT e.entity, s.slot::bigint AS slot, cast(r.period as varchar) AS period, r.revenue
  FROM (SELECT DISTINCT entity FROM st) e, (SELECT unnest(range(1, 11)) AS slot) s
  LEFT JOIN r ON r.entity = e.entity and r.slot = s.slot""")
def win24(spark, d):
    y = B.statements(spark, d, "year").select("entity", "period", "revenue")
    return G.Grid("entity", annual=True).pad_left(y, 10).select("entity", "slot", iso("period"), "revenue")


@query("win25_year_ticks", f"""WITH {B.LINES_SQL}, {B.PRICES_SQL} SELECT entity, cast(year(month) as bigint) AS year,
  cast(min(month) as varchar) AS tick FROM px GROUP BY 1, 2""")
def win25(spark, d):
    return G.first_of_year(B.prices(spark, d), "entity", "month").select("entity", "year", iso("tick"))


@query("win26_min_max_bars", f"""WITH {B.LINES_SQL}, {B.PRICES_SQL}, w AS (SELECT *, min(close) over (partition by entity) lo,
  max(close) over (partition by entity) hi FROM px) SELECT entity, cast(month as varchar) AS month,
  round((close - lo)/nullif(hi - lo, 0), 6) AS scaled, round(least(abs(close - 1500), 80), 6) AS bar FROM w""")
def win26(spark, d):
    x = G.min_max(B.prices(spark, d), ["entity"], "close", "scaled")
    return x.select("entity", iso("month"), r6("scaled"), r6(G.bar_height(F.col("close") - 1500), "bar"))


# --- as-of ---------------------------------------------------------------------------------------------

@query("jn07_asof_latest", """WITH f AS (SELECT user_id, cast(ts as date) AS day, arg_max(value, {'t': ts, 'e': event_id}) AS v
  FROM events WHERE event_type in ('purchase', 'click') GROUP BY 1, 2)
  SELECT p.event_id, p.user_id, f.v AS last_purchase FROM (SELECT *, cast(ts as date) AS day FROM events WHERE event_type not in ('purchase', 'click')) p
  ASOF LEFT JOIN f ON p.user_id = f.user_id and p.day >= f.day""")
def jn07(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    buys = e.where("event_type in ('purchase', 'click')").select("user_id", "ts", "event_id", F.col("value").alias("last_purchase"))
    probes = e.where("event_type not in ('purchase', 'click')").select("event_id", "user_id", "ts")
    return A.asof(probes, buys, ["user_id"], "ts", "ts", ["last_purchase"], grain="day", tie=["event_id"]) \
        .select("event_id", "user_id", "last_purchase")


@query("jn08_close_at_quarter_end", f"""{ST}, {B.PRICES_SQL} SELECT s.entity, cast(s.period as varchar) AS period, p.close
  FROM st s ASOF LEFT JOIN px p ON s.entity = p.entity and cast(date_trunc('month', s.period) as date) >= p.month""")
def jn08(spark, d):
    q = B.statements(spark, d).select("entity", "period")
    return A.asof(q, B.prices(spark, d), ["entity"], "period", "month", ["close"], probes_unique=True) \
        .select("entity", iso("period"), "close")


@query("jn09_fiscal_year_on_grid", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')}
  SELECT s.entity, cast(s.period as varchar) AS period, y.net_income AS net_income_fy
  FROM st s ASOF LEFT JOIN (SELECT entity, make_date(year(period)::bigint, 12, 1) AS vis, net_income FROM sty WHERE net_income is not null) y
  ON s.entity = y.entity and cast(date_trunc('month', s.period) as date) >= y.vis""")
def jn09(spark, d):
    q = B.statements(spark, d).select("entity", "period")
    y = B.statements(spark, d, "year").select("entity", F.year("period").alias("fy"), "net_income")
    return A.fiscal_year_on_grid(q, y, ["entity"], "period", "fy", "net_income", "net_income_fy").select("entity", iso("period"), "net_income_fy")


@query("jn10_statement_join", f"""{ST} SELECT i.entity, cast(i.period as varchar) AS period, i.revenue, b.cash, c.ocf FROM st i
  LEFT JOIN (SELECT * FROM st WHERE cash is not null) b ON i.entity = b.entity and i.period = b.period
  LEFT JOIN (SELECT * FROM st WHERE ocf is not null) c ON i.entity = c.entity and i.period = c.period""")
def jn10(spark, d):
    from tallygrid.operators.blend import statement_join
    st = B.statements(spark, d)
    k = ["entity", "period"]
    x = statement_join(st.select(*k, "revenue"), st.where("cash is not null").select(*k, "cash"),
                       st.where("ocf is not null").select(*k, "ocf"), k)
    return x.select("entity", iso("period"), "revenue", "cash", "ocf")


@query("jn11_exact_month_price", f"""{ST}, {B.PRICES_SQL} SELECT s.entity, cast(s.period as varchar) AS period, p.close
  FROM st s LEFT JOIN px p ON s.entity = p.entity and cast(date_trunc('month', s.period) as date) = p.month""")
def jn11(spark, d):
    q = B.statements(spark, d).select("entity", "period").withColumn("_b", F.trunc("period", "month"))
    m = A.newest_in_bucket(B.prices(spark, d), ["entity"], "month", ["close"], "month")
    return q.join(m, ["entity", "_b"], "left").select("entity", iso("period"), "close")


@query("jn12_contained_quarters", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')}
  SELECT y.entity, cast(year(y.period) as bigint) AS fy, count(*) AS n, round(sum(q.revenue), 2) AS q_sum FROM sty y
  JOIN st q ON q.entity = y.entity and date_trunc('quarter', q.period) >= make_date(year(y.period)::bigint, 1, 1) and q.period <= y.period GROUP BY 1, 2""")
def jn12(spark, d):
    from tallygrid.operators.quality import contained_quarters
    y = B.statements(spark, d, "year").select("entity", F.year("period").cast("bigint").alias("fy"),
                                              F.trunc("period", "year").alias("start"), F.col("period").alias("end"), "revenue")
    q = B.statements(spark, d).select("entity", F.trunc("period", "quarter").alias("start"), F.col("period").alias("end"), "revenue")
    return contained_quarters(y, q).select("entity", "fy", "n", F.round("q_sum", 2).alias("q_sum"))


@query("jn20_agg13_dividend_cash", f"""{ST}, dv AS (SELECT o_custkey AS entity, cast(l_shipdate as date) AS pay, disc/100.0::double AS per_share
  FROM li JOIN orders ON l_orderkey = o_orderkey WHERE rf = 'A' and disc <> 0)
  SELECT dv.entity, cast({B.QEND.format('dv.pay')} as varchar) AS quarter, round(-sum(per_share * s.shares), 4) AS paid
  FROM dv ASOF JOIN (SELECT entity, period, shares FROM st WHERE shares <> 0) s ON dv.entity = s.entity and dv.pay >= s.period GROUP BY 1, 2""")
def jn20(spark, d):
    return _dividends(spark, d).select("entity", iso("quarter"), r4("cash_dividends_paid", "paid"))


def _dividends(spark, d):
    from tallygrid.operators.extract import dividend_cash
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", *B.line_columns())
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"))
    dv = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "entity", F.col("l_shipdate").cast("date").alias("pay_date"), (F.col("disc") / F.lit(100.0)).alias("per_share"),
        (F.col("rf") == "A").alias("executed"))
    sh = B.statements(spark, d).select("entity", F.col("period").alias("end"), "shares")
    return dividend_cash(dv, sh)


@query("agg14_annual_dividends", f"""{ST}, dv AS (SELECT o_custkey AS entity, cast(l_shipdate as date) AS pay, disc/100.0::double AS per_share
  FROM li JOIN orders ON l_orderkey = o_orderkey WHERE rf = 'A' and disc <> 0)
  SELECT dv.entity, cast(year(dv.pay) as bigint) AS fy, round(-sum(per_share * s.shares), 4) AS paid
  FROM dv ASOF JOIN (SELECT entity, period, shares FROM st WHERE shares <> 0) s ON dv.entity = s.entity and dv.pay >= s.period GROUP BY 1, 2""")
def agg14(spark, d):
    return _dividends(spark, d).groupBy("entity", F.year("quarter").cast("bigint").alias("fy")).agg(
        F.round(F.sum("cash_dividends_paid"), 4).alias("paid"))


# --- shares, closes, caps ----------------------------------------------------------------------------------

@query("agg03_latest_close", f"""WITH {B.LINES_SQL}, {B.PRICES_SQL}, {LASTPX_SQL} SELECT entity, price FROM lastpx""")
def agg03(spark, d):
    return H.latest_close(B.prices(spark, d)).select("entity", "price")


@query("agg04_05_reliable_shares", f"""{ST}, {BASE_SQL} SELECT base.entity, round(med, 4) AS med, round(base_shares, 4) AS base_shares
  FROM base JOIN rec USING (entity)""")
def agg05(spark, d):
    st = B.statements(spark, d).select("entity", "period", "shares")
    med = H.recent_counts(st).groupBy("entity").agg(F.round(F.median("shares"), 4).alias("med"))
    return H.reliable_shares(st).join(med, "entity").select("entity", "med", r4("base_shares"))


ANCHOR_SQL = f"""{LASTPX_SQL}, anc AS (SELECT c_custkey AS entity,
  case when price <> 0 then cap / (price / case when c_nationkey % 2 = 0 then 1.0::double else 7.0::double end) end AS anchor
  FROM (SELECT *, case when c_acctbal > 0 then c_acctbal * 30 end AS cap FROM customer) LEFT JOIN lastpx ON entity = c_custkey)"""


def _anchors(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 30).alias("market_cap"),
        F.when(F.col("c_nationkey") % 2 == 0, 1.0).otherwise(7.0).alias("price_fx"))
    return H.implied_shares(c, B.prices(spark, d))


@query("agg06_implied_shares", f"""WITH {B.LINES_SQL}, {B.PRICES_SQL}, {ANCHOR_SQL} SELECT entity, round(anchor, 6) AS anchor FROM anc""")
def agg06(spark, d):
    return _anchors(spark, d).select("entity", r6("anchor"))


@query("agg05_anchored_shares", f"""{ST}, {B.PRICES_SQL}, {RECENT_SQL}, {ANCHOR_SQL}, j AS (
  SELECT coalesce(rec.entity, anc.entity) AS entity, r, med, nullif(anchor, 0) AS a FROM rec FULL JOIN anc ON rec.entity = anc.entity)
  SELECT entity, round(case when a is not null then coalesce(list_filter(r, lambda x: x between a/3 and a*3)[1], a)
   when med = 0 then r[1] else coalesce(list_filter(r, lambda x: x between med/2 and med*2)[1], med) end, 4) AS base_shares FROM j""")
def agg05b(spark, d):
    return H.reliable_shares(B.statements(spark, d), _anchors(spark, d)).select("entity", r4("base_shares"))


@query("agg07_recomputed_cap", f"""{ST}, {B.PRICES_SQL}, {BASE_SQL}, {LASTPX_SQL} SELECT base.entity, price * base_shares AS market_cap
  FROM base LEFT JOIN lastpx USING (entity)""")
def agg07(spark, d):
    return H.recomputed_cap(B.prices(spark, d), _base(spark, d)).select("entity", "market_cap")


@query("agg01_02_ttm_and_latest", f"""{ST}, r AS (SELECT *, row_number() over (partition by entity order by period desc) rn FROM st)
  SELECT entity, round(case when count(case when rn <= 4 then cogs end) = 4 then sum(case when rn <= 4 then cogs end) end, 3) AS ttm_cogs,
  arg_max(cogs, period) FILTER (WHERE cogs is not null) AS latest_cogs, cast(arg_max_null(cogs, period) is not null as boolean) AS newest_has_cogs
  FROM r GROUP BY 1""")
def agg01(spark, d):
    x = R.ranked(B.statements(spark, d).select("entity", "period", "cogs"))
    return x.groupBy("entity").agg(F.round(R.strict_sum("cogs"), 3).alias("ttm_cogs"), R.newest_value("cogs").alias("latest_cogs"),
                                   R.newest_key_value("cogs").isNotNull().alias("newest_has_cogs"))


@query("agg08_dividend_per_share", f"""{ST}, {BASE_SQL}, r AS (SELECT entity, sum(abs(dividends)) AS dv FROM (
  SELECT *, row_number() over (partition by entity order by period desc) rn FROM st) WHERE rn <= 4 GROUP BY 1)
  SELECT r.entity, round(case when nullif(base_shares, 0) is not null then coalesce(dv, 0)/base_shares end, 6) AS dps FROM r LEFT JOIN base USING (entity)""")
def agg08(spark, d):
    st = B.statements(spark, d)
    t = R.newest_four(st).groupBy("entity").agg(F.sum(F.abs("dividends")).alias("dv"))
    return t.join(_base(spark, d, st), "entity", "left").select("entity", r6(R.dividend_per_share("dv", "base_shares"), "dps"))


@query("win16_valuation_history", f"""{BOTH}, {BASE_SQL},
  f AS (SELECT entity, month, close,
    (SELECT arg_max(net_income, period) FROM sty y WHERE y.entity = px.entity and date_trunc('month', y.period) <= px.month and net_income is not null) AS ni,
    (SELECT arg_max(revenue, period) FROM sty y WHERE y.entity = px.entity and date_trunc('month', y.period) <= px.month and revenue is not null) AS rev,
    coalesce(nullif((SELECT arg_max(shares, period) FROM st y WHERE y.entity = px.entity and date_trunc('month', y.period) <= px.month and shares is not null), 0),
             (SELECT arg_max(shares, period) FROM sty y WHERE y.entity = px.entity and date_trunc('month', y.period) <= px.month and shares is not null)) AS sh,
    coalesce(nullif((SELECT arg_max(equity, period) FROM st y WHERE y.entity = px.entity and date_trunc('month', y.period) <= px.month and equity is not null), 0),
             (SELECT arg_max(equity, period) FROM sty y WHERE y.entity = px.entity and date_trunc('month', y.period) <= px.month and equity is not null)) AS bv
    FROM px), g AS (SELECT f.*, close * case when sh <> 0 and b.base_shares <> 0 and sh not between b.base_shares/2 and b.base_shares*2 then b.base_shares else sh end AS cap
    FROM f LEFT JOIN base b ON b.entity = f.entity)
  SELECT entity, cast(month as varchar) AS month, round(cap/nullif(ni, 0), 6) AS static_pe, round(cap/nullif(rev, 0), 6) AS static_ps, round(cap/nullif(bv, 0), 6) AS pb
  FROM g WHERE coalesce(cap/nullif(ni, 0), cap/nullif(rev, 0), cap/nullif(bv, 0)) is not null""")
def win16(spark, d):
    st, y = B.statement_pair(spark, d)
    v = A.valuation_history(B.prices(spark, d), st, y, _base(spark, d, st))
    return v.select("entity", iso("month"), r6("static_pe"), r6("static_ps"), r6("pb"))


@query("win17_quarterly_multiples", f"""{BOTH}, {BASE_SQL}, q AS (SELECT * FROM dst QUALIFY row_number() over (partition by entity order by period desc) <= 4),
  j AS (SELECT q.*, p.close, b.base_shares bs FROM q ASOF LEFT JOIN px p ON q.entity = p.entity and cast(date_trunc('month', q.period) as date) >= p.month
   LEFT JOIN base b ON b.entity = q.entity), k AS (SELECT *, close * nullif(coalesce(case when shares = 0 or (bs <> 0 and shares not between bs/2 and bs*2) then null else shares end, bs), 0) AS cap FROM j)
  SELECT entity, cast(period as varchar) AS period, round(cap/nullif(net_income*4, 0), 6) AS pqe, round(cap/nullif(fcf*4, 0), 6) AS pqfcf FROM k""")
def win17(spark, d):
    st = B.derived(B.statements(spark, d))
    m = A.quarterly_multiples(st.select("entity", "period", "net_income", "fcf", "shares"), B.prices(spark, d), _base(spark, d, st))
    return m.select("entity", iso("period"), r6("pqe"), r6("pqfcf"))


# --- snapshot ------------------------------------------------------------------------------------------------

def _ttm(m):
    return f"case when count(case when rn <= 4 then {m} end) = 4 then sum(case when rn <= 4 then {m} end) end AS ttm_{m}"


def _newest(e, n):
    return f"arg_max({e}, period) FILTER (WHERE {e} is not null) AS {n}"


SNAP_SQL = f"""{BOTH}, {BASE_SQL}, {LASTPX_SQL}, rk AS (SELECT *, net_income + coalesce(rd, 0) AS ebitda, row_number() over (partition by entity order by period desc) rn FROM dst),
  a AS (SELECT entity, {', '.join(_ttm(m) for m in R.SUMMED + ['ebitda'])}, sum(case when rn <= 4 then abs(dividends) end) AS dv,
    {_newest('equity', 'bv')}, {_newest('coalesce(cash_all, cash)', 'cashv')}, {_newest('coalesce(cash, cash_all)', 'cashr')}, {_newest('coalesce(total_debt, lt_debt)', 'debt')}, {_newest('assets', 'av')} FROM rk GROUP BY 1),
  y AS (SELECT entity, {_newest('net_income', 'ni_y')} FROM sty GROUP BY 1),
  s AS (SELECT a.*, ni_y, base_shares, price * base_shares AS cap, price * base_shares + debt - coalesce(cashv, 0) AS ev, price * base_shares + debt - coalesce(cashr, 0) AS evr
    FROM a LEFT JOIN y USING (entity) LEFT JOIN base USING (entity) LEFT JOIN lastpx USING (entity))"""


def _snap_cols(ev):
    return f"""entity, cap AS market_cap, round(cap/nullif(ttm_net_income,0), 6) AS ttm_pe, round(cap/nullif(ni_y,0), 6) AS static_pe,
  round({ev}/nullif(ttm_revenue,0), 6) AS ev_revenue, round(cap/nullif(bv,0), 6) AS pb, round(cap/nullif(ttm_revenue,0), 6) AS ps, round(cap/nullif(ttm_fcf,0), 6) AS p_fcf,
  round(cap/nullif(ttm_ocf,0), 6) AS ttm_pocf, round(debt/nullif(av,0), 6) AS debt_asset, round(ttm_gross_profit/nullif(ttm_revenue,0), 6) AS gross_margin,
  round(ttm_op_income/nullif(ttm_revenue,0), 6) AS op_margin, round(ttm_net_income/nullif(ttm_revenue,0), 6) AS net_margin, round(ttm_net_income/nullif(bv,0), 6) AS roe,
  round(ttm_net_income/nullif(av,0), 6) AS roa, round(case when nullif(base_shares,0) is not null then coalesce(dv,0)/base_shares end, 6) AS dividend_rate"""


def snapshot_frame(spark, d, ebitda=False, pair=None):
    q, y = pair or B.statement_pair(spark, d)
    st = B.derived(q)
    if ebitda:
        st = st.withColumn("ebitda", F.col("net_income") + F.coalesce("rd", F.lit(0.0)))
    return R.snapshot(st, y, B.prices(spark, d), _base(spark, d, st), ebitda=ebitda, cash_keys=("cash", "cash_all") if ebitda else ("cash_all", "cash"))


@query("kpi01_snapshot", f"{SNAP_SQL} SELECT {_snap_cols('ev')} FROM s")
def kpi01(spark, d):
    x = snapshot_frame(spark, d)
    return x.select("entity", "market_cap", *[r6(c) for c in x.columns if c not in ("entity", "market_cap")])


@query("kpi03_report_snapshot", f"{SNAP_SQL} SELECT {_snap_cols('evr')}, round(evr/nullif(ttm_ebitda,0), 6) AS ev_ebitda FROM s")
def kpi03(spark, d):
    x = snapshot_frame(spark, d, ebitda=True)
    return x.select("entity", "market_cap", *[r6(c) for c in x.columns if c not in ("entity", "market_cap")])


@query("kpi02_snapshot_served", f"""{SNAP_SQL}, lq AS (SELECT entity, arg_max(net_income, period) AS lni, arg_max_null(ocf, period) AS locf FROM dst WHERE net_income is not null GROUP BY 1)
  SELECT c_custkey AS entity, coalesce(cap, c_acctbal) AS market_cap, round(cap/nullif(ttm_net_income,0), 6) AS ttm_pe, lni AS latest_q_ni, locf AS latest_q_ocf
  FROM customer LEFT JOIN s ON s.entity = c_custkey LEFT JOIN lq ON lq.entity = c_custkey""")
def kpi02(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("market_cap"))
    pair = B.statement_pair(spark, d)
    x = R.snapshot_served(c, snapshot_frame(spark, d, pair=pair), B.derived(pair[0]))
    return x.select("entity", "market_cap", r6("ttm_pe"), "latest_q_ni", "latest_q_ocf")


@query("kpi04_flt24_table_columns", f"""{BOTH}, x AS (SELECT *, net_income/nullif(shares,0) AS eps FROM dst),
  j AS (SELECT x.*, p.close, y.net_income ni_y, y.revenue rev_y FROM x LEFT JOIN px p ON p.entity = x.entity and p.month = cast(date_trunc('month', x.period) as date)
    ASOF LEFT JOIN sty y ON x.entity = y.entity and cast(date_trunc('month', x.period) as date) >= cast(date_trunc('month', y.period) as date))
  SELECT entity, cast(period as varchar) AS period, revenue, gross_profit, op_income, net_income, eps AS eps, shares, ocf, fcf, abs(capex) AS capex, coalesce(cash_all, cash) AS cash_any,
  coalesce(total_debt, lt_debt) AS debt_any, assets, equity, revenue/nullif(shares,0) AS sps, equity/nullif(shares,0) AS bvps, gross_profit/nullif(revenue,0) AS gm,
  op_income/nullif(revenue,0) AS om, net_income/nullif(revenue,0) AS nm, rd/nullif(revenue,0) AS rd_r, sm/nullif(revenue,0) AS sm_r,
  ga/nullif(revenue,0) AS ga_r, sga/nullif(revenue,0) AS sga_r, (gross_profit - op_income - coalesce(rd,0) - coalesce(sga, sm + ga))/nullif(revenue,0) AS other_r,
  (cash+sti)/nullif(st_debt,0) AS current_ratio, shares*close/nullif(ni_y,0) AS static_pe, shares*close/nullif(rev_y,0) AS static_ps, shares*close/nullif(equity,0) AS pb,
  (shares*close + coalesce(total_debt, lt_debt) - coalesce(cash_all, cash))/nullif(op_income + rd,0) AS ev_ebitda, op_income + rd AS ebitda, op_income - ga AS pretax_income, op_income - ga - net_income AS income_tax, ga AS interest_expense, assets - equity AS total_liabilities,
  cash + sti AS cur_assets, st_debt AS cur_liab, equity - cash AS retained_earnings, case when quarter(period) = 2 then '6k' else 'sec' end AS revenue_src, case when cash is not null then case when lt_debt is null then 'yfinance' else 'sec' end end AS cash_src FROM j""")
def kpi04(spark, d):
    q, y = B.statement_pair(spark, d)
    st = B.derived(q).withColumn("cur_assets", F.col("cash") + F.col("sti")).withColumn("cur_liab", F.col("st_debt"))
    c = F.col
    st = st.select("*", (c("op_income") + c("rd")).alias("ebitda"), (c("op_income") - c("ga")).alias("pretax_income"), (c("op_income") - c("ga") - c("net_income")).alias("income_tax"), c("ga").alias("interest_expense"),
                   (c("assets") - c("equity")).alias("total_liabilities"), (c("equity") - c("cash")).alias("retained_earnings"), F.when(F.quarter("period") == 2, "6k").otherwise("sec").alias("revenue_src"),
                   F.when(c("cash").isNotNull(), F.when(c("lt_debt").isNull(), "yfinance").otherwise("sec")).alias("cash_src"))
    x = R.table_columns(st, B.prices(spark, d), y)
    return x.select("entity", iso("period"), *[c for c in x.columns if c not in ("entity", "period")])


# --- user metrics -----------------------------------------------------------------------------------------------

GRID_SQL = f"""{BOTH}, {BASE_SQL}, gr AS (SELECT s.*, p.close AS price, p.close * case when nullif(b.base_shares,0) is null then nullif(s.shares,0)
   when s.shares between b.base_shares/3 and b.base_shares*3 and s.shares <> 0 then s.shares else b.base_shares end AS mcap
   FROM dst s ASOF LEFT JOIN px p ON s.entity = p.entity and cast(date_trunc('month', s.period) as date) >= p.month LEFT JOIN base b ON b.entity = s.entity)"""


def metric_grid(spark, d):
    st = B.derived(B.statement_pair(spark, d)[0])
    return M.base_grid(st, B.prices(spark, d), _base(spark, d, st))


@query("kpi06_base_grid", f"""{GRID_SQL} SELECT entity, cast(period as varchar) AS period, revenue, equity, fcf, shares, price, mcap FROM gr""")
def kpi06(spark, d):
    return metric_grid(spark, d).select("entity", iso("period"), "revenue", "equity", "fcf", "shares", "price", "mcap")


@query("kpi06_alias_grid", f"""{ST} SELECT entity, cast(period as varchar) AS period, revenue, cogs, gross_profit, op_income, net_income, net_income - sga AS eps, sga, sm AS s_and_m, ga AS g_and_a, ocf, capex, ocf - abs(coalesce(capex, 0)) AS fcf, shares, cash, sti,
  {', '.join(f'cast(null as double) AS {a}' for a in ('restricted_cash', 'receivables', 'inventory', 'ppe', 'goodwill', 'intangibles', 'lt_investments', 'leases', 'ap', 'accrued', 'deferred_revenue'))},
  cash + coalesce(sti, 0) AS cash_all, assets AS total_assets, assets - equity AS total_liabilities, equity, case when lt_debt is not null or st_debt is not null then coalesce(lt_debt, 0) + coalesce(st_debt, 0) end AS total_debt, st_debt AS current_debt, lt_debt FROM st
  WHERE coalesce(revenue, cogs, gross_profit, op_income, net_income, sga, sm, ga, ocf, capex, shares, cash, sti, assets, equity, lt_debt, st_debt) is not null""")
def kpi06b(spark, d):
    from tallygrid.plans.company import labelled
    from tallygrid.sources.mappings import METRIC_LABELS as L
    st = B.statements(spark, d)
    more = st.select("entity", "period", (F.col("net_income") - F.col("sga")).alias(L["diluted_eps"]), (F.col("assets") - F.col("equity")).alias(L["total_liabilities"]))
    more = more.unpivot(["entity", "period"], more.columns[2:], "item", "val").where("val is not null")
    x = M.alias_grid(labelled(st, "quarterly").drop("grid").unionByName(more), "entity", "period")
    return x.select("entity", iso("period"), *[c for c in x.columns if c not in ("entity", "period")])


def _w4(m):
    return f"case when count({m}) over {W4} = 4 then sum({m}) over {W4} end"


@query("kpi07_shorthands", f"""{GRID_SQL} SELECT entity, cast(period as varchar) AS period, round(mcap/nullif({_w4('net_income')},0), 6) AS pe, round(mcap/nullif(equity,0), 6) AS pb,
  round(mcap/nullif({_w4('revenue')},0), 6) AS ps, round(mcap/nullif({_w4('fcf')},0), 6) AS pfcf, round(mcap/nullif({_w4('ocf')},0), 6) AS pocf, mcap + total_debt - cash_all AS ev FROM gr""")
def kpi07(spark, d):
    g = M.MetricGrid("entity")
    return metric_grid(spark, d).select("entity", iso("period"), *[r6(g.derived(n), n) for n in ("pe", "pb", "ps", "pfcf", "pocf")], g.derived("ev").alias("ev"))


METRICS = [M.Metric("growing", "case when revenue_yoy is not null and fcf is not null then double(int(revenue_yoy > 0.2 and fcf > 0)) end", "number", 0),
           M.Metric("margin", "net_income / nullif(revenue, 0)", "percent", 1),
           M.Metric("accel", "revenue_ttm / nullif(revenue_avg2, 0)", "ratio", 2)]


def _metric_values(spark, d):
    g = M.MetricGrid("entity")
    x = M.windows_first(metric_grid(spark, d), g, sums=["revenue"], changes=["revenue"], averages={"revenue": 2})
    return M.evaluate(x, METRICS, ["entity", "period"])


MV_SQL = f"""{GRID_SQL}, h AS (SELECT *, (revenue - lag(revenue,4) over {WE})/nullif(abs(lag(revenue,4) over {WE}),0) AS yoy, {_w4('revenue')} AS ttm,
   case when count(revenue) over {W4.replace('3','1')} = 2 then avg(revenue) over {W4.replace('3','1')} end AS avg2 FROM gr),
   mv AS (SELECT entity, period, case when yoy is not null and fcf is not null then cast(cast(yoy > 0.2 and fcf > 0 as int) as double) end AS growing,
   net_income/nullif(revenue,0) AS margin, ttm/nullif(avg2,0) AS accel FROM h)"""


@query("kpi08_udx01_metric_values", f"{MV_SQL} SELECT entity, cast(period as varchar) AS period, growing, round(margin, 6) AS margin, round(accel, 6) AS accel FROM mv")
def kpi08(spark, d):
    return _metric_values(spark, d).select("entity", iso("period"), "growing", r6("margin"), r6("accel"))


@query("agg43_rm14_metric_latest", f"""{MV_SQL}, l AS (SELECT * FROM mv QUALIFY row_number() over (partition by entity order by period desc) <= 8)
  SELECT entity, arg_max(growing, period) FILTER (WHERE growing is not null) AS growing, round(arg_max(margin, period) FILTER (WHERE margin is not null), 6) AS margin,
  round(arg_max(accel, period) FILTER (WHERE accel is not null), 6) AS accel FROM l GROUP BY 1""")
def agg43(spark, d):
    x = M.newest_values(_metric_values(spark, d), "entity", "period", ["growing", "margin", "accel"], last_n=8)
    return x.select("entity", "growing", r6("margin"), r6("accel"))


@query("kpi09_rm15_metric_points", f"""{MV_SQL} SELECT entity, metric, count(*) AS points, round(sum(value), 4) AS total FROM (
  UNPIVOT (SELECT entity, growing, margin, accel FROM mv) ON growing, margin, accel INTO NAME metric VALUE value) GROUP BY 1, 2""")
def kpi09(spark, d):
    m = M.metric_maps(_metric_values(spark, d), "entity", "period", ["growing", "margin", "accel"])
    return m.select("entity", "metric", F.size("points").cast("bigint").alias("points"),
                    F.round(F.aggregate(F.map_values("points"), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("kpi10_udx03_chart_data", f"""{MV_SQL} SELECT entity, cast(period as varchar) AS period, round(margin, 6) AS margin, growing FROM mv
  QUALIFY row_number() over (partition by entity order by period desc) <= 6""")
def kpi10(spark, d):
    g = M.MetricGrid("entity")
    x = M.windows_first(metric_grid(spark, d), g, changes=["revenue"])
    c = M.Chart("margins", (M.Metric("margin", METRICS[1].expr), M.Metric("growing", METRICS[0].expr)), 6)
    return M.chart_data(x, c, "entity", "period").select("entity", iso("period"), r6("margin"), "growing")


@query("jn19_udx02_user_series", f"""{ST}, pts AS (SELECT o_custkey AS entity, strftime(o_orderdate, '%Y-%m') AS k,
  arg_max(o_totalprice, {{'p': cast(cast(o_orderdate as date) as varchar), 'o': o_orderkey}}) AS v FROM orders GROUP BY 1, 2)
  SELECT s.entity, cast(s.period as varchar) AS period, s.revenue, v AS s_gmv FROM st s LEFT JOIN pts ON pts.entity = s.entity and pts.k = strftime(s.period, '%Y-%m')""")
def jn19(spark, d):
    pts = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").cast("string").alias("period"),
                                           F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ordinal"))
    g = B.statements(spark, d).select("entity", "period", "revenue")
    return M.align_series(pts, g, "entity", "gmv").select("entity", iso("period"), "revenue", "s_gmv")


@query("agg17_complete_years", f"""{ST} SELECT entity, cast(year(period) as varchar) AS fy,
  round(case when count(*) = 4 and count(cogs) = 4 then sum(cogs) end, 3) AS value FROM st GROUP BY 1, 2""")
def agg17(spark, d):
    p = B.statements(spark, d).select("entity", F.col("period").cast("string").alias("period"), F.col("cogs").alias("value"))
    return M.complete_years(p, ["entity"]).select("entity", "fy", F.round("value", 3).alias("value"))


@query("flt25_applicable_metrics", """WITH have AS (SELECT DISTINCT user_id AS entity, event_type || day(ts) % 15 AS series FROM events),
  need(metric, series) AS (VALUES ('m1','view1'), ('m1','click2'), ('m2','purchase3'), ('m3','view1'), ('m3','click4'), ('m3','purchase5'), ('m3','error6'))
  SELECT n.metric, h.entity FROM need n JOIN have h USING (series) GROUP BY 1, 2
  HAVING count(*) = (SELECT count(*) FROM need x WHERE x.metric = n.metric)""")
def flt25(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.concat("event_type", (F.dayofmonth("ts") % 15).cast("string")).alias("series"))
    need = spark.createDataFrame([("m1", "view1"), ("m1", "click2"), ("m2", "purchase3"), ("m3", "view1"), ("m3", "click4"), ("m3", "purchase5"), ("m3", "error6")],
                                 "metric string, series string")
    return M.applicable(need, e)


@query("flt26_recent_window", f"""WITH {B.LINES_SQL}, {B.PRICES_SQL} SELECT p.entity, cast(month as varchar) AS month, close FROM px p
  JOIN (SELECT entity, max(month) AS top FROM px GROUP BY 1) t ON t.entity = p.entity WHERE month >= top - interval 12 month""")
def flt26(spark, d):
    from tallygrid.operators.select import recent_from_newest
    return recent_from_newest(B.prices(spark, d), "entity", "month", 12).select("entity", iso("month"), "close")


@query("agg31_price_range", f"""WITH {B.LINES_SQL}, {B.PRICES_SQL}, r AS (SELECT *, row_number() over (partition by entity order by month desc) rn FROM px)
  SELECT entity, min(close) AS lo, max(close) AS hi, arg_max(close, month) AS latest, count(case when rn <= 12 then 1 end) AS shown,
  round(sum(case when rn <= 12 then close end), 4) AS last12 FROM r GROUP BY 1""")
def agg31(spark, d):
    from tallygrid.operators.inventory import price_range
    x = price_range(B.prices(spark, d))
    return x.select("entity", "lo", "hi", "latest", F.size("recent").cast("bigint").alias("shown"),
                    F.round(F.aggregate("recent", F.lit(0.0), lambda a, v: a + v), 4).alias("last12"))


@query("udx01_sql_functions", f"""{ST} SELECT entity, cast(period as varchar) AS period, ocf/nullif(capex,0) AS cover, case when ocf is not null and capex is not null then greatest(ocf, capex) end AS larger,
  case when ocf is not null and capex is not null then cast((ocf > 50000 and capex > 2000)::int as double) end AS strong, cast(case when month(period) >= 6 then year(period) else year(period) - 1 end as integer) AS fy FROM st""")
def udx01(spark, d):
    from tallygrid.functions.sql import register_sql_functions
    register_sql_functions(spark)
    m = [M.Metric("cover", "safe_div(ocf, capex)"), M.Metric("larger", "max_of(ocf, capex)", position=1),
         M.Metric("strong", "both_true(double(int(ocf > 50000)), double(int(capex > 2000)))", position=2)]
    x = M.evaluate(B.statements(spark, d), m, ["entity", "period"])
    return x.select("entity", iso("period"), "cover", "larger", "strong", F.expr("fy_of(period)").alias("fy"))


@query("udx04_flow_check", f"""{ST} SELECT entity, count(*) AS periods, case when count(case when rn <= 4 then ocf end) = 4 then round(sum(case when rn <= 4 then ocf end), 4) end AS ttm_ocf, 'a trailing sum does not apply to' AS refused FROM (SELECT *, row_number() over (partition by entity order by period desc) rn FROM st) GROUP BY 1""")
def udx04(spark, d):
    """A trailing sum is accepted for a flow and refused for a stock item before any job runs."""
    g = M.MetricGrid("entity")
    try:
        g.ttm_of("equity")
        said = "accepted"
    except M.MetricError as e:
        said = str(e)[:32]
    x = B.statements(spark, d).select("entity", "period", g.ttm_of("ocf").alias("t"))
    return x.groupBy("entity").agg(F.count(F.lit(1)).alias("periods"), F.round(F.max_by("t", "period"), 4).alias("ttm_ocf")).withColumn("refused", F.lit(said))
