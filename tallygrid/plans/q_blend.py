"""Extraction, blend and currency queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators import blend as L
from tallygrid.operators import extract as X
from tallygrid.operators import fx as FX
from tallygrid.operators import shares as H
from tallygrid.plans import bindings as B
from tallygrid.plans.registry import query, table
from tallygrid.sources import mappings as M
from tallygrid.sources import payloads as P

iso = lambda c: F.col(c).cast("string").alias(c)
qsum = lambda c="o_totalprice": F.sum(F.rint(F.col(c) * 100).cast("bigint")) / F.lit(100.0)
QS = "cast(sum(cast(round({0}*100) as bigint)) as bigint)/100.0::double"

# --- filed facts: orders as filed records of a region ------------------------------------------------------
_KIND = {}
for _k, _t in (("flow", M.INCOME_CONCEPTS), ("shares", M.SHARE_CONCEPTS), ("per_share", M.EPS_CONCEPTS), ("cash_flow", M.CASH_FLOW_CONCEPTS), ("stock", M.BALANCE_CONCEPTS)):
    _KIND.update({c: _k for cs in _t.values() for c in cs})
for _spec in M.COMPOSITES.values():
    _KIND.update({c: "stock" for cs in [_spec["total"], *_spec["parts"]] for c in cs})
CONCEPTS = sorted(_KIND)
_of = lambda k: [c for c in CONCEPTS if _KIND[c] == k]
_in = lambda k: "(" + ", ".join(f"'{c}'" for c in _of(k)) + ")"
FILED_SQL = f"""fil0 AS (SELECT n_regionkey AS entity, [{', '.join(f"'{c}'" for c in CONCEPTS)}][o_orderkey % {len(CONCEPTS)} + 1] AS concept, o_orderkey, o_orderstatus s, o_orderpriority p, cast(o_orderdate as date) AS filed, o_totalprice AS val
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 filed AS (SELECT entity, concept, o_orderkey, case when concept in {_in('shares')} then 'shares' else case when day(filed) % 2 = 0 then 'USD' else 'CNY' end || case when concept in {_in('per_share')} then '/shares' else '' end end AS unit,
  case when concept in {_in('stock')} then null when s = 'O' then cast(date_trunc('quarter', filed) as date) else make_date(year(filed)::bigint, 1, 1) end AS start,
  case when concept not in {_in('stock')} and s = 'F' then make_date(year(filed)::bigint, 12, 31) else {B.QEND.format('filed')} end AS "end", val,
  case p when '1-URGENT' then '10-K' when '2-HIGH' then '20-F/A' when '3-MEDIUM' then '10-Q' when '4-NOT SPECIFIED' then '8-K' else '6-K' end AS form, filed, cast(year(filed) as integer) AS fy FROM fil0)"""


def filed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"),
                                         F.to_date("o_orderdate").alias("filed"), F.col("o_totalprice").alias("val"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("entity"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    concept = F.get(F.array(*[F.lit(c_) for c_ in CONCEPTS]), (F.col("o_orderkey") % len(CONCEPTS)).cast("int"))
    x = x.withColumn("concept", concept)
    stock = F.col("concept").isin(_of("stock"))
    unit = F.when(F.col("concept").isin(_of("shares")), "shares").otherwise(F.concat(
        F.when(F.dayofmonth("filed") % 2 == 0, "USD").otherwise("CNY"), F.when(F.col("concept").isin(_of("per_share")), "/shares").otherwise("")))
    p = F.col("p")
    return x.select(
        "entity", "concept", "o_orderkey", unit.alias("unit"),
        F.when(stock, None).when(F.col("s") == "O", F.to_date(F.trunc("filed", "quarter"))).otherwise(F.make_date(F.year("filed"), F.lit(1), F.lit(1))).alias("start"),
        F.when(~stock & (F.col("s") == "F"), F.make_date(F.year("filed"), F.lit(12), F.lit(31))).otherwise(S.quarter_end("filed")).alias("end"), "val",
        F.when(p == "1-URGENT", "10-K").when(p == "2-HIGH", "20-F/A").when(p == "3-MEDIUM", "10-Q").when(p == "4-NOT SPECIFIED", "8-K").otherwise("6-K").alias("form"),
        "filed", F.year("filed").alias("fy"))


ANN_F, QTR_F = "regexp_matches(form, '^(10-K|20-F|40-F)')", "regexp_matches(form, '^(10-Q|10-K|20-F|40-F|6-K)')"
SPAN = """("end" - start)"""
FYS = """(case when month("end") >= 6 then year("end") else year("end") - 1 end)"""


@query("flt03_08_record_predicates", f"""WITH {FILED_SQL} SELECT o_orderkey, coalesce({SPAN} between 350 and 380, false) AS annual, coalesce({SPAN} between 80 and 100, false) AS quarter, start is null AS instant,
  coalesce({SPAN} between 80 and 100 or {SPAN} between 170 and 190 or {SPAN} between 260 and 280 or {SPAN} between 350 and 380, false) AS ytd, {ANN_F} AS annual_form, {QTR_F} AS quarterly_form,
  length(unit) = 3 and unit not in ('shares', 'pure') and not contains(unit, '/') AS money FROM filed""")
def flt03(spark, d):
    return filed(spark, d).select("o_orderkey", X.is_annual().alias("annual"), X.is_quarter().alias("quarter"), X.is_instant().alias("instant"), X.is_ytd().alias("ytd"),
                                  X.form_in(X.ANNUAL_FORMS).alias("annual_form"), X.form_in(X.QUARTERLY_FORMS).alias("quarterly_form"), X.is_money_unit().alias("money"))


@query("flt08_money_units", f"""WITH {FILED_SQL}, m AS (SELECT DISTINCT entity, concept, unit FROM filed WHERE length(unit) = 3) SELECT * FROM m UNION ALL
  SELECT DISTINCT entity, concept, 'USD' FROM filed f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.entity = f.entity and m.concept = f.concept)""")
def flt08(spark, d):
    return X.money_units(filed(spark, d), ["entity", "concept"])


def _dim_sql():
    rows = [(m, c, i, k, 0, False) for k, t in (("flow", M.INCOME_CONCEPTS), ("shares", M.SHARE_CONCEPTS), ("per_share", M.EPS_CONCEPTS), ("cash_flow", M.CASH_FLOW_CONCEPTS), ("stock", M.BALANCE_CONCEPTS))
            for m, cs in t.items() for i, c in enumerate(cs)]
    for m, spec in M.COMPOSITES.items():
        rows += [(m, c, i, "stock", 0, True) for i, c in enumerate(spec["total"])]
        rows += [(m, c, i, "stock", g, True) for g, cs in enumerate(spec["parts"], 1) for i, c in enumerate(cs)]
    return "dim(metric, concept, rank, kind, grp, composite) AS (VALUES " + ", ".join(f"('{a}', '{b}', {i}, '{k}', {g}, {str(z).lower()})" for a, b, i, k, g, z in rows) + ")"


FM_SQL = f"""WITH {FILED_SQL}, {_dim_sql()}, fm AS (SELECT f.entity, f.concept, f.start, f."end", f.val, f.form, f.filed, f.fy, d.metric, d.rank, d.kind, d.grp, d.composite, replace(unit, '/shares', '') AS unit
  FROM filed f JOIN dim d USING (concept) WHERE case d.kind when 'shares' then unit = 'shares' when 'per_share' then suffix(unit, '/shares') else length(unit) = 3 end)"""


def filed_metrics(spark, d):
    dim = M.concept_dimension(spark)
    x = filed(spark, d).join(F.broadcast(dim), "concept")
    ok = (F.when(F.col("kind") == "shares", F.col("unit") == "shares").when(F.col("kind") == "per_share", F.col("unit").endswith("/shares")).otherwise(X.is_money_unit()))
    return x.where(ok).withColumn("unit", F.regexp_replace("unit", "/shares$", ""))


ORD = "ORDER BY rank ASC, filed DESC, val DESC"


@query("win05_annual_pick", f"""{FM_SQL} SELECT entity, metric, unit, cast({FYS} as bigint) AS fiscal, val, concept FROM fm WHERE not composite and {SPAN} between 350 and 380 and {ANN_F}
  QUALIFY row_number() over (partition by entity, metric, unit, {FYS} {ORD}) = 1""")
def win05(spark, d):
    return X.annual_values(filed_metrics(spark, d).where("not composite")).select("entity", "metric", "unit", "fiscal", "val", "concept")


@query("win06_quarterly_pick", f"""{FM_SQL} SELECT entity, metric, unit, cast("end" as varchar) AS "end", val, concept FROM fm WHERE not composite and {SPAN} between 80 and 100 and {QTR_F}
  QUALIFY row_number() over (partition by entity, metric, unit, "end" {ORD}) = 1""")
def win06(spark, d):
    return X.quarterly_values(filed_metrics(spark, d).where("not composite")).select("entity", "metric", "unit", iso("end"), "val", "concept")


@query("win07_instant_pick", f"""{FM_SQL} SELECT entity, metric, unit, cast("end" as varchar) AS "end", val, concept FROM fm WHERE not composite and start is null and {QTR_F}
  QUALIFY row_number() over (partition by entity, metric, unit, "end" {ORD}) = 1""")
def win07(spark, d):
    return X.instant_values(filed_metrics(spark, d).where("not composite")).select("entity", "metric", "unit", iso("end"), "val", "concept")


# year-to-date filings: several filings per nation, year and quarter
YTD_SQL = f"""yt AS (SELECT c_nationkey AS entity, 'revenue' AS metric, 'USD' AS unit, 0 AS rank, 'Revenues' AS concept, '10-Q' AS form, make_date(year(o_orderdate)::bigint, 1, 1) AS start, {B.QEND.format('o_orderdate')} AS "end",
   cast(o_orderdate as date) AS filed, max(round(o_totalprice, 0)) AS val FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def ytd_facts(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("entity"), F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("start"), S.quarter_end("o_orderdate").alias("end"),
                     F.to_date("o_orderdate").alias("filed")).agg(F.max(F.round("o_totalprice", 0)).alias("val")).select(
        "*", F.lit("revenue").alias("metric"), F.lit("USD").alias("unit"), F.lit(0).alias("rank"), F.lit("Revenues").alias("concept"), F.lit("10-Q").alias("form"))


@query("win08_ytd_chain", f"""WITH {YTD_SQL}, b AS (SELECT * FROM yt WHERE {SPAN} between 80 and 100 or {SPAN} between 170 and 190 or {SPAN} between 260 and 280 or {SPAN} between 350 and 380 QUALIFY row_number() over (partition by entity, start, "end" order by filed desc, val desc) = 1),
  w AS (SELECT *, first({SPAN}) over z AS f, val - coalesce(lag(val) over z, 0) AS q, lag("end") over z AS pe FROM b WINDOW z AS (PARTITION BY entity, start ORDER BY "end"))
  SELECT entity, cast("end" as varchar) AS "end", cast(coalesce(pe, start) as varchar) AS start, q AS val, {SPAN} > 100 AS from_ytd FROM w WHERE f between 80 and 100""")
def win08(spark, d):
    return X.quarters_from_ytd(ytd_facts(spark, d)).select("entity", iso("end"), iso("start"), "val", "from_ytd")


RUN_SQL = f"""{B.NATION_SQL}, cu AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, quarter(o_orderdate) AS q, cast(sum(cast(round(o_totalprice) as bigint)) as bigint) AS v FROM orders GROUP BY ALL),
  run AS (SELECT entity, cast(y as integer) AS y, cast(q as integer) AS q, cast(sum(v) over (partition by entity, y order by q rows unbounded preceding) as double) AS ytd, cast(v as double) AS v FROM cu)"""


def running_facts(spark, d):
    from pyspark.sql import Window as W
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")) \
        .agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("v"))
    w = W.partitionBy("entity", "y").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    return g.select("entity", "y", "q", F.sum("v").over(w).cast("double").alias("ytd"), F.col("v").cast("double").alias("v"))


@query("win09_ytd_adjacent", f"""WITH {RUN_SQL} SELECT a.entity, cast(a.y as bigint) AS y, cast(a.q as bigint) AS q, case when a.q = 1 then a.ytd else a.ytd - b.ytd end AS val FROM run a LEFT JOIN run b ON a.entity = b.entity and a.y = b.y and b.q = a.q - 1""")
def win09(spark, d):
    x = X.quarters_from_ytd_strict(running_facts(spark, d).select("entity", "y", "q", F.col("ytd").alias("val")), ["entity"], "y", "q", ["val"])
    return x.select("entity", F.col("y").cast("bigint").alias("y"), F.col("q").cast("bigint").alias("q"), "val")


@query("win10_merge_units", f"""{FM_SQL}, a AS (SELECT *, {FYS} AS fiscal FROM fm WHERE not composite and {SPAN} between 350 and 380 and {ANN_F} QUALIFY row_number() over (partition by entity, metric, unit, {FYS} {ORD}) = 1)
  SELECT entity, metric, cast(fiscal as bigint) AS fiscal, val, unit AS ccy FROM a QUALIFY row_number() over (partition by entity, metric, fiscal order by unit = 'USD', unit) = 1""")
def win10(spark, d):
    v = X.annual_values(filed_metrics(spark, d).where("not composite")).select("entity", "metric", "unit", "fiscal", "val")
    return X.merge_units(v, ["entity", "metric", "fiscal"])


def _kpi15_sql(grid):
    if grid == "annual":
        per, keep = FYS, f"{ANN_F} and case when kind = 'stock' then start is null else {SPAN} between 350 and 380 end"
        vals = f"""v0 AS (SELECT entity, metric, unit, {per} AS period, val, concept FROM fm WHERE not composite and {keep} QUALIFY row_number() over (partition by entity, metric, unit, {per} {ORD}) = 1)"""
    else:
        per = '"end"'
        vals = f"""cfb AS (SELECT * FROM fm WHERE kind = 'cash_flow' and not composite and {QTR_F} and ({SPAN} between 80 and 100 or {SPAN} between 170 and 190 or {SPAN} between 260 and 280 or {SPAN} between 350 and 380)
            QUALIFY row_number() over (partition by entity, metric, unit, start, "end" order by filed desc, rank, val desc) = 1),
          cfw AS (SELECT *, first({SPAN}) over z AS f, val - coalesce(lag(val) over z, 0) AS qv FROM cfb WINDOW z AS (PARTITION BY entity, metric, unit, start ORDER BY "end")),
          v0 AS (SELECT entity, metric, unit, "end" AS period, val, concept FROM fm WHERE not composite and kind <> 'cash_flow' and {QTR_F} and case when kind = 'stock' then start is null else {SPAN} between 80 and 100 end
             QUALIFY row_number() over (partition by entity, metric, unit, "end" {ORD}) = 1
           UNION ALL SELECT entity, metric, unit, "end", qv, concept FROM cfw WHERE f between 80 and 100 QUALIFY row_number() over (partition by entity, metric, unit, "end" order by start desc) = 1)"""
        keep = f"{QTR_F} and start is null"
    return f"""{FM_SQL}, {vals}, v1 AS (SELECT * FROM v0 QUALIFY row_number() over (partition by entity, metric, period order by unit = 'USD', unit) = 1),
  c0 AS (SELECT entity, metric, grp, concept, unit, {per} AS period, val, rank FROM fm WHERE composite and {keep} QUALIFY row_number() over (partition by entity, metric, grp, concept, unit, {per} {ORD}) = 1),
  c1 AS (SELECT * FROM c0 QUALIFY row_number() over (partition by entity, metric, grp, concept, period order by unit = 'USD', unit) = 1),
  c2 AS (SELECT * FROM c1 QUALIFY row_number() over (partition by entity, metric, grp, period order by val = 0, rank) = 1),
  c3 AS (SELECT entity, metric, period, coalesce(max(case when grp = 0 then val end), sum(val)) AS val, coalesce(max(case when grp = 0 then concept end), 'sum(' || string_agg(concept, '+' order by grp) || ')') AS concept FROM c2 GROUP BY 1, 2, 3),
  ccy AS (SELECT entity, metric, period, min(unit) AS ccy FROM c1 GROUP BY 1, 2, 3),
  al AS (SELECT entity, metric, period, val, concept, unit AS ccy, metric in ('intangibles', 'accounts_payable') AS partial FROM v1 UNION ALL
    SELECT c3.*, ccy.ccy, c3.metric <> 'restricted_cash' FROM c3 LEFT JOIN ccy USING (entity, metric, period)),
  rf AS (SELECT entity, period, max(case when metric = 'net_income' then val end) AS ni, max(case when metric = 'diluted_eps' then val end) AS eps FROM al GROUP BY 1, 2)
  SELECT al.entity, metric, cast(al.period as varchar) AS period, round(case when metric = 'diluted_shares' and val > 0 and abs(eps) >= 0.05 and abs(ni/nullif(eps,0))/val between 500 and 2000 then val * 1000 else val end, 4) AS val, concept, ccy, partial
  FROM al LEFT JOIN rf ON rf.entity = al.entity and rf.period = al.period"""


@query("kpi15_kpi16_annual_metrics", _kpi15_sql("annual"))
def kpi15a(spark, d):
    return X.filing_metrics(filed(spark, d), "annual").select("entity", "metric", iso("period"), F.round("val", 4).alias("val"), "concept", "ccy", "partial")


@query("kpi15_quarterly_metrics", _kpi15_sql("quarterly"))
def kpi15q(spark, d):
    return X.filing_metrics(filed(spark, d), "quarterly").select("entity", "metric", iso("period"), F.round("val", 4).alias("val"), "concept", "ccy", "partial")


@query("agg15_16_composites", f"""{FM_SQL}, c0 AS (SELECT entity, metric, grp, concept, rank, year("end") AS y, max(case when extract(month from filed) = 3 then 0.0::double else val end) AS val FROM fm WHERE composite GROUP BY ALL),
  c2 AS (SELECT * FROM c0 QUALIFY row_number() over (partition by entity, metric, grp, y order by val = 0, rank) = 1)
  SELECT entity, metric, cast(y as bigint) AS y, round(coalesce(max(case when grp = 0 then val end), sum(val)), 2) AS val, coalesce(max(case when grp = 0 then concept end), 'sum(' || string_agg(concept, '+' order by grp) || ')') AS concept FROM c2 GROUP BY 1, 2, 3""")
def agg15(spark, d):
    c = filed_metrics(spark, d).where("composite").groupBy("entity", "metric", "grp", "concept", "rank", F.year("end").cast("bigint").alias("y")) \
        .agg(F.max(F.when(F.month("filed") == 3, 0.0).otherwise(F.col("val"))).alias("val"))
    total = L.group_pick(c.where("grp = 0"), ["entity", "metric", "y"])
    parts = L.group_pick(c.where("grp > 0"), ["entity", "metric", "grp", "y"])
    return L.composite(parts, total, ["entity", "metric", "y"]).withColumn("val", F.round("val", 2))


@query("agg35_concept_search", f"""WITH {FILED_SQL} SELECT entity, concept, unit, count(*) AS records, arg_max(val, {{'e': "end", 'f': filed, 'v': val}}) AS latest FROM filed WHERE contains(lower(concept), 'debt') GROUP BY 1, 2, 3
  QUALIFY row_number() over (partition by entity order by records desc, concept, unit) <= 40""")
def agg35(spark, d):
    from tallygrid.operators.inventory import concept_search
    return concept_search(filed(spark, d), "debt")


@query("top09_concept_facts", f"""WITH {FILED_SQL} SELECT entity, unit, cast("end" as varchar) AS "end", val, row_number() over z AS rn FROM filed WHERE concept = 'Assets' WINDOW z AS (PARTITION BY entity, unit ORDER BY "end" DESC, filed DESC, val DESC) QUALIFY rn <= 5""")
def top09(spark, d):
    from tallygrid.operators.rank import concept_facts
    return concept_facts(filed(spark, d), "Assets", ["entity"], 5).select("entity", "unit", iso("end"), "val", "rn")


# --- merge ----------------------------------------------------------------------------------------------------

MERGE_SQL = f"""a AS (SELECT o_custkey AS entity, cast(date_trunc('month', o_orderdate) as date) AS period, {QS.format('o_totalprice')} AS val, bool_or(o_orderstatus = 'P') AS partial FROM orders GROUP BY 1, 2),
  b AS (SELECT o_custkey AS entity, cast(date_trunc('month', l_shipdate) as date) AS period, {QS.format('l_extendedprice')} AS val, case when max(l_linenumber) > 6 then '6k' end AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def merge_sides(spark, d):
    o = table(spark, d, "orders")
    a = o.groupBy(F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "month").alias("period")).agg(
        qsum().alias("val"), F.bool_or(F.col("o_orderstatus") == "P").alias("partial"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey", F.trunc("l_shipdate", "month").alias("period")).agg(
        F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint")).alias("c"), F.max("l_linenumber").alias("ln"))
    b = li.join(o.select("o_orderkey", F.col("o_custkey").alias("entity")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("entity", "period").agg(
        (F.sum("c") / F.lit(100.0)).alias("val"), F.when(F.max("ln") > 6, "6k").alias("source"))
    return a, b


@query("jn03_cell_merge", f"""WITH {MERGE_SQL} SELECT coalesce(a.entity, b.entity) AS entity, cast(coalesce(a.period, b.period) as varchar) AS period, case when a.entity is not null and not (a.partial and b.val is not null and b.val > a.val) then a.val else b.val end AS val,
  case when a.entity is not null and not coalesce(a.partial and b.val is not null and b.val > a.val, false) then 'sec' else coalesce(b.source, 'yfinance') end AS source FROM a FULL JOIN b ON a.entity = b.entity and a.period = b.period""")
def jn03(spark, d):
    a, b = merge_sides(spark, d)
    return L.merge_cells(a, b, ["entity", "period"]).select("entity", iso("period"), "val", "source")


@query("jn04_overlay", f"""WITH {MERGE_SQL}, bc AS (SELECT a.*, case c_nationkey % 3 when 0 then 'USD' when 1 then 'CNY' end AS row_ccy FROM a JOIN customer ON c_custkey = entity),
  oc AS (SELECT b.*, case c_nationkey % 2 when 0 then 'USD' else 'CNY' end AS row_ccy FROM b JOIN customer ON c_custkey = entity),
  cb AS (SELECT DISTINCT entity, coalesce(row_ccy, 'USD') AS ccy FROM bc), ok AS (SELECT oc.* FROM oc LEFT JOIN cb USING (entity) WHERE cb.ccy is null or cb.ccy = oc.row_ccy)
  SELECT coalesce(o.entity, b.entity) AS entity, cast(coalesce(o.period, b.period) as varchar) AS period, case when o.entity is not null then o.val else b.val end AS val, case when o.entity is not null then o.row_ccy else b.row_ccy end AS row_ccy
  FROM bc b FULL JOIN ok o ON b.entity = o.entity and b.period = o.period""")
def jn04(spark, d):
    a, b = merge_sides(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    n3, n2 = F.col("c_nationkey") % 3, F.col("c_nationkey") % 2
    base = a.join(c, "entity").select("entity", "period", "val", F.when(n3 == 0, "USD").when(n3 == 1, "CNY").alias("row_ccy"))
    over = b.join(c, "entity").select("entity", "period", "val", F.when(n2 == 0, "USD").otherwise("CNY").alias("row_ccy"))
    return L.overlay_cells(base, over, ["entity", "period"]).select("entity", iso("period"), "val", "row_ccy")


SRC_SQL = "case o_orderpriority when '1-URGENT' then 'sec' when '2-HIGH' then 'ashare' when '3-MEDIUM' then '6k' when '4-NOT SPECIFIED' then 'yfinance' else 'other' end"


def _source_tag():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "sec").when(p == "2-HIGH", "ashare").when(p == "3-MEDIUM", "6k").when(p == "4-NOT SPECIFIED", "yfinance").otherwise("other")


@query("jn05_precedence", f"""WITH x AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, {SRC_SQL} AS source, case when o_orderstatus <> 'P' then o_totalprice end AS val FROM orders)
  SELECT entity, cast(y as bigint) AS y, val, source FROM x WHERE val is not null QUALIFY row_number() over (partition by entity, y order by case source when 'sec' then 0 when 'ashare' then 1 when '6k' then 2 when 'yfinance' then 3 else 4 end, val desc) = 1""")
def jn05(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("bigint").alias("y"), _source_tag().alias("source"),
                                         F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("val"))
    return L.by_precedence(x, ["entity", "y"])


@query("jn06_nearest_period", """WITH p AS (SELECT DISTINCT o_custkey AS entity, cast(o_orderdate as date) AS pd FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT DISTINCT o_custkey AS entity, cast(o_orderdate as date) AS sd FROM orders WHERE o_orderstatus <> 'F'),
  n AS (SELECT s.entity, sd, pd, abs(pd - sd) AS d FROM s JOIN p ON p.entity = s.entity and abs(pd - sd) <= 25 QUALIFY row_number() over (partition by s.entity, sd order by abs(pd - sd), pd) = 1),
  c AS (SELECT * FROM n WHERE d > 0 QUALIFY row_number() over (partition by entity, pd order by d, sd) = 1)
  SELECT s.entity, cast(s.sd as varchar) AS period, cast(coalesce(c.pd, s.sd) as varchar) AS aligned FROM s LEFT JOIN c ON c.entity = s.entity and c.sd = s.sd""")
def jn06(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("period"), "o_orderstatus")
    return L.align_periods(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")).select("entity", iso("period"), iso("aligned"))


@query("jn13_fill_only", f"""WITH a AS (SELECT o_custkey AS entity, {B.QEND.format('o_orderdate')} AS period, {QS.format('o_totalprice')} AS val FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT o_custkey AS entity, {B.QEND.format('o_orderdate')} AS period, {QS.format('o_totalprice')} AS val FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
  SELECT coalesce(a.entity, b.entity) AS entity, cast(coalesce(a.period, b.period) as varchar) AS period, coalesce(a.val, b.val) AS val FROM a FULL JOIN b ON a.entity = b.entity and a.period = b.period""")
def jn13(spark, d):
    from tallygrid.operators.keyed import fill_missing
    o = table(spark, d, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("entity"), S.quarter_end("o_orderdate").alias("period")).agg(qsum().alias("val"))
    return fill_missing(side("F"), side("O"), ["entity", "period"], ["val"]).select("entity", iso("period"), "val")


@query("jn14_key_difference", f"""WITH x AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, o_orderstatus AS m, {QS.format('o_totalprice')} AS val FROM orders GROUP BY 1, 2, 3)
  SELECT a.entity, cast(a.y as bigint) AS y, 'gross_profit' AS metric, round(a.val - b.val, 2) AS val FROM x a JOIN x b ON a.entity = b.entity and a.y = b.y WHERE a.m = 'F' and b.m = 'P'""")
def jn14(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderstatus").alias("metric")).agg(qsum().alias("val"))
    return L.key_difference(x, ["entity", "y"], "F", "P", "gross_profit").withColumn("val", F.round("val", 2))


@query("agg12_dedupe_cells", """WITH x AS (SELECT o_custkey AS entity, strftime(o_orderdate, '%Y-%m') AS m, case when o_orderstatus <> 'P' then o_totalprice end AS a, case when o_orderstatus <> 'F' then o_orderpriority end AS b, {'d': cast(cast(o_orderdate as date) as varchar), 's': o_orderstatus, 'k': cast(o_orderkey as varchar)} AS k FROM orders)
  SELECT entity, m, arg_max(a, k) FILTER (WHERE a is not null) AS a, arg_max(b, k) FILTER (WHERE b is not null) AS b FROM x GROUP BY 1, 2""")
def agg12(spark, d):
    x = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("a"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("b"), F.to_date("o_orderdate").alias("dt"), F.col("o_orderstatus").alias("st"), F.col("o_orderkey").alias("k"))
    return L.dedupe_cells(x, ["entity", "m"], ["dt", "st", "k"], ["a", "b"])


LABELS_SQL = """lines AS (SELECT l_orderkey AS entity, l_linenumber AS pos, case when l_linenumber = 4 and l_returnflag = 'A' then 'TOTAL CURRENT ASSETS:' when l_linenumber = 7 and l_returnflag <> 'N' then 'Total liabilities' when l_linenumber = 6 and l_returnflag = 'R' then 'Shareholders'' equity'
   when l_returnflag = 'A' and l_linestatus = 'F' then 'Cash and cash equivalents' when l_returnflag = 'A' then 'Restricted cash' when l_returnflag = 'N' and l_linestatus = 'F' then 'Short-term investments' when l_returnflag = 'N' then 'Accounts receivable, net'
   when l_linenumber % 2 = 0 then 'Property and equipment, net' when l_linestatus = 'O' then 'Equity investments' else 'Land use rights' end AS label, cast(round(l_extendedprice) as bigint)::double AS value FROM lineitem)"""


def balance_lines(spark, d):
    rf, ls, n = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    label = (F.when((n == 4) & (rf == "A"), "TOTAL CURRENT ASSETS:").when((n == 7) & (rf != "N"), "Total liabilities").when((n == 6) & (rf == "R"), "Shareholders' equity")
             .when((rf == "A") & (ls == "F"), "Cash and cash equivalents").when(rf == "A", "Restricted cash").when((rf == "N") & (ls == "F"), "Short-term investments").when(rf == "N", "Accounts receivable, net")
             .when(n % 2 == 0, "Property and equipment, net").when(ls == "O", "Equity investments").otherwise("Land use rights"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), n.alias("pos"), label.alias("label"), F.round("l_extendedprice").cast("bigint").cast("double").alias("value"))


ASSET_SQL = f"""{LABELS_SQL}, l AS (SELECT *, regexp_replace(lower(label), '[^a-z ]+', ' ', 'g') AS s FROM lines),
  bd AS (SELECT entity, min(case when contains(s, 'total current assets') then pos end) AS cur, min(case when not contains(s, 'total current assets') and (contains(s, 'total assets') or contains(s, 'liabilit') or (contains(s, 'equity') and not contains(s, 'invest'))) then pos end) AS stop FROM l GROUP BY 1),
  k AS (SELECT l.entity, value, case when not coalesce(pos > cur, false) and contains(s, 'cash and cash equivalents') and not contains(s, 'restricted') then 'cash' when contains(s, 'restricted cash') then 'restricted_cash'
    when not coalesce(pos > cur, false) and contains(s, 'short') and contains(s, 'invest') then 'short_term_investments' when not coalesce(pos > cur, false) and contains(s, 'receivable') then 'receivables'
    when coalesce(pos > cur, false) and contains(s, 'land use right') then 'intangibles' when contains(s, 'property') and contains(s, 'equipment') then 'ppe_net' when coalesce(pos > cur, false) and contains(s, 'invest') and not contains(s, 'short') then 'long_term_investments' end AS metric
   FROM l JOIN bd USING (entity) WHERE pos < coalesce(stop, 99) and not contains(s, 'total current assets') and not starts_with(s, 'total')),
  al AS (SELECT entity, metric, sum(value) AS val FROM k WHERE metric is not null GROUP BY 1, 2)"""


@query("agg18_asset_lines", f"WITH {ASSET_SQL} SELECT * FROM al")
def agg18(spark, d):
    return L.asset_lines(balance_lines(spark, d), ["entity"])


ADS_SQL = f"""{B.LINES_SQL}, {B.statements_sql('year')}, sp AS (SELECT entity, year(period) AS fy, shares * (c_nationkey % 7) + case when c_nationkey % 3 = 0 then shares * 0.1 else 0 end AS a, shares AS b FROM st JOIN customer ON c_custkey = entity),
  ar AS (SELECT entity, list(a/b order by a/b) AS r FROM sp WHERE a > 0 and b > 0 GROUP BY 1), cand AS (SELECT unnest(list_concat(list_transform(range(2, 101), lambda k: k::double), list_transform(range(2, 21), lambda k: 1.0::double/k))) AS c),
  ads AS (SELECT entity, c AS t FROM (SELECT entity, r, c, r[len(r)//2 + 1] AS med FROM ar, cand QUALIFY row_number() over (partition by entity order by abs(r[len(r)//2+1] - c)/c, case when c >= 2 then c else 100 + 1/c end) = 1) WHERE abs(med - c)/c <= 0.15 and len(list_filter(r, lambda v: abs(v - c)/c > 0.25)) = 0)"""


def ads_sides(spark, d):
    st = B.statements(spark, d, "year").select("entity", F.year("period").alias("fy"), "shares")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    k = F.col("c_nationkey")
    p = st.join(c, "entity").select("entity", "fy", (F.col("shares") * (k % 7) + F.when(k % 3 == 0, F.col("shares") * 0.1).otherwise(0)).alias("shares"))
    return p, st


@query("agg19_ads_ratio", f"WITH {ADS_SQL} SELECT entity, t AS ads_ratio FROM ads")
def agg19(spark, d):
    return H.ads_ratio(*ads_sides(spark, d))


@query("agg20_ads_normalise", f"""WITH {ADS_SQL}, f AS (SELECT entity, fy, 'diluted_shares' AS metric, a AS val FROM sp UNION ALL SELECT entity, fy, 'diluted_eps', b FROM sp UNION ALL SELECT entity, fy, 'revenue', b FROM sp)
  SELECT entity, cast(fy as bigint) AS fy, metric, round(case when t is null then val when metric = 'diluted_shares' then val / t when metric = 'diluted_eps' then val * t else val end, 6) AS val FROM f LEFT JOIN ads USING (entity)""")
def agg20(spark, d):
    p, s = ads_sides(spark, d)
    f = p.select("entity", "fy", F.lit("diluted_shares").alias("metric"), F.col("shares").alias("val")) \
        .unionByName(s.select("entity", "fy", F.lit("diluted_eps").alias("metric"), F.col("shares").alias("val"))) \
        .unionByName(s.select("entity", "fy", F.lit("revenue").alias("metric"), F.col("shares").alias("val")))
    return H.ads_normalise(f, H.ads_ratio(p, s)).select("entity", F.col("fy").cast("bigint").alias("fy"), "metric", F.round("val", 6).alias("val"))


SRC_TAGS = {"revenue": "sec", "cogs": "yfinance", "gross_profit": "sec", "ocf": "6k", "capex": "sec", "cash": "ashare", "sti": "6k", "lt_debt": "sec", "st_debt": "yfinance", "debt_legacy": "6k", "assets": "ashare"}
DERIVE_SQL = f"""WITH {B.LINES_SQL}, {B.statements_sql()}, t AS (SELECT entity, period, case when quarter(period) = 2 then null else revenue end AS revenue, cogs, gross_profit, op_income, net_income, ocf, capex, cash, sti, case when quarter(period) = 3 then sga end AS rc, lt_debt, st_debt, debt_legacy, assets, rd AS ct FROM st),
  u AS (SELECT *, case when revenue is null and op_income is not null and net_income is not null then 0.0::double else revenue end AS rev, case when revenue is null and op_income is not null and net_income is not null then 'derived' when revenue is not null then 'sec' end AS rsrc FROM t),
  v AS (SELECT *, case when gross_profit is null and rev is not null and cogs is not null then rev - cogs else gross_profit end AS gp, case when gross_profit is null and rev is not null and cogs is not null then 'yfinance' when gross_profit is not null then 'sec' end AS gsrc,
    case when capex > 0 then -capex when capex is null and ocf is not null then 0.0::double else capex end AS cx, case when capex is null and ocf is not null then 'derived' when capex is not null then 'sec' end AS csrc FROM u)
  SELECT entity, cast(period as varchar) AS period, rev AS revenue, rsrc AS revenue_src, gp AS gross_profit, gsrc AS gross_profit_src, cx AS capex, csrc AS capex_src, ocf - abs(cx) AS fcf, case when ocf is not null and cx is not null then case when csrc = 'sec' then 'sec' else '6k' end end AS fcf_src,
   case when cash is not null then cash + coalesce(sti, 0) + coalesce(rc, 0) else ct end AS cash_all, case when cash is not null then case when sti is not null then '6k' else 'ashare' end else 'yfinance' end AS cash_all_src,
   case when lt_debt is not null or st_debt is not null then coalesce(lt_debt, 0) + coalesce(st_debt, 0) when debt_legacy is not null then debt_legacy when assets is not null then 0.0::double end AS total_debt,
   case when lt_debt is not null or st_debt is not null then case when st_debt is not null then 'yfinance' else 'sec' end when debt_legacy is not null then '6k' when assets is not null then 'ashare' end AS total_debt_src FROM v"""


@query("agg21_22_derived_cells", DERIVE_SQL)
def agg22(spark, d):
    q = F.quarter("period")
    st = B.statements(spark, d)
    x = st.select("entity", "period", F.when(q == 2, None).otherwise(F.col("revenue")).alias("revenue"), "cogs", "gross_profit", "op_income", "net_income", "ocf", "capex", "cash", "sti",
                  F.when(q == 3, F.col("sga")).alias("restricted_cash"), "lt_debt", "st_debt", "debt_legacy", "assets", F.col("rd").alias("cash_total"))
    for m, tag in {**SRC_TAGS, "restricted_cash": "ashare"}.items():
        x = x.withColumn(f"{m}_src", F.when(F.col(m).isNotNull(), tag))
    x = L.derive_period(x.withColumn("cash_total_src", F.lit("yfinance")))
    return x.select("entity", iso("period"), *[c for m in ("revenue", "gross_profit", "capex", "fcf", "cash_all", "total_debt") for c in (m, f"{m}_src")])


@query("kpi05_statement_maps", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, f AS (UNPIVOT (SELECT entity, period, revenue, cogs, op_income, cash, assets FROM st) ON revenue, cogs, op_income, cash, assets INTO NAME metric VALUE val)
  SELECT entity, cast(period as varchar) AS period, case when metric in ('cash', 'assets') then 'balance_sheet' else 'income_statement' end AS stmt, count(*) AS items, round(sum(val), 4) AS total, max(case when metric in ('revenue', 'cash') then val end) AS lead FROM f GROUP BY 1, 2, 3""")
def kpi05(spark, d):
    st = B.statements(spark, d).unpivot(["entity", "period"], ["revenue", "cogs", "op_income", "cash", "assets"], "metric", "val").where("val is not null")
    f = st.withColumn("stmt", F.when(F.col("metric").isin("cash", "assets"), "balance_sheet").otherwise("income_statement")).withColumn("source", F.lit("sec"))
    m = L.statement_maps(f, ["entity", "period", "stmt"])
    get = lambda k: F.try_element_at("items", F.lit(k))
    return m.select("entity", iso("period"), "stmt", F.size("items").cast("bigint").alias("items"),
                    F.round(F.aggregate(F.map_values("items"), F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.coalesce(get("revenue"), get("cash")).alias("lead"))


@query("agg37_opex_layout", f"""WITH {B.LINES_SQL}, {B.statements_sql()} SELECT entity, count(sm) >= 2 and count(ga) >= 2 AS split_opex FROM st GROUP BY 1""")
def agg37(spark, d):
    return L.opex_layout(B.statements(spark, d))


@query("kpi11_ytd_fill", f"""WITH {RUN_SQL}, sg AS (SELECT entity, y, q, v FROM run WHERE q in (1, 3)), df AS (SELECT a.entity, a.y, a.q, case when a.q = 1 then a.ytd else a.ytd - b.ytd end AS v FROM run a LEFT JOIN run b ON a.entity = b.entity and a.y = b.y and b.q = a.q - 1)
  SELECT entity, cast(y as bigint) AS y, cast(q as bigint) AS q, v AS val FROM sg UNION ALL SELECT entity, y, q, v FROM df WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.entity = df.entity and sg.y = df.y and sg.q = df.q)""")
def kpi11(spark, d):
    r = running_facts(spark, d)
    single = r.where("q in (1, 3)").select("entity", "y", "q", F.col("v").alias("val"))
    x = X.statement_quarters(single, r.select("entity", "y", "q", F.col("ytd").alias("val")), ["entity"], "y", "q", ["val"])
    return x.select("entity", F.col("y").cast("bigint").alias("y"), F.col("q").cast("bigint").alias("q"), "val")


@query("kpi12_second_source", f"""WITH {RUN_SQL} SELECT a.entity, a.y || '-' || case a.q when 1 then '03-31' when 2 then '06-30' when 3 then '09-30' else '12-31' end AS period, case when a.q = 1 then a.ytd else a.ytd - b.ytd end AS val, 'eastmoney' AS source
  FROM run a LEFT JOIN run b ON a.entity = b.entity and a.y = b.y and b.q = a.q - 1 WHERE a.q = 1 or b.ytd is not null""")
def kpi12(spark, d):
    x = X.quarters_from_ytd_strict(running_facts(spark, d).select("entity", "y", "q", F.col("ytd").alias("val")), ["entity"], "y", "q", ["val"])
    end = F.last_day(F.make_date(F.col("y"), F.col("q") * 3, F.lit(1)))
    return x.where("val is not null").select("entity", end.cast("string").alias("period"), "val", F.lit("eastmoney").alias("source"))


_FRAME = {"Total Revenue": "case when l_returnflag = 'A' then px end", "Operating Revenue": "case when l_returnflag <> 'R' then px end", "Net Income": "case when l_linestatus = 'F' then px end",
          "Capital Expenditure": "case when l_linestatus = 'O' then px end", "Purchase Of PPE": "px"}
FRAME_SQL = "fr AS (SELECT l_orderkey AS entity, " + ", ".join(f"cast(sum({v}) as double) AS \"{k}\"" for k, v in _FRAME.items()) + " FROM (SELECT *, cast(round(l_extendedprice) as bigint) AS px FROM lineitem) GROUP BY 1)"


def frame(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.round("l_extendedprice").cast("bigint").alias("px"))
    return li.groupBy(F.col("l_orderkey").alias("entity")).agg(*[F.sum(F.expr(v)).cast("double").alias(k) for k, v in _FRAME.items()])


@query("src10_melt_frame", f"""WITH {FRAME_SQL} SELECT entity, label, val FROM (UNPIVOT fr ON {', '.join(f'"{k}"' for k in _FRAME)} INTO NAME label VALUE val)""")
def src10(spark, d):
    return P.melt(frame(spark, d), ["entity"], list(_FRAME), "label", "val")


@query("src10_rm13_pivot_back", f"WITH {FRAME_SQL} SELECT entity, \"Total Revenue\" AS rev, \"Net Income\" AS ni FROM fr WHERE coalesce(\"Total Revenue\", \"Net Income\") is not null")
def src10b(spark, d):
    long = P.melt(frame(spark, d), ["entity"], ["Total Revenue", "Net Income"], "label", "val")
    x = P.pivot_back(long, ["entity"], "label", ["Total Revenue", "Net Income"])
    return x.select("entity", F.col("Total Revenue").alias("rev"), F.col("Net Income").alias("ni"))


@query("flt22_23_kpi13_label_priority", f"""WITH {FRAME_SQL}, m AS (UNPIVOT fr ON {', '.join(f'"{k}"' for k in _FRAME)} INTO NAME label VALUE val), dim(metric, label, rank, sign) AS (VALUES ('revenue', 'Total Revenue', 0, 1.0::double), ('revenue', 'Operating Revenue', 1, 1.0::double), ('net_income', 'Net Income', 0, 1.0::double), ('capex', 'Capital Expenditure', 0, -1.0::double), ('capex', 'Purchase Of PPE', 1, -1.0::double))
  SELECT entity, metric, val * sign AS val, label AS concept FROM m JOIN dim USING (label) QUALIFY row_number() over (partition by entity, metric order by rank) = 1""")
def flt22(spark, d):
    long = P.melt(frame(spark, d), ["entity"], list(_FRAME), "label", "val")
    return X.label_values(long, M.label_dimension(spark, M.FRAME_LABELS), ["entity"])


@query("kpi14_release_metrics", """WITH x AS (SELECT o_custkey AS entity, case when o_orderstatus = 'P' then 'year' else 'quarter' end AS pt, case when o_orderpriority <> '5-LOW' then cast(cast(o_orderdate as date) as varchar) end AS pe, case when o_orderstatus = 'F' then 'quarter' else 'six months' end AS cf, o_orderkey, o_totalprice AS v,
  ['revenue', 'operating_cf', 'diluted_ads', 'order_backlog'][o_orderkey % 4 + 1] AS m FROM orders) SELECT o_orderkey, entity, pe AS period_end, case when m = 'diluted_ads' then 'diluted_shares' else m end AS metric, v AS val, '6k' AS source FROM x WHERE pt = 'quarter' and m <> 'order_backlog' and pe is not null and (m <> 'operating_cf' or cf = 'quarter')""")
def kpi14(spark, d):
    s = F.col("o_orderstatus")
    x = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity"), F.when(s == "P", "year").otherwise("quarter").alias("period_type"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.to_date("o_orderdate").cast("string")).alias("period_end"), F.when(s == "F", "quarter").otherwise("six months").alias("cash_flow_period_type"),
        F.get(F.array(F.lit("revenue"), F.lit("operating_cf"), F.lit("diluted_ads"), F.lit("order_backlog")), (F.col("o_orderkey") % 4).cast("int")).alias("metric"), F.col("o_totalprice").alias("val"))
    return X.release_metrics(x).select("o_orderkey", "entity", "period_end", "metric", "val", "source")


# --- whole jobs ----------------------------------------------------------------------------------------------

LONG_SQL = f"""{B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')}, p1 AS (UNPIVOT (SELECT entity, period, revenue, cogs, cash, ocf FROM st) ON revenue, cogs, cash, ocf INTO NAME metric VALUE val),
  s1 AS (SELECT o_custkey AS entity, case o_orderpriority when '1-URGENT' then 'revenue' when '2-HIGH' then 'cogs' when '3-MEDIUM' then 'cash' else 'sti' end AS metric, cast(o_orderdate as date) AS period, max(o_totalprice) AS val, max(case when o_orderstatus = 'F' then '6k' else 'yfinance' end) AS source FROM orders GROUP BY 1, 2, 3)"""


@query("kpi05_jn06_blended_quarters", f"""WITH {LONG_SQL}, pd AS (SELECT DISTINCT entity, period FROM p1), sd AS (SELECT DISTINCT entity, period FROM s1),
  n AS (SELECT s.entity, s.period AS sp, p.period AS pp, abs(p.period - s.period) AS dd FROM sd s JOIN pd p ON p.entity = s.entity and abs(p.period - s.period) <= 25 QUALIFY row_number() over (partition by s.entity, s.period order by abs(p.period - s.period), p.period) = 1),
  c AS (SELECT * FROM n WHERE dd > 0 QUALIFY row_number() over (partition by entity, pp order by dd, sp) = 1),
  al AS (SELECT s1.entity, metric, coalesce(pp, s1.period) AS ap, s1.period, val, source FROM s1 LEFT JOIN c ON c.entity = s1.entity and sp = s1.period), s2 AS (SELECT * FROM al QUALIFY row_number() over (partition by entity, metric, ap order by ap <> period, period) = 1)
  SELECT coalesce(p.entity, s.entity) AS entity, coalesce(p.metric, s.metric) AS metric, cast(coalesce(p.period, s.ap) as varchar) AS period, case when p.entity is not null and not (p.metric = 'cash' and coalesce(s.val > p.val, false)) then p.val else s.val end AS val,
   case when p.entity is not null and not (p.metric = 'cash' and coalesce(s.val > p.val, false)) then 'sec' else s.source end AS source FROM p1 p FULL JOIN s2 s ON p.entity = s.entity and p.metric = s.metric and p.period = s.ap""")
def kpi05b(spark, d):
    from tallygrid.plans.company import blended_quarters
    p = P.melt(B.statements(spark, d).select("entity", "period", "revenue", "cogs", "cash", "ocf"), ["entity", "period"], ["revenue", "cogs", "cash", "ocf"], "metric", "val") \
        .withColumn("partial", F.col("metric") == "cash")
    pr = F.col("o_orderpriority")
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.when(pr == "1-URGENT", "revenue").when(pr == "2-HIGH", "cogs").when(pr == "3-MEDIUM", "cash").otherwise("sti").alias("metric"),
                                          F.to_date("o_orderdate").alias("period")).agg(F.max("o_totalprice").alias("val"), F.max(F.when(F.col("o_orderstatus") == "F", "6k").otherwise("yfinance")).alias("source"))
    return blended_quarters(p, s).select("entity", "metric", iso("period"), "val", "source")


ASH_SQL = """ar AS (SELECT o_custkey AS entity, case o_orderpriority when '4-NOT SPECIFIED' then 'balance' when '5-LOW' then 'cashflow' when '3-MEDIUM' then 'income_q' else 'income' end AS stmt, last_day(make_date(year(o_orderdate)::bigint, (quarter(o_orderdate)*3)::bigint, 1)) AS e,
   o_orderkey AS ann, case o_orderpriority when '4-NOT SPECIFIED' then ['money_cap', 'total_assets'][o_orderkey % 2 + 1] when '5-LOW' then ['n_cashflow_act', 'c_pay_acq_const_fiolta'][o_orderkey % 2 + 1] else ['total_revenue', 'revenue', 'oper_cost'][o_orderkey % 3 + 1] end AS field, cast(round(o_totalprice) as double) AS val FROM orders),
  ac AS (SELECT entity, stmt, e, field, arg_max(val, ann) AS val FROM ar GROUP BY 1, 2, 3, 4), d(kind, metric, field, rank, sign) AS (VALUES ('income', 'revenue', 'total_revenue', 0, 1.0::double), ('income', 'revenue', 'revenue', 1, 1.0::double), ('income', 'cost_of_revenue', 'oper_cost', 0, 1.0::double),
   ('balance', 'cash', 'money_cap', 0, 1.0::double), ('balance', 'total_assets', 'total_assets', 0, 1.0::double), ('cashflow', 'operating_cf', 'n_cashflow_act', 0, 1.0::double), ('cashflow', 'capex', 'c_pay_acq_const_fiolta', 0, -1.0::double)),
  x AS (SELECT entity, d.kind, stmt, e, metric, arg_min(val * sign, rank) AS val FROM ac JOIN d ON d.field = ac.field and d.kind = replace(stmt, '_q', '') GROUP BY 1, 2, 3, 4, 5),
  an AS (SELECT entity, 'annual' AS grid, metric, cast(year(e) as varchar) AS period, val FROM x WHERE not ends_with(stmt, '_q') and month(e) = 12),
  fl AS (SELECT a.entity, a.kind, a.metric, a.e, case when quarter(a.e) = 1 then a.val else a.val - b.val end AS val FROM x a LEFT JOIN x b ON b.entity = a.entity and b.metric = a.metric and b.stmt = a.stmt and year(b.e) = year(a.e) and quarter(b.e) = quarter(a.e) - 1 WHERE a.stmt in ('income', 'cashflow')),
  sg AS (SELECT entity, kind, metric, e, val FROM x WHERE stmt = 'income_q'),
  qu AS (SELECT entity, 'quarterly' AS grid, metric, cast(e as varchar) AS period, val FROM sg UNION ALL SELECT entity, 'quarterly', metric, cast(e as varchar), val FROM fl WHERE val is not null and NOT EXISTS (SELECT 1 FROM sg WHERE sg.entity = fl.entity and sg.metric = fl.metric and sg.e = fl.e)
    UNION ALL SELECT entity, 'quarterly', metric, cast(e as varchar), val FROM x WHERE kind = 'balance'),
  fa AS (SELECT * FROM an UNION ALL SELECT * FROM qu)"""


@query("kpi11_source_facts", f"""WITH {ASH_SQL} SELECT *, 'ashare' AS source FROM fa UNION ALL SELECT a.entity, a.grid, 'gross_profit', a.period, a.val - b.val, 'ashare' FROM fa a JOIN fa b ON a.entity = b.entity and a.grid = b.grid and a.period = b.period WHERE a.metric = 'revenue' and b.metric = 'cost_of_revenue'""")
def kpi11b(spark, d):
    from tallygrid.plans.company import source_facts
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int"))
    raw = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.when(p == "4-NOT SPECIFIED", "balance").when(p == "5-LOW", "cashflow").when(p == "3-MEDIUM", "income_q").otherwise("income").alias("stmt"), S.quarter_end("o_orderdate").alias("end"), k.alias("ann"),
        F.when(p == "4-NOT SPECIFIED", pick("money_cap", "total_assets")).when(p == "5-LOW", pick("n_cashflow_act", "c_pay_acq_const_fiolta")).otherwise(pick("total_revenue", "revenue", "oper_cost")).alias("field"), F.round("o_totalprice").alias("val"))
    return source_facts(raw, M.ASHARE_FIELDS, "ashare")


def _second_sql() -> str:
    """The same binding for the second source: its fields, and the first row of a report date counts."""
    dim = ", ".join(f"('{stmt}', '{m}', '{f}', {r}, {-1.0 if m in M.NEGATED else 1.0}::double)" for stmt, tab in M.SECOND_FIELDS.items() for m, fs in tab.items() for r, f in enumerate(fs))
    head, rest = ASH_SQL.split("d(kind, metric, field, rank, sign) AS (VALUES ", 1)
    rest = rest[rest.index("),\n  x AS"):]
    for a, b in (("'money_cap', 'total_assets'", "'MONETARYFUNDS', 'TOTAL_ASSETS'"), ("'n_cashflow_act', 'c_pay_acq_const_fiolta'", "'NETCASH_OPERATE', 'CONSTRUCT_LONG_ASSET'"),
                 ("'total_revenue', 'revenue', 'oper_cost'", "'TOTAL_OPERATE_INCOME', 'BASIC_EPS', 'OPERATE_COST'"), ("arg_max(val, ann)", "arg_min(val, ann)")):
        head = head.replace(a, b)
    return f"{head}d(kind, metric, field, rank, sign) AS (VALUES {dim}{rest}"


@query("kpi12_second_source_facts", f"""WITH {_second_sql()} SELECT *, 'eastmoney' AS source FROM fa UNION ALL SELECT a.entity, a.grid, 'gross_profit', a.period, a.val - b.val, 'eastmoney' FROM fa a JOIN fa b ON a.entity = b.entity and a.grid = b.grid and a.period = b.period WHERE a.metric = 'revenue' and b.metric = 'cost_of_revenue'""")
def kpi12b(spark, d):
    from tallygrid.plans.company import source_facts
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int"))
    raw = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.when(p == "4-NOT SPECIFIED", "balance").when(p == "5-LOW", "cashflow").when(p == "3-MEDIUM", "income_q").otherwise("income").alias("stmt"), S.quarter_end("o_orderdate").alias("end"), k.alias("ann"),
        F.when(p == "4-NOT SPECIFIED", pick("MONETARYFUNDS", "TOTAL_ASSETS")).when(p == "5-LOW", pick("NETCASH_OPERATE", "CONSTRUCT_LONG_ASSET")).otherwise(pick("TOTAL_OPERATE_INCOME", "BASIC_EPS", "OPERATE_COST")).alias("field"), F.round("o_totalprice").alias("val"))
    return source_facts(raw, M.SECOND_FIELDS, "eastmoney", by_restatement=False)


@query("kpi14_agg18_release_facts", f"""WITH {ASSET_SQL}, sd AS (SELECT o_orderkey AS entity, 'cash' AS metric, o_totalprice AS val FROM orders WHERE o_orderstatus = 'F')
  SELECT * FROM sd UNION ALL SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.entity = al.entity and sd.metric = al.metric)""")
def kpi14b(spark, d):
    from tallygrid.plans.company import release_facts
    sd = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entity"), F.lit("cash").alias("metric"), F.col("o_totalprice").alias("val"))
    return release_facts(sd, balance_lines(spark, d), ["entity"])


# --- currency ------------------------------------------------------------------------------------------------

FXV = [("CNY", 7.1, "2001-08-01"), ("EUR", 0.9, "2001-08-01"), ("JPY", 150.0, "2001-08-01")]
FX_SQL = "fx(ccy, per_usd) AS (VALUES ('CNY', 7.1::double), ('EUR', 0.9::double), ('JPY', 150.0::double))"
RATE = "case when coalesce({0}, 'USD') = 'USD' then 1.0::double else coalesce(per_usd, 1.0::double) end"


def rates(spark):
    return spark.createDataFrame(FXV, "ccy string, per_usd double, as_of string")


CCY_SQL = "case {0} % 5 when 0 then 'USD' when 1 then 'cny' when 2 then 'EUR' when 3 then 'GBP' end"


def _ccy(col, n=5):
    k = F.col(col) % n
    return F.when(k == 0, "USD").when(k == 1, "cny").when(k == 2, "EUR").when(k == 3, "GBP")


@query("jn22_23_cells_to_usd", f"""WITH {FX_SQL}, x AS (SELECT o_orderkey, case when o_orderstatus = 'F' then 'JPY' end AS cell, {CCY_SQL.format('o_custkey')} AS src, case when o_orderpriority = '1-URGENT' then 'diluted_shares' else 'revenue' end AS metric, o_totalprice AS val FROM orders)
  SELECT o_orderkey, metric, case when metric = 'diluted_shares' then val else val / {RATE.format('upper(coalesce(cell, src))')} end AS val FROM x LEFT JOIN fx ON fx.ccy = upper(coalesce(cell, src))""")
def jn22(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "JPY").alias("ccy"), _ccy("o_custkey").alias("source_ccy"),
                                         F.when(F.col("o_orderpriority") == "1-URGENT", "diluted_shares").otherwise("revenue").alias("metric"), F.col("o_totalprice").alias("val"))
    return FX.cells_to_usd(x, rates(spark)).select("o_orderkey", "metric", "val")


@query("jn24_rm05_prices_to_usd", f"""WITH {B.LINES_SQL}, {B.PRICES_SQL}, {FX_SQL}, q AS (SELECT px.*, {CCY_SQL.format('entity')} AS c FROM px) SELECT entity, cast(month as varchar) AS month, close / {RATE.format('upper(c)')} AS close FROM q LEFT JOIN fx ON fx.ccy = upper(c)""")
def jn24(spark, d):
    p = B.prices(spark, d).withColumn("quote_ccy", _ccy("entity"))
    return FX.prices_to_usd(p, rates(spark)).select("entity", iso("month"), "close")


@query("jn25_series_to_usd", f"""WITH {FX_SQL}, e AS (SELECT event_id, value, case when event_type in ('view', 'click') then 'count' else 'money' end AS unit, {CCY_SQL.format('user_id')} AS c FROM events) SELECT event_id, case when unit = 'money' then value / {RATE.format('upper(c)')} else value end AS value FROM e LEFT JOIN fx ON fx.ccy = upper(c)""")
def jn25(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_type").isin("view", "click"), "count").otherwise("money").alias("unit"), _ccy("user_id").alias("ccy"))
    return FX.series_to_usd(e, rates(spark)).select("event_id", "value")


@query("kpi02_served_facts", f"""WITH {FX_SQL}, x AS (SELECT o_custkey AS entity, case when o_orderkey % 4 = 0 then 'diluted_shares' else 'revenue' end AS metric, year(o_orderdate) AS period, o_totalprice AS val, {SRC_SQL} AS source, case when o_orderkey % 3 = 0 then 'JPY' end AS ccy, {CCY_SQL.format('o_custkey')} AS source_ccy FROM orders),
  b AS (SELECT entity, metric, period, source, val FROM x QUALIFY row_number() over (partition by entity, metric, period order by case source when 'sec' then 0 when 'ashare' then 1 when '6k' then 2 when 'yfinance' then 3 else 4 end, val desc) = 1),
  t AS (SELECT entity, metric, period, source, upper(coalesce(max(ccy), max(source_ccy))) AS c FROM x GROUP BY 1, 2, 3, 4) SELECT b.entity, b.metric, cast(b.period as bigint) AS period, b.source, case when b.metric = 'diluted_shares' then val else val / {RATE.format('c')} end AS val FROM b JOIN t USING (entity, metric, period, source) LEFT JOIN fx ON fx.ccy = c""")
def kpi02b(spark, d):
    from tallygrid.plans.company import served_facts
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.when(k % 4 == 0, "diluted_shares").otherwise("revenue").alias("metric"), F.year("o_orderdate").cast("bigint").alias("period"), F.col("o_totalprice").alias("val"),
                                         _source_tag().alias("source"), F.when(k % 3 == 0, "JPY").alias("ccy"), _ccy("o_custkey").alias("source_ccy"))
    return served_facts(x, rates(spark)).select("entity", "metric", "period", "source", "val")


@query("agg38_currencies_in_use", f"SELECT DISTINCT upper(c) AS ccy FROM (SELECT {CCY_SQL.format('o_custkey')} AS c FROM orders UNION ALL SELECT case when c_nationkey > 20 then 'jpy' end FROM customer) WHERE c is not null and upper(c) <> 'USD'")
def agg38(spark, d):
    a = table(spark, d, "orders").select(_ccy("o_custkey").alias("c"))
    b = table(spark, d, "customer").select(F.when(F.col("c_nationkey") > 20, "jpy").alias("c"))
    return FX.currencies_in_use((a, "c"), (b, "c"))


@query("agg39_row_currency", f"""WITH x AS (SELECT o_custkey AS entity, case o_orderpriority when '1-URGENT' then 'total_assets' when '2-HIGH' then 'revenue' when '3-MEDIUM' then 'net_income' else 'capex' end AS m, year(o_orderdate) AS fy, max({CCY_SQL.format('o_orderkey')}) AS c FROM orders GROUP BY 1, 2, 3)
  SELECT entity, coalesce(max(case when m = 'total_assets' then b end), max(case when m = 'revenue' then b end), max(case when m = 'net_income' then b end), 'USD') AS currency FROM (SELECT entity, m, arg_max(coalesce(c, 'USD'), fy) AS b FROM x GROUP BY 1, 2) GROUP BY 1""")
def agg39(spark, d):
    p = F.col("o_orderpriority")
    m = F.when(p == "1-URGENT", "total_assets").when(p == "2-HIGH", "revenue").when(p == "3-MEDIUM", "net_income").otherwise("capex")
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), m.alias("metric"), F.year("o_orderdate").alias("fy")).agg(F.max(_ccy("o_orderkey")).alias("ccy"))
    return FX.row_currency(x)


@query("agg40_reporting_currency", f"""WITH o AS (SELECT o_custkey AS entity, max(case when o_orderstatus = 'F' then o_orderpriority end) is not null AS has FROM orders GROUP BY 1), x AS (SELECT c_custkey AS entity, case when c_nationkey % 4 > 0 then {CCY_SQL.format('c_custkey')} end AS p, {CCY_SQL.format('c_nationkey')} AS s, coalesce(has, false) AS has FROM customer LEFT JOIN o ON o.entity = c_custkey)
  SELECT entity, case when has and coalesce(p, '') <> '' then upper(p) else upper(coalesce(s, 'USD')) end AS currency, upper(coalesce(p, 'USD')) AS sec_ccy, upper(coalesce(s, 'USD')) AS sixk_ccy FROM x""")
def agg40(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).isNotNull().alias("has"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.when(F.col("c_nationkey") % 4 > 0, _ccy("c_custkey")).alias("p"), _ccy("c_nationkey").alias("s"))
    x = c.join(o, "entity", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return x.select("entity", FX.reporting_currency("p", "has", "s").alias("currency"), FX.source_currency(F.lit("derived"), "p", "s").alias("sec_ccy"),
                    FX.source_currency(F.lit("6k"), "p", "s").alias("sixk_ccy"))


@query("agg42_latest_daily_record", "SELECT user_id AS entity, arg_max(value, {'t': ts, 'e': event_id}) * 10000 AS market_cap, cast(cast(max(ts) as date) as varchar) AS trade_date FROM events GROUP BY 1")
def agg42(spark, d):
    from tallygrid.operators.keyed import newest_per_key
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), "ts", "event_id", "value")
    return newest_per_key(e, ["entity"], ["ts", "event_id"]).select("entity", (F.col("value") * 10000).alias("market_cap"), F.to_date("ts").cast("string").alias("trade_date"))


@query("snk12_refresh_rates", """WITH o AS (SELECT c_nationkey AS k, max(c_acctbal) AS r, '2001-01-01' AS d FROM customer GROUP BY 1), n AS (SELECT s_nationkey AS k, max(s_acctbal) - 5000 AS r, '2001-02-01' AS d FROM supplier GROUP BY 1), g AS (SELECT * FROM n WHERE r > 0)
  SELECT cast(k as varchar) AS ccy, r AS per_usd, d AS as_of FROM g UNION ALL SELECT cast(k as varchar), r, d FROM o WHERE k NOT IN (SELECT k FROM g)""")
def snk12(spark, d):
    o = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("ccy")).agg(F.max("c_acctbal").alias("per_usd")).withColumn("as_of", F.lit("2001-01-01"))
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("ccy")).agg((F.max("s_acctbal") - 5000).alias("per_usd")).withColumn("as_of", F.lit("2001-02-01"))
    return FX.refresh_rates(o, n)
