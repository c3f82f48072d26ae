"""Scalar-function queries (SCL family) on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import formats as FM
from tallygrid.functions import scalars as S
from tallygrid.plans.registry import query, table


@query("scl01_fiscal_year", """SELECT o_orderkey, cast(case when month(o_orderdate) >= 6 then year(o_orderdate) else year(o_orderdate) - 1 end as bigint) AS fy FROM orders""")
def scl01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.fiscal_year(F.col("o_orderdate").cast("date")).alias("fy"))


@query("scl02_labels", """WITH x AS (SELECT o_orderkey, year(o_orderdate) y, quarter(o_orderdate) q, case when month(o_orderdate) >= 6 then year(o_orderdate) else year(o_orderdate) - 1 end AS f FROM orders)
  SELECT o_orderkey, 'FY' || f AS fy, 'FY' || right(cast(f as varchar), 2) AS fy_short, y || ' Q' || q AS q_label, 'Q' || q || '''' || right(cast(y as varchar), 2) AS q_short FROM x""")
def scl02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.select("o_orderkey", S.fy_label("d").alias("fy"), S.fy_label("d", True).alias("fy_short"),
                    S.quarter_label("d").alias("q_label"), S.quarter_label("d", True).alias("q_short"))


@query("scl03_04_null_strict", """WITH x AS (SELECT event_id, case when event_type = 'error' then null else value end AS a,
   case when event_type = 'view' then null when event_type = 'click' then 0.0::double else value - 50 end AS b FROM events)
  SELECT event_id, a / nullif(b, 0) AS ratio, case when a is not null and b is not null then cast((a <> 0 and b <> 0)::int as double) end AS both_true,
  case when a is not null and b is not null then cast((a <> 0 or b <> 0)::int as double) end AS any_true, cast((b = 0)::int as double) AS not_b,
  case when a is not null and b is not null then greatest(a, b) end AS hi, case when a is not null and b is not null then least(a, b) end AS lo, cast((a > b)::int as double) AS gt FROM x""")
def scl03(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("a"),
        F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", 0.0).otherwise(F.col("value") - 50).alias("b"))
    return e.select("event_id", S.safe_div("a", "b").alias("ratio"), S.both("a", "b").alias("both_true"), S.either("a", "b").alias("any_true"),
                    S.negate("b").alias("not_b"), S.max_of("a", "b").alias("hi"), S.min_of("a", "b").alias("lo"), S.truth(F.col("a") > F.col("b")).alias("gt"))


@query("scl05_agg23_spread_severity", """WITH li AS (SELECT l_orderkey, cast(sum(cast(round(l_extendedprice*100) as bigint)) as bigint)/100.0::double AS lines FROM lineitem GROUP BY 1),
  x AS (SELECT o_orderkey, o_totalprice AS a, lines AS b FROM orders JOIN li ON l_orderkey = o_orderkey),
  y AS (SELECT o_orderkey, case when greatest(abs(a), abs(b)) = 0 then 0 else (greatest(a, b) - least(a, b)) / greatest(abs(a), abs(b)) end AS s FROM x)
  SELECT o_orderkey, round(s, 8) AS spread, case when s <= 0.001::double then 'ok' when s <= 0.01::double then 'info' when s <= 0.05::double then 'warn' else 'error' end AS severity FROM y""")
def scl05(spark, d):
    from tallygrid.operators.reconcile import spread_of
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint")) / F.lit(100.0)).alias("b"))
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("a")).join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    s = spread_of(F.least("a", "b"), F.greatest("a", "b"), F.greatest(F.abs("a"), F.abs("b")))
    return x.select("o_orderkey", F.round(s, 8).alias("spread"), S.spread_severity(s).alias("severity"))


@query("scl06_other_opex", """WITH g AS (SELECT l_orderkey, cast(sum(cast(round(l_extendedprice) as bigint)) as double) gp, cast(sum(case when l_linestatus = 'O' then cast(round(l_extendedprice*0.5) as bigint) end) as double) op,
   cast(sum(case when l_returnflag = 'A' then l_linenumber end) as double) rd, cast(sum(case when l_returnflag = 'N' then l_linenumber * 10 end) as double) sm,
   cast(sum(case when l_returnflag = 'R' then l_linenumber * 20 end) as double) ga, cast(sum(case when l_linenumber = 1 then 500 end) as double) sga FROM lineitem GROUP BY 1)
  SELECT l_orderkey, gp - op - coalesce(rd, 0) - coalesce(sga, sm + ga) AS other FROM g""")
def scl06(spark, d):
    li = table(spark, d, "lineitem")
    when = lambda cond, v: F.sum(F.when(cond, v)).cast("double")
    price = F.round("l_extendedprice").cast("bigint")
    g = li.groupBy("l_orderkey").agg(
        F.sum(price).cast("double").alias("gp"), when(F.col("l_linestatus") == "O", F.round(F.col("l_extendedprice") * 0.5).cast("bigint")).alias("op"),
        when(F.col("l_returnflag") == "A", F.col("l_linenumber")).alias("rd"), when(F.col("l_returnflag") == "N", F.col("l_linenumber") * 10).alias("sm"),
        when(F.col("l_returnflag") == "R", F.col("l_linenumber") * 20).alias("ga"), when(F.col("l_linenumber") == 1, F.lit(500)).alias("sga"))
    return g.select("l_orderkey", S.other_opex("gp", "op", "rd", "sm", "ga", "sga").alias("other"))


@query("scl07_rescale_thousands", """WITH x AS (SELECT p_partkey, p_retailprice * 1000 AS ni, case when p_size % 3 = 0 then 0.01::double else 0.5::double end AS eps,
   case when p_size % 2 = 0 then p_retailprice * 2 else p_retailprice * 2000 end AS sh FROM part)
  SELECT p_partkey, round(case when sh > 0 and abs(eps) >= 0.05 and abs(ni/eps)/sh between 500 and 2000 then sh * 1000 else sh end, 4) AS shares FROM x""")
def scl07(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_retailprice") * 1000).alias("ni"), F.when(F.col("p_size") % 3 == 0, 0.01).otherwise(0.5).alias("eps"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") * 2).otherwise(F.col("p_retailprice") * 2000).alias("sh"))
    return p.select("p_partkey", F.round(S.rescale_thousands("sh", "ni", "eps"), 4).alias("shares"))


@query("scl08_slug", """SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'uncategorized') AS slug FROM part""")
def scl08(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))).alias("slug"))


_MONEY = "printf('%.{0}f', {1})"


def _money_sql(v, dec, sym):
    m = lambda scale, unit: f"'{sym}' || printf('%.{dec}f', round_even({v} / {scale}, {dec})) || '{unit}'"
    return (f"case when {v} is null then 'n/a' when abs({v}) >= 1e12 then {m('1e12', 'T')} when abs({v}) >= 1e9 then {m('1e9', 'B')} "
            f"when abs({v}) >= 1e6 then {m('1e6', 'M')} when abs({v}) >= 1e3 then {m('1e3', 'K')} else '{sym}' || printf('%.{dec}f', round_even({v}, {dec})) end")


@query("scl09_money_formats", f"""WITH x AS (SELECT c_custkey, case when c_nationkey = 3 then null else c_acctbal * case c_nationkey % 5 when 0 then 1 when 1 then 1000 when 2 then 1000000 when 3 then 1e9::double else 0.01::double end end AS v FROM customer)
  SELECT c_custkey, {_money_sql('v', 1, '$')} AS money1,
   case when v is null then 'n/a' else printf('%.1f', round_even(v/7e6*100, 1)) || '%' end AS pct,
   case when v is null then '—' else printf('%.1f', round_even(v/7e3, 1)) || 'x' end AS mult FROM x""")
def scl09(spark, d):
    n = F.col("c_nationkey") % 5
    scale = F.when(n == 0, 1.0).when(n == 1, 1000.0).when(n == 2, 1e6).when(n == 3, 1e9).otherwise(0.01)
    x = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, None).otherwise(F.col("c_acctbal") * scale).alias("v"))
    return x.select("c_custkey", FM.money("v", 1).alias("money1"), FM.percent(F.col("v") / 7e6, 1).alias("pct"), FM.ratio_x(F.col("v") / 7e3, 1).alias("mult"))


@query("scl10_currency_symbol", """SELECT n_nationkey, case n_nationkey % 7 when 0 then '$' when 1 then '¥' when 2 then 'HK$' when 3 then '€' when 4 then '£' when 5 then '¥' else '' end AS symbol FROM nation""")
def scl10(spark, d):
    codes = F.array(*[F.lit(c) for c in ("usd", "CNY", "HKD", "EUR", "gbp", "JPY", "XXX")])
    return table(spark, d, "nation").select("n_nationkey", FM.currency_symbol(F.get(codes, F.col("n_nationkey") % 7)).alias("symbol"))


@query("scl11_numeric_cleanse", """WITH x AS (SELECT event_id, case event_type when 'error' then '' when 'view' then 'n/a' when 'click' then ' ' || cast(cast(round(value*100) as bigint) as varchar) else cast(cast(round(value) as bigint) as varchar) end AS t FROM events)
  SELECT event_id, try_cast(nullif(trim(t), '') as double) AS v FROM x""")
def scl11(spark, d):
    v = F.col("value")
    t = (F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", "n/a")
         .when(F.col("event_type") == "click", F.concat(F.lit(" "), F.round(v * 100).cast("bigint").cast("string"))).otherwise(F.round(v).cast("bigint").cast("string")))
    return table(spark, d, "events").select("event_id", S.number(t).alias("v"))


@query("scl12_date_labels", """SELECT o_orderkey, cast(cast(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') as date) as varchar) AS iso, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS qk,
  cast(last_day(make_date(year(o_orderdate)::bigint, (quarter(o_orderdate)*3)::bigint, 1)) as varchar) AS qend,
  year(date_trunc('quarter', o_orderdate) - interval 3 month) || 'Q' || quarter(date_trunc('quarter', o_orderdate) - interval 3 month) AS prev1,
  year(date_trunc('quarter', o_orderdate) - interval 24 month) || 'Q' || quarter(date_trunc('quarter', o_orderdate) - interval 24 month) AS prev8 FROM orders""")
def scl12(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    prev = S.ended_quarters("d", 8)
    return o.select("o_orderkey", S.compact_date(F.date_format("d", "yyyyMMdd")).cast("string").alias("iso"), S.quarter_key("d").alias("qk"),
                    S.quarter_key_end(S.quarter_key("d")).cast("string").alias("qend"), F.get(prev, F.lit(0)).alias("prev1"), F.get(prev, F.lit(7)).alias("prev8"))


TITLE_SQL = """(year(o_orderdate) || '年' || case o_orderpriority when '1-URGENT' then '年度报告' when '2-HIGH' then '半年度报告' when '3-MEDIUM' then '第一季度报告' when '5-LOW' then '第三季度报告' else '公司章程' end
  || case o_orderstatus when 'P' then '摘要' when 'O' then '' else '（更新后）' end)"""


def title_column():
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    form = (F.when(p == "1-URGENT", "年度报告").when(p == "2-HIGH", "半年度报告").when(p == "3-MEDIUM", "第一季度报告")
            .when(p == "5-LOW", "第三季度报告").otherwise("公司章程"))
    return F.concat(F.year("o_orderdate").cast("string"), F.lit("年"), form, F.when(s == "P", "摘要").when(s == "O", "").otherwise("（更新后）"))


@query("scl13_report_titles", f"""WITH x AS (SELECT o_orderkey, {TITLE_SQL} AS t, o_orderdate FROM orders),
  y AS (SELECT *, case when t like '%半年度报告%' then '半年度报告' when t like '%第一季度报告%' then '第一季度报告' when t like '%第三季度报告%' then '第三季度报告' when t like '%年度报告%' then '年度报告' else '定期报告' end AS form,
   coalesce(nullif(regexp_extract(t, '(20\\d{{2}})\\s*年', 1), ''), cast(year(o_orderdate) - 1 as varchar)) AS fy FROM x)
  SELECT o_orderkey, form, fy, fy || '-' || case form when '半年度报告' then '06-30' when '第一季度报告' then '03-31' when '第三季度报告' then '09-30' else '12-31' end AS period_end, form <> '第一季度报告' AS cumulative FROM y""")
def scl13(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderdate", title_column().alias("t"))
    x = x.withColumn("form", S.report_form("t")).withColumn("fy", S.report_year("t", "o_orderdate"))
    return x.select("o_orderkey", "form", "fy", S.report_period("form", "fy").alias("period_end"), S.report_cumulative("form").alias("cumulative"))


@query("scl14_series_points", """WITH x AS (SELECT event_id, user_id, case when user_id % 2 = 0 then 'annual' else 'quarterly' end AS grid,
   case event_type when 'view' then strftime(ts, '%Y') when 'click' then strftime(ts, '%Y-%m-%d') when 'error' then 'Q1' else ' ' || strftime(ts, '%Y-%m-%d') end AS p,
   case when event_type = 'signup' then 'abc' when event_type = 'purchase' then null else cast(cast(round(value) as bigint) as varchar) end AS v, 'User ' || event_type || ' (GMV)' AS nm FROM events),
  y AS (SELECT *, case when grid = 'annual' then case when regexp_full_match(trim(p), '\\d{4}(-\\d{2}-\\d{2})?') then substr(trim(p), 1, 4) end
    else case when regexp_full_match(trim(p), '\\d{4}-\\d{2}-\\d{2}') then trim(p) end end AS period FROM x)
  SELECT event_id, regexp_replace(regexp_replace(lower(trim(nm)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, period, try_cast(v as double) AS value FROM y
  WHERE period is not null and (v is null or try_cast(v as double) is not null)""")
def scl14(spark, d):
    from tallygrid.operators.metrics import check_points
    t, e = F.date_format("ts", "yyyy-MM-dd"), F.col("event_type")
    x = table(spark, d, "events").select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "annual").otherwise("quarterly").alias("grid"),
        F.when(e == "view", F.date_format("ts", "yyyy")).when(e == "click", t).when(e == "error", "Q1").otherwise(F.concat(F.lit(" "), t)).alias("period"),
        F.when(e == "signup", "abc").when(e == "purchase", None).otherwise(F.round("value").cast("bigint").cast("string")).alias("value"),
        S.series_name(F.concat(F.lit("User "), e, F.lit(" (GMV)"))).alias("name"))
    return check_points(x)[0].select("event_id", "name", "period", "value")


@query("scl15_company_names", """SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(replace(c_name, '#', ' Holdings, Inc. #')), '\\b(incorporated|inc|corporation|corp|company|co|holding|holdings|group|plc|ltd|limited|llc|lp|sa|nv|ag|se|trust|bancorp|the)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM customer""")
def scl15(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.company_key(F.replace(F.col("c_name"), F.lit("#"), F.lit(" Holdings, Inc. #"))).alias("name_key"))


@query("scl16_titles", """WITH x AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)
  SELECT conv_id, turn, case when length(t) > 60 then rtrim(left(t, 59)) || '…' else t end AS title FROM x""")
def scl16(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.title_of("text", 60).alias("title"))


@query("scl17_cap_tiers", """SELECT c_custkey, case when v is null then null when v < 300e6 then 'micro' when v < 2e9 then 'small' when v < 10e9 then 'mid' when v < 200e9 then 'large' else 'mega' end AS tier
  FROM (SELECT c_custkey, case when c_acctbal > 0 then c_acctbal * c_acctbal * 3000 end AS v FROM customer)""")
def scl17(spark, d):
    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * F.col("c_acctbal") * 3000)
    return table(spark, d, "customer").select("c_custkey", S.cap_tier(v).alias("tier"))


@query("scl18_payload_check", """SELECT event_id, cast(json_extract(props, '$.k') as bigint) AS k, case when event_type = 'error' then 'not json' when event_type = 'view' then 'missing category' when event_type = 'click' then 'bad category' end AS problem FROM events""")
def scl18(spark, d):
    e = F.col("event_type")
    cat = lambda v: F.regexp_replace("props", r"\}$", f', "category": "{v}"}}')
    raw = F.when(e == "error", F.concat(F.col("props"), F.lit("}{"))).when(e == "view", F.col("props")).when(e == "click", cat("zzz")).otherwise(cat("good"))
    x = table(spark, d, "events").select("event_id", "props", raw.alias("raw"))
    body, err = S.payload_check("raw", "k bigint, category string", ["k", "category"], {"category": ["good", "fair"]})
    return x.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), err.alias("problem"))


@query("scl19_header_cap", """WITH x AS (SELECT c_custkey, c_acctbal AS cap, case when c_nationkey % 3 = 0 then c_acctbal * 7 end AS native_cap,
   case c_nationkey % 4 when 0 then 'USD' when 1 then 'CNY' when 2 then 'EUR' else 'JPY' end AS q, case when c_nationkey % 5 = 0 then 'CNY' else case c_nationkey % 4 when 0 then 'USD' when 1 then 'CNY' when 2 then 'EUR' else 'JPY' end end AS r FROM customer)
  SELECT c_custkey, q = r and q <> 'USD' AS native, case when q = r and q <> 'USD' then coalesce(native_cap, cap * 7.1::double) else cap end AS shown FROM x""")
def scl19(spark, d):
    n4 = F.col("c_nationkey") % 4
    q = F.when(n4 == 0, "USD").when(n4 == 1, "CNY").when(n4 == 2, "EUR").otherwise("JPY")
    x = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("cap"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_acctbal") * 7).alias("native_cap"),
                                           q.alias("q"), F.when(F.col("c_nationkey") % 5 == 0, "CNY").otherwise(q).alias("r"))
    x = x.withColumn("native", S.is_native("q", "r"))
    return x.select("c_custkey", "native", S.header_cap("cap", "native_cap", F.lit(7.1), "native").alias("shown"))


@query("flt21_first_of_with_source", """SELECT event_id, coalesce(a, b, value) AS v, case when a is not null then 'sec' when b is not null then 'yfinance' else 'derived' end AS src FROM (
  SELECT event_id, value, case when event_type = 'view' then value * 2 end AS a, case when event_type in ('click', 'view') then value * 3 end AS b FROM events)""")
def flt21(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_type") == "view", F.col("value") * 2).alias("a"),
                                         F.when(F.col("event_type").isin("click", "view"), F.col("value") * 3).alias("b"))
    return e.select("event_id", S.first_of("a", "b", "value").alias("v"),
                    S.first_source(["a", "b", "value"], [F.lit("sec"), F.lit("yfinance"), F.lit("derived")]).alias("src"))
