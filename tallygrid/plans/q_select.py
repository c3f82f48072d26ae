"""Filtering, rotation, set and lookup queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators import keyed as K
from tallygrid.operators import select as X
from tallygrid.plans.registry import query, table

CRIT = X.Criteria(min_cap=500.0, max_cap=8000.0, countries=[f"NATION_{i}" for i in range(20)], excluded=["Furni", "AUTO"])
NATIONS = "(" + ", ".join(f"'NATION_{i}'" for i in range(20)) + ")"
REASON_SQL = f"""case when market_cap is null then 'no_market_cap' when market_cap < 500 then 'cap_below_min' when market_cap > 8000 then 'cap_above_max'
  when country not in {NATIONS} then 'country_not_allowed' when coalesce(industry, '') = '' then 'no_industry'
  when contains(lower(industry), 'furni') then 'industry_excluded:Furni' when contains(lower(industry), 'auto') then 'industry_excluded:AUTO' end"""
UNI_SQL = """uni AS (SELECT c_custkey AS entity, case when c_custkey % 11 = 0 then null else c_acctbal end AS market_cap, n_name AS country,
  case when c_custkey % 13 = 0 then '' else c_mktsegment end AS industry, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def universe(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    c = table(spark, d, "customer")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_acctbal")).alias("market_cap"), "country",
        F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.col("c_mktsegment")).alias("industry"), F.col("c_name").alias("name"))


@query("flt01_udx06_mandate", f"WITH {UNI_SQL} SELECT entity, {REASON_SQL} AS reason FROM uni")
def flt01(spark, d):
    return universe(spark, d).select("entity", CRIT.reason().alias("reason"))


def _classified(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("entity")).distinct()


CLS_SQL = "cls AS (SELECT DISTINCT o_custkey * 2 AS entity FROM orders)"
SCR_SQL = f"scr AS (SELECT cls.entity, case when uni.entity is null then 'not_in_universe' else {REASON_SQL} end AS reason, industry FROM cls LEFT JOIN uni ON uni.entity = cls.entity)"


@query("jn01_screen", f"WITH {UNI_SQL}, {CLS_SQL}, {SCR_SQL} SELECT * FROM scr")
def jn01(spark, d):
    return X.screen(_classified(spark, d), universe(spark, d), CRIT).select("entity", "reason", "industry")


@query("agg11_reject_histogram", f"WITH {UNI_SQL}, {CLS_SQL}, {SCR_SQL} SELECT reason, count(*) AS n FROM scr WHERE reason is not null GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg11(spark, d):
    return X.reject_histogram(X.screen(_classified(spark, d), universe(spark, d), CRIT))


@query("agg11_survivors", f"""WITH {UNI_SQL}, {CLS_SQL}, {SCR_SQL} SELECT industry, count(*) AS n, round(100.0::double * count(*) / (SELECT count(*) FROM cls), 6) AS pct FROM scr WHERE reason is null GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def agg11b(spark, d):
    c = _classified(spark, d)
    s = X.screen(c, universe(spark, d), CRIT).where("reason is null")
    total = c.agg(F.count(F.lit(1))).scalar()
    return s.groupBy("industry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "industry").limit(10) \
        .withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 6))


@query("flt02_merge_defaults", """SELECT e.event_id, cast(json_extract(case when event_type = 'view' then null else props end, '$.k') as varchar) AS k, case when event_type = 'view' then 0 else 1 end::bigint AS n FROM events e""")
def flt02(spark, d):
    m = F.when(F.col("event_type") != "view", F.from_json("props", "map<string,string>"))
    x = table(spark, d, "events").select("event_id", m.alias("data"), F.create_map(F.lit("a"), F.lit("b")).alias("meta"))
    return X.merge_classification(x, "data", "meta").select("event_id", F.try_element_at("data", F.lit("k")).alias("k"), F.size("data").cast("bigint").alias("n"))


@query("flt09_set04_clean_keys", """SELECT DISTINCT upper(trim(t)) AS ticker FROM (SELECT case when event_type = 'error' then '  ' else ' ' || event_type || user_id || ' ' end AS t FROM events) WHERE trim(t) <> ''""")
def flt09(spark, d):
    t = F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), "event_type", "user_id", F.lit(" ")))
    return X.clean_keys(table(spark, d, "events").select(t.alias("t")), "t")


@query("flt10_exchange_codes", """WITH x AS (SELECT c_custkey, lpad(cast(c_custkey * 613 % 1000000 as varchar), 6, '0') || case c_nationkey % 5 when 0 then '.SS' when 1 then '.SZ' when 2 then '' when 3 then '.ss' else '.N' end AS t FROM customer)
  SELECT c_custkey, regexp_matches(upper(t), '\\.(SS|SH|SZ|BJ)$') AS ashare, case when not contains(t, '.') then case when t like '6%' then t || '.SH' when t like '4%' or t like '8%' then t || '.BJ' else t || '.SZ' end
   when upper(t) like '%.SS' then replace(upper(t), '.SS', '.SH') else upper(t) end AS code FROM x""")
def flt10(spark, d):
    n = F.col("c_nationkey") % 5
    t = F.concat(F.lpad((F.col("c_custkey") * 613 % 1000000).cast("string"), 6, "0"),
                 F.when(n == 0, ".SS").when(n == 1, ".SZ").when(n == 2, "").when(n == 3, ".ss").otherwise(".N"))
    return table(spark, d, "customer").select("c_custkey", t.alias("t")).select("c_custkey", X.is_ashare("t").alias("ashare"), X.exchange_code("t").alias("code"))


@query("flt11_search_ranked", """SELECT p_partkey, p_brand, p_name, cast(case when starts_with(upper(p_brand), 'BRAND#1') then 0 else 1 end as integer) AS rank FROM part
  WHERE starts_with(upper(p_brand), 'BRAND#1') or contains(lower(p_name), 'brand#1') ORDER BY rank, p_retailprice DESC NULLS LAST, p_brand, p_partkey LIMIT 12""")
def flt11(spark, d):
    p = table(spark, d, "part").withColumn("k", F.concat("p_brand", F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    return X.search(p, "Brand#1", "k", "p_name", "p_retailprice").select("p_partkey", "p_brand", "p_name", "rank")


@query("flt12_search_plain", """SELECT c_custkey, c_name, cast(case when starts_with(upper(c_name), 'CUSTOMER#0000000') then 0 else 1 end as integer) AS rank FROM customer
  WHERE starts_with(upper(c_name), 'CUSTOMER#0000000') or contains(lower(c_name), 'customer#0000000') ORDER BY rank, c_name LIMIT 40""")
def flt12(spark, d):
    return X.search_plain(table(spark, d, "customer"), "customer#0000000", "c_name", "c_name").select("c_custkey", "c_name", "rank")


@query("flt13_set01_rm03_search_index", f"""WITH {UNI_SQL}, an AS (SELECT o_custkey AS entity, max(o_totalprice) AS market_cap, 'A' || max(o_orderpriority) AS industry FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT coalesce(an.entity, uni.entity) AS entity, coalesce(an.industry, uni.industry) AS industry, cast(trunc(coalesce(an.market_cap, uni.market_cap)) as bigint) AS market_cap, an.entity is not null AS analyzed
  FROM uni FULL JOIN an ON an.entity = uni.entity""")
def flt13(spark, d):
    an = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.max("o_totalprice").alias("market_cap"), F.concat(F.lit("A"), F.max("o_orderpriority")).alias("industry"))
    return X.search_index(universe(spark, d), an, "entity", ["industry", "market_cap"])


@query("flt15_exhibits", """WITH x AS (SELECT o_orderkey, case when o_orderstatus = 'F' then ['main.htm', 'a-ex99_1.htm', 'EX-99.2.htm'] else ['main.htm', 'other' || o_custkey || '.htm'] end AS names FROM orders),
  y AS (SELECT o_orderkey, list_filter(names, lambda n: regexp_matches(lower(n), 'ex-?99')) AS hit, list_filter(names, lambda n: n <> 'main.htm') AS rest FROM x)
  SELECT o_orderkey, array_to_string(case when len(hit) > 0 then hit else rest end, ',') AS picked FROM y""")
def flt15(spark, d):
    o = table(spark, d, "orders")
    names = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("main.htm"), F.lit("a-ex99_1.htm"), F.lit("EX-99.2.htm"))) \
        .otherwise(F.array(F.lit("main.htm"), F.concat(F.lit("other"), F.col("o_custkey").cast("string"), F.lit(".htm"))))
    return o.select("o_orderkey", F.array_join(X.exhibit_candidates(names, F.lit("main.htm")), ",").alias("picked"))


SEG_SQL = """seg AS (SELECT o_custkey AS entity, cast(make_date(year(o_orderdate)::bigint, 12, 31) as varchar) AS period, case o_orderstatus when 'P' then '合计' else ' ' || o_orderpriority end AS item,
  case o_orderstatus when 'F' then 'D' when 'O' then 'I' else 'P' end AS code, cast(sum(cast(round(o_totalprice*100) as bigint)) as bigint)/100.0::double AS revenue, cast(sum(cast(round(o_totalprice) as bigint) * (o_orderkey % 7 - 2)) as double) AS profit FROM orders GROUP BY ALL)"""


def _segments(spark, d):
    o = table(spark, d, "orders")
    s = F.col("o_orderstatus")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).cast("string").alias("period"),
                     F.when(s == "P", "合计").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("item"),
                     F.when(s == "F", "D").when(s == "O", "I").otherwise("P").alias("code")).agg(
        (F.sum(F.rint(F.col("o_totalprice") * 100).cast("bigint")) / F.lit(100.0)).alias("revenue"),
        F.sum(F.round("o_totalprice").cast("bigint") * (F.col("o_orderkey") % 7 - 2)).cast("double").alias("profit"))


@query("flt16_segments", f"WITH {SEG_SQL} SELECT entity, period, trim(item) AS item, case code when 'D' then 'region' when 'I' then 'industry' when 'P' then 'product' else 'other' end AS kind, revenue FROM seg WHERE trim(item) not in ('合计', '地区', '行业', '产品')")
def flt16(spark, d):
    return X.segments(_segments(spark, d)).select("entity", "period", F.trim("item").alias("item"), "kind", "revenue")


@query("rm12_segment_margins", f"""WITH {SEG_SQL}, s AS (SELECT *, dense_rank() over (partition by entity order by period desc) dr FROM seg WHERE trim(item) <> '合计')
  SELECT entity, period, trim(item) AS item, revenue, round(profit/nullif(revenue,0), 6) AS margin, code FROM s WHERE dr <= 2""")
def rm12(spark, d):
    from pyspark.sql import Window as W
    s = X.segments(_segments(spark, d))
    w = W.partitionBy("entity").orderBy(F.col("period").desc())
    return s.withColumn("dr", F.dense_rank().over(w)).where("dr <= 2").select(
        "entity", "period", F.trim("item").alias("item"), "revenue", F.round(S.safe_div("profit", "revenue"), 6).alias("margin"), "code")


@query("flt17_inc05_stale_keys", """WITH st AS (SELECT o_custkey AS entity, max(cast(o_orderdate as date)) AS fetched_at FROM orders GROUP BY 1)
  SELECT c_custkey AS entity FROM customer LEFT JOIN st ON st.entity = c_custkey WHERE fetched_at is null or date '2001-08-01' - fetched_at > 90""")
def flt17(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    st = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.max(F.to_date("o_orderdate")).alias("fetched_at"))
    return X.stale_keys(c, st, "entity", F.lit("2001-08-01").cast("date"), 90)


@query("flt18_quarters_to_check", """WITH cand AS (SELECT c_custkey AS entity, i, year(q) || 'Q' || quarter(q) AS quarter, last_day(cast(q as date) + interval 2 month) AS qend FROM customer,
   (SELECT i, date_trunc('quarter', date '2001-08-01') - to_months(cast(i * 3 + 3 as integer)) AS q FROM range(0, 8) t(i))),
  calls AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter FROM orders WHERE o_orderstatus = 'F'),
  chk AS (SELECT o_custkey AS entity, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, max(cast(o_orderdate as date)) AS checked FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2),
  j AS (SELECT cand.*, checked, exists(SELECT 1 FROM calls k WHERE k.entity = cand.entity) AS has_calls, exists(SELECT 1 FROM chk k WHERE k.entity = cand.entity) AS has_chk FROM cand LEFT JOIN chk USING (entity, quarter)
   WHERE NOT exists(SELECT 1 FROM calls k WHERE k.entity = cand.entity and k.quarter = cand.quarter))
  SELECT entity, quarter FROM j WHERE case when not has_calls and has_chk then i = 0 and (checked is null or date '2001-08-01' - checked >= 30)
   else checked is null or (date '2001-08-01' - checked >= 3 and date '2001-08-01' - qend <= 120) end""")
def flt18(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), S.quarter_key("o_orderdate").alias("quarter"), F.to_date("o_orderdate").alias("dt"), "o_orderstatus")
    calls = o.where("o_orderstatus = 'F'").select("entity", "quarter").distinct()
    checks = o.where("o_orderstatus <> 'F'").groupBy("entity", "quarter").agg(F.max("dt").alias("checked"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    return X.quarters_to_check(c, calls, checks, F.lit("2001-08-01").cast("date"))


@query("flt19_retry_set", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus in ('F', 'O') and not starts_with(case when o_orderstatus = 'O' then 'extraction failed: x' else 'done' end, 'extraction failed'))""")
def flt19(spark, d):
    o = table(spark, d, "orders")
    store = o.where("o_orderstatus in ('F', 'O')").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "extraction failed: x").otherwise("done").alias("skipped"))
    return K.pending(o.select("o_orderkey"), store.where(~F.col("skipped").startswith("extraction failed")), ["o_orderkey"])


@query("flt20_default_industry", """SELECT entity, coalesce(nullif(industry, ''), 'Uncategorized') AS industry, array_to_string(list_filter([coalesce(nullif(industry, ''), 'Uncategorized'), country, '(none)'], lambda x: x not in ('Uncategorized', '(none)')), ',') AS shown
  FROM (SELECT c_custkey AS entity, case when c_custkey % 13 = 0 then '' else c_mktsegment end AS industry, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def flt20(spark, d):
    i = X.industry_of("industry")
    return universe(spark, d).select("entity", i.alias("industry"), F.array_join(X.display_names(F.array(i, F.col("country"), F.lit("(none)"))), ",").alias("shown"))


@query("flt28_targets", "SELECT DISTINCT c_mktsegment AS segment FROM customer WHERE c_mktsegment NOT IN ('BUILDING') ORDER BY 1 LIMIT 3")
def flt28(spark, d):
    return X.targets(table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")), "segment", exclude=["BUILDING"], limit=3)


@query("flt28_jn15_unknown_targets", "SELECT DISTINCT user_id * 20 AS entity FROM events WHERE user_id * 20 NOT IN (SELECT o_custkey FROM orders)")
def flt28b(spark, d):
    want = table(spark, d, "events").select((F.col("user_id") * 20).alias("entity")).distinct()
    return X.unknown_targets(want, table(spark, d, "orders").select(F.col("o_custkey").alias("entity")), "entity")


@query("flt29_daily_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= greatest(date '1998-03-01', make_date(2001 - 2, 1, 1))")
def flt29(spark, d):
    return X.daily_window(table(spark, d, "orders"), "o_orderdate", "1998-03-01", F.lit("2001-08-01").cast("date")).select("o_orderkey")


@query("flt30_source_class", "SELECT DISTINCT c_custkey AS entity FROM customer WHERE c_mktsegment = 'MACHINERY' or right(c_name, 2) = '00'")
def flt30(spark, d):
    return table(spark, d, "customer").where((F.col("c_mktsegment") == "MACHINERY") | F.col("c_name").endswith("00")).select(F.col("c_custkey").alias("entity")).distinct()


@query("jn15_watch_list", f"""WITH {UNI_SQL} SELECT w.user_id AS entity, uni.name, uni.industry, uni.entity is not null AS known FROM (SELECT DISTINCT user_id * 25 AS user_id FROM events) w LEFT JOIN uni ON uni.entity = w.user_id""")
def jn15(spark, d):
    w = table(spark, d, "events").select((F.col("user_id") * 25).alias("entity")).distinct()
    u = universe(spark, d).select("entity", "name", "industry", F.lit(True).alias("known"))
    return w.join(u, "entity", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query("jn27_first_statement", """WITH f AS (SELECT l_orderkey AS entity, case l_returnflag when 'A' then 'balance_sheet' when 'N' then 'income_statement' else 'cash_flow' end AS stmt, max(l_extendedprice) AS val FROM lineitem GROUP BY 1, 2)
  SELECT entity, val, stmt FROM f QUALIFY row_number() over (partition by entity order by case stmt when 'income_statement' then 0 when 'balance_sheet' then 1 else 2 end) = 1""")
def jn27(spark, d):
    from tallygrid.operators.blend import first_statement
    rf = F.col("l_returnflag")
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity"), F.when(rf == "A", "balance_sheet").when(rf == "N", "income_statement").otherwise("cash_flow").alias("stmt")) \
        .agg(F.max("l_extendedprice").alias("val"))
    return first_statement(f, ["entity"])


@query("jn28_target_union", "SELECT DISTINCT user_id AS entity FROM events UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_nationkey > 20")
def jn28(spark, d):
    a = table(spark, d, "events").select(F.col("user_id").alias("entity"))
    b = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("entity"))
    return a.union(b).union(table(spark, d, "customer").where("c_nationkey > 20").select("c_custkey")).distinct()


@query("jn29_identity_row", f"""WITH {UNI_SQL}, a AS (SELECT o_custkey AS entity, max(case when o_orderstatus = 'F' then 'A ' || o_orderpriority end) AS name_a, max(o_totalprice) AS native FROM orders GROUP BY 1)
  SELECT uni.entity, coalesce(name_a, case when uni.entity % 3 = 0 then name end, cast(uni.entity as varchar)) AS name, round(native / case when country = 'NATION_1' then 7.1::double else 1.0::double end, 6) AS market_cap, native FROM uni LEFT JOIN a USING (entity)""")
def jn29(spark, d):
    from tallygrid.operators.fx import with_rate
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("A "), "o_orderpriority"))).alias("name_a"), F.max("o_totalprice").alias("native"))
    x = universe(spark, d).join(a, "entity", "left").withColumn("ccy", F.when(F.col("country") == "NATION_1", "CNY").otherwise("USD"))
    fx = spark.createDataFrame([("CNY", 7.1, "2001-08-01")], "ccy string, per_usd double, as_of string")
    x = with_rate(x, fx, F.col("ccy"))
    return x.select("entity", S.first_of("name_a", F.when(F.col("entity") % 3 == 0, F.col("name")), F.col("entity").cast("string")).alias("name"),
                    F.round(F.col("native") / F.col("rate"), 6).alias("market_cap"), "native")


@query("agg09_rm01_industries", f"""WITH {UNI_SQL}, x AS (SELECT coalesce(nullif(industry,''),'Uncategorized') AS industry, cast(max(o_orderdate) as date) AS latest, entity FROM uni JOIN orders ON o_custkey = entity GROUP BY 1, 3)
  SELECT industry, count(*) AS n, cast(max(latest) as varchar) AS latest, lower(industry) AS slug FROM x GROUP BY 1""")
def agg09(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.max(F.to_date("o_orderdate")).alias("analyzed_date"))
    x = X.industries(universe(spark, d).join(last, "entity"))
    return x.select("industry", "n", F.col("latest").cast("string").alias("latest"), "slug")


@query("agg10_latest_per_key", """SELECT o_custkey AS entity, o_orderkey, cast(cast(o_orderdate as date) as varchar) AS analyzed_date, o_totalprice FROM orders QUALIFY row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey asc) = 1""")
def agg10(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("analyzed_date"), "o_orderkey", "o_totalprice")
    return K.newest_per_key(o, ["entity"], ["analyzed_date", -F.col("o_orderkey")]).withColumn("analyzed_date", F.col("analyzed_date").cast("string"))


@query("agg27_status_counts", "SELECT coalesce(case when toxic = 1 then 'error' when quality = 0 then 'warn' end, 'ok') AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg27(spark, d):
    from tallygrid.operators.quality import status_counts, worst
    lab = table(spark, d, "labels")
    issues = lab.where("toxic = 1").select("doc_id", F.lit("error").alias("severity")).union(lab.where("quality = 0").select("doc_id", F.lit("warn")))
    return status_counts(worst(issues, table(spark, d, "documents").select("doc_id"), "doc_id"))


@query("agg32_token_costs", """WITH p(role, price) AS (VALUES ('user', 0.5::double), ('assistant', 2.0::double)) SELECT conv_id, cast(sum(length(text)) as bigint) AS chars, round(sum(case when price is null then null else length(text) * price / 1e6 end), 9) AS cost,
  count(case when price is null then 1 end) AS unpriced FROM conversations LEFT JOIN p USING (role) GROUP BY 1""")
def agg32(spark, d):
    from tallygrid.operators.inventory import usage_costs
    p = spark.createDataFrame([("user", 0.5), ("assistant", 2.0)], "role string, price double")
    u = table(spark, d, "conversations").select("conv_id", "role", F.length("text").alias("n"))
    return usage_costs(u, p, ["conv_id"], "role", "n").withColumnRenamed("tokens", "chars")


# --- rotation ----------------------------------------------------------------------------------------------

BATCH_SQL = "sizes AS (SELECT p_brand AS industry, count(*) AS n FROM part GROUP BY 1)"


@query("win14_set05_greedy_pick", f"""WITH {BATCH_SQL} SELECT industry, n FROM (SELECT *, sum(n) over (order by n desc, industry rows unbounded preceding) AS run FROM sizes WHERE industry NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 50)) WHERE run - n < 200""")
def win14(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("industry"), "p_size")
    return X.pick_industries(p, p.where("p_size = 50").select("industry").distinct(), 200)


def _log(spark, d):
    # industries that left the pool stay in the log
    name = F.when(F.col("event_type").isin("error", "click", "view"), F.col("event_type")).otherwise(F.concat(F.lit("former "), "event_type"))
    day = F.to_date("ts")
    return table(spark, d, "events").groupBy(day.alias("date")).agg(F.array_sort(F.collect_set(name)).alias("industries"),
                                            F.max(F.when(F.dayofmonth("ts") > 20, 2).otherwise(F.when(F.dayofmonth("ts") > 10, 1))).alias("cycle"))


@query("win15_rotation_state", """WITH log AS (SELECT cast(ts as date) AS date, coalesce(max(case when day(ts) > 20 then 2 when day(ts) > 10 then 1 end), 1) AS cycle FROM events GROUP BY 1)
  SELECT cast(cycle as bigint) AS cycle, cast(min(date) as varchar) AS cycle_start FROM log WHERE cycle = (SELECT max(cycle) FROM log) GROUP BY 1""")
def win15(spark, d):
    return X.cycle_state(_log(spark, d)).withColumn("cycle_start", F.col("cycle_start").cast("string"))


@query("win15_plan_pick", """WITH sizes AS (SELECT event_type AS industry, count(*) AS n FROM events GROUP BY 1), used AS (SELECT DISTINCT event_type FROM events WHERE event_type in ('error','click','view') and day(ts) > 20)
  SELECT industry, n, false AS restarted, cast(2 as bigint) AS cycle FROM (SELECT *, sum(n) over (order by n desc, industry rows unbounded preceding) AS run FROM sizes WHERE industry NOT IN (SELECT event_type FROM used)) WHERE run - n < 20""")
def win15b(spark, d):
    return X.plan_pick(table(spark, d, "events").select(F.col("event_type").alias("industry")), _log(spark, d), 20)


@query("win15_done_in_cycle", "SELECT o_custkey AS entity, max(o_orderdate) >= date '2001-06-01' AS done FROM orders GROUP BY 1")
def win15c(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_orderdate").alias("dt"))
    return o.select("entity", X.done_in_cycle(F.col("dt").cast("date"), F.lit("2001-06-01").cast("date")).alias("done"))


@query("win29_budget_work_list", """SELECT user_id, event_id, value FROM (SELECT *, sum(cast(round(value*100) as bigint)) over (partition by user_id order by event_id rows unbounded preceding) AS run FROM events) WHERE run - cast(round(value*100) as bigint) < 50000""")
def win29(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.rint(F.col("value") * 100).cast("bigint").alias("cost"))
    return K.running_total(e, ["user_id"], "event_id", "cost", "run", block=1024).where(F.col("run") - F.col("cost") < 50000).select("user_id", "event_id", "value")


@query("set02_batch_union", """SELECT o_custkey AS entity FROM orders WHERE o_orderdate >= date '2001-07-01' UNION SELECT user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set02(spark, d):
    from tallygrid.operators.inventory import batch_union
    o = table(spark, d, "orders")
    batch = o.where(F.col("o_orderdate") >= "2001-07-01").select(F.col("o_custkey").alias("entity")).distinct()
    watch = table(spark, d, "events").select(F.col("user_id").alias("entity")).distinct()
    analyzed = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity"))
    return batch_union(batch, watch, analyzed)


@query("set03_pending", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def set03(spark, d):
    return K.pending(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
