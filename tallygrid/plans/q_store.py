"""Source, sink, read-model and incremental queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import keyed as K
from tallygrid.plans import bindings as B
from tallygrid.plans import q_grid as QG
from tallygrid.plans import readmodels as RM
from tallygrid.plans.q_blend import FILED_SQL, FM_SQL, ORD, ANN_F, FYS, SPAN, filed, filed_metrics
from tallygrid.plans.q_scalars import TITLE_SQL, title_column
from tallygrid.plans.registry import query, table
from tallygrid.session import scratch
from tallygrid.sources import files as FI
from tallygrid.sources import merge_table as M
from tallygrid.sources import payloads as P
from tallygrid.sources import sinks as SK
from tallygrid.sources.json_arrays import read_large_arrays
from tallygrid.sources.merge_table import MergeTable as MT
from tallygrid.streaming import incremental as I

iso = lambda c: F.col(c).cast("string").alias(c)
LINES2_SQL = """l2 AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS part, l_extendedprice AS price, l_returnflag AS flag, cast(cast(l_shipdate as date) as varchar) AS ship FROM lineitem
  UNION ALL SELECT l_orderkey, 100 + l_linenumber, l_suppkey, l_quantity, l_linestatus, cast(cast(l_shipdate as date) as varchar) FROM lineitem)"""


def line_docs(spark, d):
    """One document per line with an array of two records, built inside the row: nested payloads
    whose size does not depend on how many lines an order has."""
    return table(spark, d, "lineitem").select("l_orderkey", line_records().alias("rows"))


def line_records():
    c = F.col
    rec = lambda n, part, price, flag: F.struct(n.cast("int").alias("n"), part.alias("part"), price.alias("price"), flag.alias("flag"), F.to_date("l_shipdate").cast("string").alias("ship"))
    return F.array(rec(c("l_linenumber"), c("l_partkey"), c("l_extendedprice"), c("l_returnflag")), rec(c("l_linenumber") + 100, c("l_suppkey"), c("l_quantity"), c("l_linestatus")))


# --- sources ---------------------------------------------------------------------------------------------------

@query("src01_json_array", f"WITH {LINES2_SQL} SELECT l_orderkey AS k, n, part, price FROM l2")
def src01(spark, d):
    path = scratch(spark, "src01")
    rows = F.transform("rows", lambda r: F.struct(F.col("l_orderkey").alias("k"), r["n"].alias("n"), r["part"].alias("part"), r["price"].alias("price")))
    x = line_docs(spark, d)
    x.select(F.to_json(rows).alias("value")).write.text(path)
    table(spark, d, "region").select(F.concat(F.lit("{broken "), "r_name").alias("value")).write.mode("append").text(path)
    return FI.read_json_array(spark, path, "k bigint, n int, part bigint, price double", array_per_line=True)


@query("src01_split_arrays", f"WITH {LINES2_SQL} SELECT l_orderkey AS k, n, part, price, flag FROM l2")
def src01b(spark, d):
    """Indented arrays of many records a file: a file holds 20,000 orders, so there are more files as the table grows.
    Lines are dealt to files as they are, their text is made where it is written."""
    path = scratch(spark, "arrays")
    x = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 20_000).alias("f"), F.lit(1).alias("o"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    frame = x.select("f").distinct().select("f", F.explode(F.array(F.lit(0), F.lit(2))).alias("o"))
    x = x.unionByName(frame, allowMissingColumns=True).repartition(B.partitions(spark, d), "f").sortWithinPartitions("f", "o")
    doc = lambda r: F.concat(F.lit(",\n"), F.to_json(F.struct(F.col("l_orderkey").alias("k"), r["n"].alias("n"), r["part"].alias("part"), r["price"].alias("price"), F.concat(r["flag"], F.lit("\\\"},{")).alias("flag")), {"pretty": "true"}))
    rec = line_records()
    value = F.when(F.col("o") == 0, "[null").when(F.col("o") == 2, "]").otherwise(F.concat_ws("\n", doc(rec[0]), doc(rec[1])))
    x.select("f", value.alias("value")).write.partitionBy("f").text(path)
    good, _bad = read_large_arrays(spark, path, "k bigint, n int, part bigint, price double, flag string")
    return good.select("k", "n", "part", "price", F.expr("substring(flag, 1, length(flag) - 5)").alias("flag"))


def _jsonl(spark, d):
    path = scratch(spark, "jsonl")
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("ticker"), "value"))
    raw = F.when(F.col("event_type") == "error", F.substring(body, 1, 12)).when(F.col("event_type") == "view", "").otherwise(body)
    table(spark, d, "events").select(raw.alias("value")).write.text(path)
    return path


@query("src02_json_lines", "SELECT event_id AS id, 'u' || user_id AS ticker, value FROM events WHERE event_type not in ('error', 'view')")
def src02(spark, d):
    return FI.read_json_lines(spark, _jsonl(spark, d), "id bigint, ticker string, value double")


@query("src03_field_values", "SELECT DISTINCT 'u' || user_id AS ticker FROM events WHERE event_type not in ('error', 'view')")
def src03(spark, d):
    return FI.field_values(spark, _jsonl(spark, d), "ticker")


@query("src04_snk02_entity_shards", "SELECT o_custkey AS entity, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
def src04(spark, d):
    path = scratch(spark, "shards")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", "o_totalprice")
    SK.write_by_entity(o, path, "entity")
    return spark.read.parquet(path).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query("src04_entity_point_read", "SELECT o_custkey AS entity, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10")
def src04b(spark, d):
    path = scratch(spark, "shards")
    SK.write_by_entity(table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", "o_totalprice"), path, "entity")
    return FI.read_entity(spark, path, 10)


@query("src05_shard_folder", "SELECT user_id AS entity, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1")
def src05(spark, d):
    path = scratch(spark, "src05")
    e = table(spark, d, "events")
    e.select(F.col("user_id").alias("entity"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 14, "0")).alias("fetched_at"), "value", "event_type") \
        .write.partitionBy("event_type").json(path)
    return FI.read_shards(spark, path, "entity bigint, fetched_at string, value double", lines=True).select("entity", "value")


@query("src05_07_indented_files", "SELECT n_nationkey AS entity, n_name AS name FROM nation")
def src05b(spark, d):
    """Indented one-document files beside a broken one."""
    path = scratch(spark, "src05")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("entity"), F.col("n_name").alias("name"), F.lit("2001").alias("fetched_at"))
    form = F.col("entity") % 2
    doc = F.struct("entity", "name", "fetched_at")
    text = F.when(form == 0, F.to_json(doc, {"pretty": "true"})).otherwise(F.to_json(F.array(doc), {"pretty": "true"}))
    n.select(text.alias("value"), F.col("entity").alias("f")).repartition("f").write.partitionBy("f").text(path)
    table(spark, d, "region").limit(1).select(F.lit("{ broken").alias("value"), F.lit(-1).alias("f")).write.mode("append").partitionBy("f").text(path)
    return FI.read_shards(spark, path, "entity int, name string, fetched_at string").select("entity", "name")


@query("src06_keyed_rows", "SELECT case when o_orderstatus <> 'P' then o_custkey end AS entity, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def src06(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("entity"), "o_orderkey", F.col("o_totalprice").alias("v"))
    return FI.keyed_rows(o, "entity", "o_orderkey")


@query("src07_08_store_documents", f"WITH {LINES2_SQL} SELECT 'T' || l_orderkey AS ticker, n, price FROM l2")
def src07(spark, d):
    path = scratch(spark, "src07")
    x = line_docs(spark, d)
    doc = F.to_json(F.struct(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("ticker"), F.col("rows").alias("filings")))
    x.select(doc.alias("value")).write.text(path)
    table(spark, d, "region").select(F.concat(F.lit('{"ticker": "'), "r_name", F.lit('", "filings": [')).alias("value")).write.mode("append").text(path)
    good, _bad = FI.read_quarantined(spark, path, "ticker string, filings array<struct<n:int,price:double>>", lines=True)
    return good.select(F.upper("ticker").alias("ticker"), F.inline("filings"))


@query("src09_company_facts", f"WITH {FILED_SQL} SELECT o_orderkey, entity, concept, unit, cast(start as varchar) AS start, cast(\"end\" as varchar) AS \"end\", val, form, cast(filed as varchar) AS filed FROM filed")
def src09(spark, d):
    rec = F.struct("start", "end", "val", "form", "filed", "fy", F.lit("FY").alias("fp"))
    f = filed(spark, d)
    body = F.to_json(F.create_map(F.col("concept"), F.struct(F.create_map(F.col("unit"), F.array(rec)).alias("units"))))
    docs = f.select("o_orderkey", "entity", body.alias("body"))
    x = P.company_facts(docs, ["o_orderkey", "entity"], "body")
    return x.select("o_orderkey", "entity", "concept", "unit", iso("start"), iso("end"), "val", "form", iso("filed"))


@query("src11_column_payload", f"WITH {LINES2_SQL} SELECT l_orderkey, cast(n as varchar) AS n, cast(part as varchar) AS part FROM l2")
def src11(spark, d):
    items = F.transform("rows", lambda r: F.array(r["n"].cast("string"), r["part"].cast("string")))
    payload = line_docs(spark, d).select("l_orderkey", F.to_json(F.struct(F.array(F.lit("n"), F.lit("part")).alias("fields"), items.alias("items"))).alias("p"))
    x = payload.select("l_orderkey", F.from_json("p", "fields array<string>, items array<array<string>>").alias("p")).select("l_orderkey", "p.*")
    y = P.column_payload(x, ["l_orderkey"], "fields", "items")
    return y.select("l_orderkey", F.col("row")["n"].alias("n"), F.col("row")["part"].alias("part"))


@query("src12_listing", """WITH x AS (SELECT p_partkey AS pos, case when p_size = 1 then '' else p_brand || '-' || p_size end AS ticker, case p_type when 'ECONOMY' then 'NYSE' when 'SMALL' then 'Nasdaq' else 'OTC' end AS exchange, p_name AS name FROM part)
  SELECT ticker, pos, exchange, name FROM x WHERE exchange in ('NYSE', 'Nasdaq') and ticker <> '' QUALIFY row_number() over (partition by ticker order by pos) = 1""")
def src12(spark, d):
    t = F.col("p_type")
    x = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") == 1, "").otherwise(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).alias("ticker"),
                                       F.when(t == "ECONOMY", "NYSE").when(t == "SMALL", "Nasdaq").otherwise("OTC").alias("exchange"), F.col("p_name").alias("name"))
    return P.listing(x)


@query("src13_profiles", "SELECT p_partkey, coalesce(case when p_size > 25 then p_name end, p_brand) AS name FROM part WHERE p_type <> 'PROMO'")
def src13(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(" ").alias("s"), F.col("p_brand").alias("l"), F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")).alias("o"))
    return P.profiles(x, "s", "l", "o").select("p_partkey", "name")


@query("src14_price_rows", f"WITH {LINES2_SQL} SELECT l_orderkey, price AS close, case when flag <> 'A' then cast(n as bigint) end AS volume FROM l2 WHERE flag <> 'R'")
def src14(spark, d):
    data = F.transform("rows", lambda r: F.struct(r["ship"].alias("date"), F.when(r["flag"] != "R", r["price"]).alias("close"), F.when(r["flag"] == "A", float("nan")).otherwise(r["n"].cast("double")).alias("volume")))
    return P.price_rows(line_docs(spark, d).select("l_orderkey", data.alias("data")), ["l_orderkey"], "data").select("l_orderkey", "close", "volume")


@query("src15_fx_file", "SELECT 'C' || n_nationkey AS ccy, n_nationkey * 1.5::double AS per_usd, '2001-08-01' AS as_of FROM nation")
def src15(spark, d):
    path = scratch(spark, "fx")
    # one document over the currency dimension (25 codes)
    doc = table(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")), F.struct(
        (F.col("n_nationkey") * 1.5).alias("per_usd"), F.lit("2001-08-01").alias("as_of"))))).alias("m"))
    doc.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return FI.read_fx(spark, path)


@query("src16_filings", f"WITH {LINES2_SQL} SELECT l_orderkey, flag AS form, ship AS filed FROM l2 WHERE flag in ('A', 'R') and ship >= '1997-01-01'")
def src16(spark, d):
    x = line_docs(spark, d).select("l_orderkey", F.transform("rows", lambda r: r["flag"]).alias("form"), F.transform("rows", lambda r: r["ship"]).alias("filed"))
    first = F.get("form", F.lit(0)) == "A"                # two pages that together hold every row
    return P.filings([x.where(first), x.where(~first)], ["l_orderkey"], ["form", "filed"], ["A", "R"], "1997-01-01")


@query("src18_announcements", f"""WITH x AS (SELECT o_custkey AS entity, o_orderpriority AS category, o_orderkey, o_orderdate, {TITLE_SQL} AS title FROM orders) SELECT entity, category, o_orderkey, row_number() over (partition by entity, category order by o_orderdate desc, o_orderkey desc) AS rn FROM x
  WHERE regexp_matches(title, '年度报告|半年度报告|第一季度报告|第三季度报告') and not regexp_matches(title, '摘要|英文|English|更正|已取消|公告$') QUALIFY rn <= 2""")
def src18(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("category"), "o_orderkey", "o_orderdate", title_column().alias("title"))
    return P.announcements(x, ["entity", "category"], 2, title="title", time="o_orderdate", tie="o_orderkey").select("entity", "category", "o_orderkey", "rn")


@query("src20_first_by_end", "SELECT o_custkey AS entity, strftime(o_orderdate, '%Y-%m') AS period, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2")
def src20(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), "o_orderkey", F.col("o_totalprice").alias("v"))
    return P.first_by_end(o, ["entity", "period"], "o_orderkey")


@query("src21_bundle_children", f"WITH {LINES2_SQL} SELECT l_orderkey, 'prices' AS child, n, price AS v FROM l2 UNION ALL SELECT l_orderkey, 'parts', n, cast(part as double) FROM l2 WHERE flag = 'A'")
def src21(spark, d):
    x = line_docs(spark, d)
    parts = F.transform(F.filter("rows", lambda r: r["flag"] == "A"), lambda r: F.struct(r["n"].alias("n"), r["part"].cast("double").alias("v")))
    b = x.select("l_orderkey", F.transform("rows", lambda r: F.struct(r["n"].alias("n"), r["price"].alias("v"))).alias("prices"), parts.alias("parts"))
    one = lambda c: P.child_table(b, ["l_orderkey"], c).select("l_orderkey", F.lit(c).alias("child"), "n", "v")
    return one("prices").unionByName(one("parts"))


# --- sinks -----------------------------------------------------------------------------------------------------

@query("snk01_overwrite", "SELECT user_id, value FROM events WHERE event_type in ('click', 'purchase')")
def snk01(spark, d):
    path = scratch(spark, "snk01")
    e = table(spark, d, "events").select("user_id", "value", "event_type")
    SK.overwrite(e.where("event_type not in ('click', 'purchase')").drop("event_type"), path)
    SK.overwrite(e.where("event_type in ('click', 'purchase')").drop("event_type"), path)
    return spark.read.parquet(path)


@query("snk03_shard_rewrite", "SELECT event_id, event_type AS shard, case when event_type in ('view', 'click') then value * 2 else value end AS value FROM events")
def snk03(spark, d):
    path = scratch(spark, "snk03")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("shard"), "value")
    SK.write_shards(e, path, "shard", "event_id")
    SK.write_shards(e.where("shard in ('view', 'click')").withColumn("value", F.col("value") * 2), path, "shard", "event_id")
    return spark.read.parquet(path)


OLDNEW_SQL = """o AS (SELECT o_custkey AS entity, max(o_totalprice) AS a, max(o_orderpriority) AS b FROM orders WHERE o_orderdate < date '1999-01-01' GROUP BY 1), n AS (SELECT o_custkey AS entity, max(case when o_orderstatus = 'F' then o_totalprice end) AS a, max(case when o_orderstatus = 'O' then o_orderpriority end) AS b FROM orders WHERE o_orderdate >= date '1999-01-01' GROUP BY 1)"""


def _old_new(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_custkey").alias("entity")
    old = o.where(F.col("o_orderdate") < "1999-01-01").groupBy(key).agg(F.max("o_totalprice").alias("a"), F.max("o_orderpriority").alias("b"))
    s = F.col("o_orderstatus")
    new = o.where(F.col("o_orderdate") >= "1999-01-01").groupBy(key).agg(F.max(F.when(s == "F", F.col("o_totalprice"))).alias("a"), F.max(F.when(s == "O", F.col("o_orderpriority"))).alias("b"))
    return old, new


@query("snk04_upsert", f"WITH {OLDNEW_SQL} SELECT coalesce(n.entity, o.entity) AS entity, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM o FULL JOIN n ON o.entity = n.entity")
def snk04(spark, d):
    return K.upsert(*_old_new(spark, d), ["entity"])


@query("snk05_replace_carry_over", f"WITH {OLDNEW_SQL} SELECT n.entity, n.a, coalesce(n.b, o.b) AS b FROM n LEFT JOIN o USING (entity) UNION ALL SELECT * FROM o WHERE entity NOT IN (SELECT entity FROM n)")
def snk05(spark, d):
    old, new = _old_new(spark, d)
    return K.replace_rows(old, K.carry_over(new, old, ["entity"], ["b"]), ["entity"])


@query("snk10_partial_merge", f"WITH {OLDNEW_SQL} SELECT * FROM n UNION ALL SELECT * FROM o WHERE entity NOT IN (SELECT entity FROM n)")
def snk10(spark, d):
    return K.replace_rows(*_old_new(spark, d), ["entity"])


def _merge_table(spark, d, label):
    """The old rows as a merge-on-read table, and the new rows in two halves."""
    old, new = _old_new(spark, d)
    return MT.create(old, scratch(spark, label), ["entity"]), [new.where(F.col("entity") % 2 == i) for i in (0, 1)]


@query("snk04_merge_on_read", f"WITH {OLDNEW_SQL} SELECT coalesce(n.entity, o.entity) AS entity, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM o FULL JOIN n ON o.entity = n.entity")
def snk04_table(spark, d):
    t, halves = _merge_table(spark, d, "snk04")
    for h in halves:
        t.apply(h, M.UPDATE)
    return t.read()


@query("snk10_merge_on_read", f"WITH {OLDNEW_SQL} SELECT * FROM n UNION ALL SELECT * FROM o WHERE entity NOT IN (SELECT entity FROM n)")
def snk10_table(spark, d):
    t, halves = _merge_table(spark, d, "snk10")
    for h in halves:
        t.apply(h, M.REPLACE)
    t.compact(commits=1)
    return t.read()


@query("snk05_merge_on_read", f"""WITH {OLDNEW_SQL} SELECT n.entity, n.a, coalesce(n.b, o.b) AS b FROM n LEFT JOIN o USING (entity) WHERE n.entity % 5 <> 0
  UNION ALL SELECT * FROM o WHERE entity NOT IN (SELECT entity FROM n) and entity % 5 <> 0""")
def snk05_table(spark, d):
    """Replaced rows carry one column over: a replacement whose other field is updated from what was stored; every fifth entity is removed."""
    t, halves = _merge_table(spark, d, "snk05")
    stored = t.read(columns=["b"])
    for h in halves:
        t.apply(K.carry_over(h, stored, ["entity"], ["b"]), M.REPLACE)
    t.apply(t.read(columns=["entity"]).where("entity % 5 = 0"), M.REMOVE)
    return t.read()


@query("snk07_changed_documents", f"WITH {OLDNEW_SQL}, m AS (SELECT coalesce(n.entity, o.entity) AS entity, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM o FULL JOIN n ON o.entity = n.entity) SELECT cast(m.entity as varchar) AS key FROM m LEFT JOIN o ON o.entity = m.entity WHERE o.entity is null or o.a <> m.a or o.b <> m.b")
def snk07(spark, d):
    old, new = _old_new(spark, d)
    path = scratch(spark, "snk07")
    SK.write_documents(old, path, "entity")
    return SK.changed_documents(SK.documents(K.upsert(old, new, ["entity"]), "entity"), SK.snapshot_path(spark, path)).select("key")


@query("snk06_read_model_documents", "SELECT cast(c_custkey as varchar) AS key, c_name AS name, c_mktsegment AS industry FROM customer")
def snk06(spark, d):
    path = scratch(spark, "snk06")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"))
    SK.write_documents(c, path, "entity")
    return SK.snapshot_path(spark, path).select("key", F.from_json("payload", "name string, industry string").alias("j")).select("key", "j.*")


@query("snk08_save_series", """WITH o AS (SELECT user_id % 10 AS user_id, user_id AS entity, 'n' || (user_id % 3) AS name, max(value) AS v, 'hint' AS source_hint FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id % 10 AS user_id, user_id AS entity, 'n' || (user_id % 4) AS name, max(value) AS v, cast(null as varchar) AS source_hint FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
  x AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.entity, n.entity) AS entity, coalesce(o.name, n.name) AS name, case when n.name is not null then n.v else o.v end AS v, coalesce(n.source_hint, o.source_hint) AS source_hint, o.name is not null AS had FROM o FULL JOIN n ON o.user_id = n.user_id and o.entity = n.entity and o.name = n.name),
  h AS (SELECT user_id, count(*) AS c FROM x WHERE had GROUP BY 1) SELECT user_id, entity, name, v, source_hint FROM (SELECT x.*, coalesce(c, 0) AS c, row_number() over (partition by x.user_id, had order by entity, name) AS rn FROM x LEFT JOIN h USING (user_id)) WHERE had or rn + c <= 60""")
def snk08(spark, d):
    e = table(spark, d, "events")
    def side(half, mod, hint):
        return e.where(F.col("event_id") % 2 == half).groupBy((F.col("user_id") % 10).alias("user_id"), F.col("user_id").alias("entity"), F.concat(F.lit("n"), (F.col("user_id") % mod).cast("string")).alias("name")) \
            .agg(F.max("value").alias("v")).withColumn("source_hint", F.lit(hint).cast("string"))
    return SK.save_series(side(0, 3, "hint"), side(1, 4, None))


@query("snk09_add_points", """WITH o AS (SELECT user_id, cast(cast(ts as date) as varchar) AS period, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT user_id, cast(cast(ts as date) as varchar) AS period, min(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
  SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id and n.period = o.period)""")
def snk09(spark, d):
    e = table(spark, d, "events")
    day = F.to_date("ts").cast("string").alias("period")
    old = e.where("event_id % 2 = 0").groupBy("user_id", day).agg(F.max("value").alias("value"))
    new = e.where("event_id % 2 = 1").groupBy("user_id", day).agg(F.min("value").alias("value"))
    return SK.add_points(old, new, ["user_id"])


@query("snk11_log_update", """WITH l AS (SELECT o_orderkey AS date, [cast(o_custkey as varchar), cast(o_orderkey % 100 as varchar)] AS t FROM orders WHERE o_orderstatus in ('F', 'O')), u AS (SELECT o_orderkey AS date, [cast(o_custkey as varchar), o_orderpriority] AS t FROM orders WHERE o_orderstatus in ('P', 'O'))
  SELECT coalesce(l.date, u.date) AS date, array_to_string(list_sort(list_distinct(list_concat(coalesce(l.t, []), coalesce(u.t, [])))), ',') AS tickers, cast(len(list_distinct(list_concat(coalesce(l.t, []), coalesce(u.t, [])))) as bigint) AS n, case when u.date is not null then 'new' else 'old' end AS summary FROM l FULL JOIN u ON l.date = u.date""")
def snk11(spark, d):
    o = table(spark, d, "orders")
    txt = lambda c: c.cast("string")
    old = o.where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("date"), F.array(txt(F.col("o_custkey")), txt(F.col("o_orderkey") % 100)).alias("tickers"), F.lit("old").alias("summary"))
    new = o.where("o_orderstatus in ('P', 'O')").select(F.col("o_orderkey").alias("date"), F.array(txt(F.col("o_custkey")), F.col("o_orderpriority")).alias("tickers"), F.lit("new").alias("summary"))
    return SK.update_log(old, new).withColumn("tickers", F.array_join("tickers", ","))


# --- read models -----------------------------------------------------------------------------------------------

def analyzed(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), F.col("c_acctbal").alias("stored_cap"))


def status(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("entity"), F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warn").otherwise("ok").alias("status"))


STATUS_SQL = "sta AS (SELECT doc_id AS entity, case when toxic = 1 then 'error' when quality = 0 then 'warn' else 'ok' end AS status FROM labels)"


@query("jn02_ticker_rows", f"{QG.SNAP_SQL}, {STATUS_SQL} SELECT c_custkey AS entity, c_name AS name, c_mktsegment AS industry, coalesce(status, 'ok') AS status, cap AS market_cap, round(cap/nullif(ttm_net_income,0), 6) AS ttm_pe, round(cap/nullif(bv,0), 6) AS pb FROM customer LEFT JOIN sta ON sta.entity = c_custkey LEFT JOIN s ON s.entity = c_custkey")
def jn02(spark, d):
    x = RM.ticker_rows(analyzed(spark, d), status(spark, d), QG.snapshot_frame(spark, d))
    return x.select("entity", "name", "industry", "status", "market_cap", F.round("ttm_pe", 6).alias("ttm_pe"), F.round("pb", 6).alias("pb"))


@query("rm02_industry_detail", f"{QG.SNAP_SQL}, {STATUS_SQL} SELECT c_mktsegment AS industry, c_custkey AS entity, coalesce(status, 'ok') AS status, cap AS market_cap, round(cap/nullif(ttm_revenue,0), 6) AS ps, 'digest of BUILDING' AS summary FROM customer LEFT JOIN sta ON sta.entity = c_custkey LEFT JOIN s ON s.entity = c_custkey WHERE c_mktsegment = 'BUILDING'")
def rm02(spark, d):
    rows = RM.ticker_rows(analyzed(spark, d), status(spark, d), QG.snapshot_frame(spark, d))
    summ = table(spark, d, "customer").select(F.col("c_mktsegment").alias("industry")).distinct().withColumn("summary", F.concat(F.lit("digest of "), "industry"))
    return RM.industry_detail(rows, summ, "building").select("industry", "entity", "status", "market_cap", F.round("ps", 6).alias("ps"), "summary")


@query("rm04_ticker_detail", f"{QG.SNAP_SQL}, {STATUS_SQL}, n AS (SELECT entity, count(*) AS quarters FROM st GROUP BY 1), ny AS (SELECT entity, count(*) AS years FROM sty GROUP BY 1) SELECT c_custkey AS entity, c_name AS name, coalesce(status, 'ok') AS status, case when c_nationkey % 3 = 0 then 'CNY' else 'USD' end AS currency, cap AS market_cap, round(cap/nullif(ttm_net_income,0), 6) AS ttm_pe, coalesce(quarters, 0) AS quarters, coalesce(years, 0) AS years FROM customer LEFT JOIN sta ON sta.entity = c_custkey LEFT JOIN s ON s.entity = c_custkey LEFT JOIN n ON n.entity = c_custkey LEFT JOIN ny ON ny.entity = c_custkey")
def rm04(spark, d):
    from tallygrid.plans.company import company_detail
    q, y = B.statement_pair(spark, d)
    rows = RM.ticker_rows(analyzed(spark, d), status(spark, d), QG.snapshot_frame(spark, d, pair=(q, y)))
    nat = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_nationkey")
    x = company_detail(rows.join(nat, "entity"), q, y, F.when(F.col("c_nationkey") % 3 == 0, "CNY").otherwise("USD"))
    return x.select("entity", "name", "status", "currency", "market_cap", F.round("ttm_pe", 6).alias("ttm_pe"), "quarters", "years")


def _label_cases() -> str:
    from tallygrid.plans.company import STATEMENT_METRICS
    from tallygrid.sources.mappings import METRIC_LABELS
    return ", ".join(f"{c} AS \"{METRIC_LABELS[m]}\"" for c, m in STATEMENT_METRICS.items())


QUOTE_SQL = "qt AS (SELECT c_custkey AS entity, case when c_nationkey % 3 = 0 then 'CNY' else 'USD' end AS quote_ccy, case when c_nationkey % 3 = 0 then 7.1::double else 1.0::double end AS quote_fx FROM customer)"


def _company_pages(spark, d):
    from tallygrid.plans.company import company_page
    from tallygrid.plans.q_quality import all_issues
    q, y = B.statement_pair(spark, d)
    rows = RM.ticker_rows(analyzed(spark, d), status(spark, d), QG.snapshot_frame(spark, d, pair=(q, y))).select("entity", "name", "status", "market_cap")
    cny = F.col("c_nationkey") % 3 == 0
    quotes = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.when(cny, "CNY").otherwise("USD").alias("quote_ccy"), F.when(cny, 7.1).otherwise(1.0).alias("quote_fx"))
    return company_page(rows, q, y, all_issues(spark, d, pair=(q, y)), quotes)


@query("rm04_company_statements", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')}, {QUOTE_SQL}, w AS (SELECT entity, 'annual' AS grid, period, {_label_cases()} FROM sty UNION ALL SELECT entity, 'quarterly', period, {_label_cases()} FROM st)
  SELECT c_name AS name, entity, quote_ccy, quote_fx, grid, cast(period as varchar) AS period, item, val FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (entity, grid, period)) INTO NAME item VALUE val) JOIN customer ON c_custkey = entity JOIN qt USING (entity)""")
def rm04b(spark, d):
    x = _company_pages(spark, d).select("name", "entity", "quote_ccy", "quote_fx", F.inline("statements"))
    return x.select("name", "entity", "quote_ccy", "quote_fx", "grid", F.col("period").cast("string").alias("period"), "item", "val")


@query("rm09_index_rows", f"{QG.SNAP_SQL} SELECT c_mktsegment AS industry, c_custkey AS entity, cap AS market_cap, round(cap/nullif(ttm_fcf,0), 6) AS p_fcf, round(ttm_net_income/nullif(av,0), 6) AS roa FROM customer JOIN s ON s.entity = c_custkey")
def rm09(spark, d):
    from tallygrid.plans.company import index_rows
    x = index_rows(analyzed(spark, d), QG.snapshot_frame(spark, d), ["market_cap", "p_fcf", "roa"])
    return x.select("industry", "entity", "market_cap", F.round("p_fcf", 6).alias("p_fcf"), F.round("roa", 6).alias("roa"))


_SHEET = ["revenue", "cogs", "net_income", "sga", "div_", "shares"]
_SHEET_SQL = ", ".join(_SHEET).replace("div_", "dividends AS div_")


def _slots_sql(n, p):
    return ", ".join(f"max(case when g = '{p}' and rn = {i} then val end) AS {p}{i}" for i in range(1, n + 1))


@query("rm10_fact_sheet", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, {B.statements_sql('year', 'sty')},
  u AS (SELECT entity, 'q' AS g, row_number() over (partition by entity order by period desc) AS rn, {_SHEET_SQL} FROM st QUALIFY rn <= 8 UNION ALL SELECT entity, 'y', row_number() over (partition by entity order by period desc) AS rn, {_SHEET_SQL} FROM sty QUALIFY rn <= 10),
  l AS (SELECT entity, g, rn, metric, case when metric <> 'shares' and c_nationkey % 3 = 0 then val * 7.1::double else val end AS val FROM (UNPIVOT u ON {", ".join(_SHEET)} INTO NAME metric VALUE val) JOIN customer ON c_custkey = entity)
  SELECT entity, replace(metric, 'div_', 'dividends') AS metric, {_slots_sql(10, 'y')}, {_slots_sql(8, 'q')} FROM l GROUP BY 1, 2""")
def rm10(spark, d):
    q, y = B.statement_pair(spark, d)
    factor = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.when(F.col("c_nationkey") % 3 == 0, 7.1).alias("factor"))
    return RM.fact_sheet(y, q, "entity", ["revenue", "cogs", "net_income", "sga", "dividends", "shares"], factor=factor, counts=["shares"])


@query("rm13_last_six_periods", f"""WITH {B.LINES_SQL}, {B.statements_sql()}, u AS (SELECT entity, 'q' AS g, row_number() over (partition by entity order by period desc) AS rn, revenue, cash, ocf FROM st QUALIFY rn <= 6)
  SELECT entity, metric, {_slots_sql(6, 'q')} FROM (UNPIVOT u ON revenue, cash, ocf INTO NAME metric VALUE val) GROUP BY 1, 2""")
def rm13(spark, d):
    q = B.statements(spark, d)
    return RM.fact_sheet(q, q, "entity", ["revenue", "cash", "ocf"], years=0, quarters=6)


def batch_log(spark, d):
    """Batches: one per order with three tickers derived from the order row."""
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("batch"), F.to_date("o_orderdate").alias("date"), "o_orderstatus", F.array(k * 2, k, k + 7).alias("tickers"))


def live_rows(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("industry"))


BATCH_SQL = "bx AS (SELECT o_orderkey AS batch, cast(unnest([0, 1, 2]) as integer) AS pos, unnest([o_custkey * 2, o_custkey, o_custkey + 7]) AS entity FROM orders), live AS (SELECT c_custkey AS entity, c_mktsegment AS industry FROM customer WHERE c_acctbal > 0)"


@query("jn16_rm08_batch_members", f"WITH {BATCH_SQL}, {STATUS_SQL} SELECT batch, pos, entity, industry, coalesce(status, 'ok') AS status FROM bx JOIN live USING (entity) LEFT JOIN sta USING (entity)")
def jn16(spark, d):
    return RM.batch_members(batch_log(spark, d), live_rows(spark, d), status(spark, d), "entity", ["batch"]).select("batch", "pos", "entity", "industry", "status")


TOPLOG_SQL = "top10 AS (SELECT o_orderkey AS batch, cast(o_orderdate as date) AS date, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)"


@query("agg29_rm06_recent_batches", f"WITH {BATCH_SQL}, {TOPLOG_SQL} SELECT batch, cast(date as varchar) AS date, count(live.entity) AS live, any_value(case when o_orderstatus = 'F' then 'digest ' || batch end) AS summary FROM top10 JOIN bx USING (batch) LEFT JOIN live ON live.entity = bx.entity GROUP BY 1, 2")
def agg29(spark, d):
    log = batch_log(spark, d)
    dig = log.where("o_orderstatus = 'F'").select("date", "batch", F.concat(F.lit("digest "), F.col("batch").cast("string")).alias("summary"))
    return RM.recent_batches(log, live_rows(spark, d), dig, "entity", 10, ["date", "batch"]).select("batch", iso("date"), "live", "summary")


@query("agg30_rm07_latest_batch", f"WITH {BATCH_SQL}, b AS (SELECT o_orderkey AS batch FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) SELECT batch, pos, entity, industry FROM bx JOIN b USING (batch) JOIN live USING (entity)")
def agg30(spark, d):
    e = RM.entry_of(batch_log(spark, d), order=["date", "batch"])
    return RM.batch_members(e, live_rows(spark, d), status(spark, d), "entity", ["batch"]).select("batch", "pos", "entity", "industry")


@query("agg45_entry_of_date", "SELECT o_orderkey AS batch, cast(3 as bigint) AS tickers FROM orders WHERE o_orderdate = date '1998-05-05'")
def agg45(spark, d):
    x = RM.entry_of(batch_log(spark, d), F.lit("1998-05-05").cast("date"))
    return x.select("batch", F.size("tickers").cast("bigint").alias("tickers"))


@query("jn17_newest_entry", """WITH l AS (SELECT unnest([c_mktsegment, o_orderpriority]) AS industry, cast(o_orderdate as date) AS date, o_orderkey, 'entry ' || o_orderkey AS s FROM orders JOIN customer ON c_custkey = o_custkey), m AS (SELECT industry, max(date) AS date, arg_max(s, {'d': date, 'k': o_orderkey}) AS s FROM l GROUP BY 1),
  g AS (SELECT c_mktsegment AS industry, max(date '2001-07-01' + cast(c_nationkey * 3 - length(c_mktsegment) as integer)) AS d FROM customer GROUP BY 1) SELECT industry, cast(date as varchar) AS date, case when g.d >= date then 'digest' else s END AS summary FROM m LEFT JOIN g USING (industry)""")
def jn17(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    log = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("entry "), F.col("o_orderkey").cast("string")).alias("summary"), F.array("c_mktsegment", "o_orderpriority").alias("industries"))
    dig = c.select(F.col("c_mktsegment").alias("industry"), F.date_add(F.lit("2001-07-01").cast("date"), (F.col("c_nationkey") * 3 - F.length("c_mktsegment")).cast("int")).alias("date"), F.lit("digest").alias("summary"))
    return RM.newest_entry_per_industry(log, dig).select("industry", iso("date"), "summary")


@query("jn26_saved_rows", "SELECT u.entity, coalesce(c_name, cast(u.entity as varchar)) AS name, c_name is not null AS known, n AS orders FROM (SELECT DISTINCT user_id * 20 AS entity FROM events) u LEFT JOIN customer ON c_custkey = u.entity LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) k ON k.o_custkey = u.entity")
def jn26(spark, d):
    saved = table(spark, d, "events").select((F.col("user_id") * 20).alias("entity")).distinct()
    idx = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("orders"))
    return RM.saved_rows(saved, idx, rows).select("entity", "name", "known", "orders")


# --- incremental -------------------------------------------------------------------------------------------------

@query("inc01_append_stream", "SELECT event_id, user_id, value FROM events")
def inc01(spark, d):
    src = f"{d}/events.parquet"
    out, cp = scratch(spark, "inc01"), scratch(spark, "inc01-cp")
    s = I.file_stream(spark, src, table(spark, d, "events").schema)
    I.append_new_files(s.select("event_id", "user_id", "value"), out, cp)
    I.append_new_files(s.select("event_id", "user_id", "value"), out, cp)      # nothing new: no repeats
    return spark.read.parquet(out)


@query("inc02_once_per_key", "SELECT DISTINCT o_custkey AS accession FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def inc02(spark, d):
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("accession"))
    return I.new_keys_only(b, table(spark, d, "events").select(F.col("user_id").alias("accession")), ["accession"])


@query("inc02_stream_dedupe", "SELECT DISTINCT user_id FROM events")
def inc02b(spark, d):
    out, cp = scratch(spark, "inc02"), scratch(spark, "inc02-cp")
    s = I.file_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    I.append_new_files(I.drop_repeats(s.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "60 days").select("user_id"), out, cp)      # repeats come within two months
    return spark.read.parquet(out)


@query("inc03_restatement_stream", f"""{FM_SQL} SELECT entity, metric, unit, cast({FYS} as bigint) AS fiscal, val, concept FROM fm WHERE not composite and {SPAN} between 350 and 380 and {ANN_F} QUALIFY row_number() over (partition by entity, metric, unit, {FYS} {ORD}) = 1""")
def inc03(spark, d):
    from tallygrid.operators.extract import annual_values
    path = scratch(spark, "inc03-src")
    f = filed_metrics(spark, d).where("not composite")
    for part in (f.where("filed < '1998-01-01'"), f.where("filed >= '1998-01-01'")):                # records arrive in two waves
        part.write.mode("append").parquet(path)
    out, cp = scratch(spark, "inc03"), scratch(spark, "inc03-cp")
    s = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 8).parquet(path)
    I.keep_state(annual_values(s), out, cp, ["entity", "metric", "unit", "fiscal"])
    x = I.read_state(spark, out, ["entity", "metric", "unit", "fiscal"])
    return x.select("entity", "metric", "unit", "fiscal", "val", "concept")


@query("inc04_series_cursor", """WITH s AS (SELECT user_id AS entity, max(cast(cast(ts as date) as varchar)) AS last_source FROM events WHERE event_type not in ('purchase', 'click') GROUP BY 1), f AS (SELECT user_id AS entity, cast(cast(ts as date) as varchar) AS filed, event_id FROM events WHERE event_type in ('purchase', 'click'))
  SELECT s.entity, greatest(last_source, max(filed)) AS last_source, count(event_id) AS used FROM s LEFT JOIN f ON f.entity = s.entity and filed > last_source GROUP BY s.entity, last_source""")
def inc04(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").cast("string").alias("day"), "event_id", "event_type")
    s = e.where("event_type not in ('purchase', 'click')").groupBy("entity").agg(F.max("day").alias("last_source")).withColumn("name", F.lit("gmv"))
    f = e.where("event_type in ('purchase', 'click')").select("entity", F.col("day").alias("filed"), "event_id")
    used = I.extend_series(s, f, ["entity"])
    n = used.groupBy("entity").agg(F.count("event_id").alias("used"))
    return I.advance(s, used, ["entity"]).join(n, "entity", "left").select("entity", "last_source", F.coalesce("used", F.lit(0)).cast("bigint").alias("used"))


@query("inc06_same_day_work", "SELECT DISTINCT user_id AS entity FROM events WHERE event_type = 'view' and cast(ts as date) = date '2024-01-15' and user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' and cast(ts as date) = date '2024-01-15')")
def inc06(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("entity"), "event_type")
    pick = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    log, done = e.where("event_type = 'view'").select("date", "entity").distinct(), e.where("event_type = 'click'")
    return I.todays_work(pick, log, done, F.lit("2024-01-15").cast("date"))


@query("inc07_latest_stream", "SELECT user_id, arg_max(value, {'t': ts, 'e': event_id}) AS value, cast(cast(max(ts) as date) as varchar) AS day FROM events GROUP BY 1")
def inc07(spark, d):
    s = I.file_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    x = I.stream_latest(s, ["user_id"], ["ts", "event_id"], ["value", "ts"], "inc07")
    return x.select("user_id", "value", F.to_date("ts").cast("string").alias("day"))


@query("inc08_version_rerun", """SELECT o_orderkey, case when v < 3 and hit then r else o_totalprice end AS a, case when v < 3 and hit then coalesce(r2, o_orderpriority) else o_orderpriority end AS b, case when v < 3 and hit then 3 else version end AS version FROM (
  SELECT *, coalesce(version, 1) AS v, o_orderpriority <> '1-URGENT' AS hit, o_totalprice * 2 AS r, case when o_custkey % 4 = 0 then 'new' end AS r2 FROM (SELECT *, case o_orderstatus when 'F' then null when 'O' then 2 else 3 end AS version FROM orders))""")
def inc08(spark, d):
    s = F.col("o_orderstatus")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("a"), F.col("o_orderpriority").alias("b"), F.when(s == "F", None).when(s == "O", 2).otherwise(3).alias("version"))
    old = I.outdated(rows, 3)
    rerun = old.where("b <> '1-URGENT'").select("o_orderkey", (F.col("a") * 2).alias("a"), F.when(F.col("o_custkey") % 4 == 0, "new").alias("b"))
    return I.reapply(rows, rerun, ["o_orderkey"], 3, ["b"]).select("o_orderkey", "a", "b", "version")
