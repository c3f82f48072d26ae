"""Read models published as documents (SNK-06, 07)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators.select import industry_of
from tallygrid.plans import q_blend, q_grid, q_select, q_store
from tallygrid.plans import readmodels as RM
from tallygrid.plans.registry import SQL, query, table
from tallygrid.session import scratch
from tallygrid.sources import read_models as D


def industries(spark, d):
    return D.documents(q_select.agg09(spark, d), "industries", ["slug"], ["industry", "n", "latest", "slug"])


def industry_details(spark, d):
    """Every industry's companies A to Z, with its summary."""
    rows = RM.ticker_rows(q_store.analyzed(spark, d), q_store.status(spark, d), q_grid.snapshot_frame(spark, d))
    x = rows.select(industry_of("industry").alias("industry"), "entity", "status", "market_cap", F.round("ps", 6).alias("ps"), F.concat(F.lit("digest of "), industry_of("industry")).alias("summary"))
    x = x.withColumn("slug", S.slug("industry"))
    return D.pages(x, "industry", ["slug"], ["entity"], ["industry", "entity", "status", "market_cap", "ps", "summary"])


def price_histories(spark, d):
    x = q_blend.jn24(spark, d).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("month", "close"))).alias("points"))      # a point a month
    return D.documents(x, "price-history", ["entity"], ["entity", "points"])


def digests(spark, d):
    return D.documents(q_store.agg29(spark, d), "digests", ["date", "batch"], ["batch", "date", "live", "summary"])


def batches(spark, d):
    x = q_store.jn16(spark, d).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pos", "entity", "industry", "status"))).alias("members"))   # as many as one log entry names
    return D.documents(x, "batches", ["batch"], ["batch", "members"])


def search(spark, d):
    x = q_select.flt13(spark, d)
    return D.pages(x.withColumn("initial", F.upper(F.substring(F.col("entity").cast("string"), 1, 2))), "search", ["initial"], ["entity"], x.columns)


MODELS = {"industries": industries, "industry": industry_details, "price-history": price_histories, "digests": digests, "batches": batches, "search": search}


def published(spark, d, *models):
    """A table with these models, written by one job."""
    t = D.create(spark, scratch(spark, "models"))
    docs = None
    for m in models:
        x = MODELS[m](spark, d)
        docs = x if docs is None else docs.unionByName(x)
    D.publish(t, docs)
    return t


@query("snk06_industries", SQL["agg09_rm01_industries"])
def snk06_industries(spark, d):
    return D.read(published(spark, d, "industries"), "industries", "industry string, n long, latest string, slug string").drop("key")


_ALL_DETAILS = SQL["rm02_industry_detail"].replace("'digest of BUILDING'", "'digest of ' || c_mktsegment").replace(" WHERE c_mktsegment = 'BUILDING'", "")


@query("snk06_industry_details", _ALL_DETAILS)
def snk06_details(spark, d):
    schema = "slug string, rows array<struct<industry:string,entity:long,status:string,market_cap:double,ps:double,summary:string>>"
    return D.read(published(spark, d, "industry"), "industry", schema).select(F.inline("rows"))


@query("snk06_price_histories", SQL["jn24_rm05_prices_to_usd"])
def snk06_prices(spark, d):
    return D.read(published(spark, d, "price-history"), "price-history", "entity long, points array<struct<month:string,close:double>>").select("entity", F.inline("points"))


@query("snk06_batches_and_digests", f"SELECT 'batch' AS kind, batch, count(*) AS n FROM ({SQL['jn16_rm08_batch_members']}) GROUP BY 2 UNION ALL SELECT 'digest', batch, live FROM ({SQL['agg29_rm06_recent_batches']})")
def snk06_batches(spark, d):
    t = published(spark, d, "batches", "digests")
    b = D.read(t, "batches", "batch long, members array<struct<pos:int>>").select(F.lit("batch").alias("kind"), "batch", F.size("members").cast("long").alias("n"))
    return b.unionByName(D.read(t, "digests", "batch long, live long").select(F.lit("digest").alias("kind"), "batch", F.col("live").alias("n")))


@query("snk06_search_index", SQL["flt13_set01_rm03_search_index"])
def snk06_search(spark, d):
    fields = q_select.flt13(spark, d).schema
    schema = "rows array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields) + ">>"
    return D.read(published(spark, d, "search"), "search", schema).select(F.inline("rows"))


@query("snk07_published_changes", """SELECT 'batches' AS model, cast(o_orderkey as varchar) AS key, case when o_orderstatus = 'F' then 2 else 0 end AS how FROM orders WHERE o_orderstatus in ('F', 'P')
  UNION ALL SELECT 'customers', cast(c_custkey as varchar), 0 FROM customer WHERE c_acctbal < 0""")
def snk07_published(spark, d):
    """A second run finds finished orders gone, pending ones repriced, and the accounts in debt renamed; the others' documents are not written again."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    t = D.create(spark, scratch(spark, "models"))
    first = D.documents(o, "batches", ["o_orderkey"], ["o_orderkey", "o_totalprice"]).unionByName(D.documents(c, "customers", ["c_custkey"], ["c_custkey", "c_name"]))
    D.publish(t, first)
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice")
    name = F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")).alias("c_name")
    second = D.documents(o.where("o_orderstatus <> 'F'").select("o_orderkey", price), "batches", ["o_orderkey"], ["o_orderkey", "o_totalprice"])
    return D.publish(t, second.unionByName(D.documents(c.select("c_custkey", name), "customers", ["c_custkey"], ["c_custkey", "c_name"])))
