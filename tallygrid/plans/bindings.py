"""The driver tables as entity x period x metric facts.

Amounts are summed as integers (cents, or cents x percent), so that a result does not depend on
the order in which partitions are added, and turned into doubles at the end. The SQL text
next to each frame states the same binding for the checker."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.plans.registry import table
from tallygrid.session import estimated_bytes

#: File bytes of the lines for each partition of their exchanges: a task's sort fits its memory at any size of the table.
PARTITION_BYTES = 8 << 20

cents = lambda c: F.rint(F.col(c) * 100).cast("bigint")      # the inputs have two decimals: exact, without BigDecimal
flag = lambda cond, v: F.sum(F.when(cond, v))


def line_columns() -> list:
    """Per-line integers: price in cents, discount and tax in percent, quantity."""
    return [cents("l_extendedprice").alias("px"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"),
            F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls")]


SUMS = {
    # name: (condition on a line, integer value of a line)
    "revenue_t": (None, "px * 100"),
    "cogs_t": ("rf = 'R'", "px * disc * 10"),
    "gp_t": ("rf = 'A' and ls = 'F'", "px * (100 - disc)"),
    "op_t": (None, "px * (50 - disc)"),
    "ni_t": (None, "case when rf = 'R' then -px * 20 else px * (25 - disc) end"),
    "shares_t": (None, "qty"),
    "rd_t": ("ls = 'O'", "px * tax"),
    "sm_t": ("rf = 'A'", "px * tax"),
    "ga_t": ("rf = 'N'", "px * tax"),
    "sga_t": ("rf = 'R' and ls = 'O'", "px * tax"),
    "ocf_t": ("rf <> 'R'", "px * (40 - tax)"),
    "capex_t": ("ls = 'F'", "px * disc"),
    "div_t": ("rf = 'A' and ls = 'O'", "px * disc"),
    "cash_t": ("ls = 'F'", "px * 200"),
    "sti_t": ("ls = 'O' and rf = 'N'", "px * 100"),
    "assets_t": (None, "px * 300"),
    "equity_t": (None, "px * (150 - disc * 10)"),
    "ltd_t": ("rf = 'R' and ls = 'F'", "px * 100"),
    "std_t": ("rf = 'A' and ls = 'F'", "px * 50"),
    "legacy_t": ("rf = 'N' and ls = 'F'", "px * 80"),
}
# statement column -> (integer sum, divisor)
COLUMNS = {
    "revenue": "revenue_t", "cogs": "cogs_t", "gross_profit": "gp_t", "op_income": "op_t", "net_income": "ni_t",
    "rd": "rd_t", "sm": "sm_t", "ga": "ga_t", "sga": "sga_t", "ocf": "ocf_t", "capex": "capex_t", "dividends": "div_t",
    "cash": "cash_t", "sti": "sti_t", "assets": "assets_t", "equity": "equity_t", "lt_debt": "ltd_t", "st_debt": "std_t",
    "debt_legacy": "legacy_t"}


def _agg_spark(prefix=None):
    out = []
    for name, (cond, val) in SUMS.items():
        out.append(F.sum(F.expr(f"case when {cond} then {val} end" if cond else val)).alias(name))
    return out


def partitions(spark: SparkSession, d: str) -> int:
    """Partitions that the size of the line table asks for."""
    return max(1, math.ceil(estimated_bytes(table(spark, d, "lineitem")) / PARTITION_BYTES))


def customer_lines(spark: SparkSession, d: str, line: list, order: list) -> DataFrame:
    """Lines with the customer of their order, all lines of a customer in one of as many partitions as the table's size asks for. What is
    aggregated by customer, or by customer and period, needs no exchange after this one. Lines are few columns wide and hardly combine
    below a quarter or month, so they travel as they are."""
    n = partitions(spark, d)
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), *order).repartition(n, "o_orderkey")
    x = table(spark, d, "lineitem").select("l_orderkey", *line).repartition(n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.drop("o_orderkey").repartition(n, "entity")


def quarter_sums(spark: SparkSession, d: str) -> DataFrame:
    """Integer sums per customer and quarter end of the order date."""
    x = customer_lines(spark, d, line_columns(), [S.quarter_end("o_orderdate").alias("period")]).drop("l_orderkey")
    return x.groupBy("entity", "period").agg(*_agg_spark())


def as_statements(sums: DataFrame) -> DataFrame:
    return sums.select("entity", "period", *[(F.col(t) / F.lit(10000.0)).alias(c) for c, t in COLUMNS.items()],
                       F.col("shares_t").cast("double").alias("shares"))


def year_sums(sums: DataFrame) -> DataFrame:
    """Years rolled up from the quarters; the lines are not read again."""
    year = F.make_date(F.year("period"), F.lit(12), F.lit(31)).alias("period")
    return sums.groupBy("entity", year).agg(*[F.sum(n).alias(n) for n in SUMS])


def statements(spark: SparkSession, d: str, grain: str = "quarter") -> DataFrame:
    """One wide row per customer and quarter (or year): entity, period (end date) and metrics."""
    q = quarter_sums(spark, d)
    return as_statements(q if grain == "quarter" else year_sums(q))


def statement_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(quarters, years) for jobs that read both several times: the quarter sums are written once
    to the shared folder, so the lines are scanned and shuffled once."""
    from tallygrid.session import materialise
    q = materialise(quarter_sums(spark, d), "quarters")
    return as_statements(q), as_statements(year_sums(q))


def derived(df: DataFrame) -> DataFrame:
    """Adds the derived cells used by ratios: total_debt, cash_all, fcf, reported-or-derived gross profit."""
    from tallygrid.operators.blend import total_debt
    return (df.withColumn("gross_profit", F.coalesce("gross_profit", F.col("revenue") - F.col("cogs")))
            .withColumn("fcf", F.col("ocf") - F.abs(F.coalesce("capex", F.lit(0.0))))
            .withColumn("cash_all", F.col("cash") + F.coalesce("sti", F.lit(0.0)))
            .withColumn("total_debt", total_debt("lt_debt", "st_debt", "debt_legacy", "assets")))


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Month-end closes: unit price of the customer's last shipped line of a month: entity, month,
    close."""
    line = ["l_shipdate", "l_linenumber", cents("l_extendedprice").alias("px"), F.col("l_quantity").cast("bigint").alias("qty")]
    x = customer_lines(spark, d, line, [])
    last = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "px", "qty")).alias("b")
    return x.groupBy("entity", F.trunc("l_shipdate", "month").alias("month")).agg(last).select(
        "entity", "month", (F.col("b.px") / F.lit(100.0) / F.col("b.qty")).alias("close"))


def nation_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Dense grid: order value per nation and quarter: entity (nation name), period, revenue, orders."""
    o = table(spark, d, "orders").select("o_custkey", S.quarter_end("o_orderdate").alias("period"), cents("o_totalprice").alias("c"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "period").agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("orders"))
    return x.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "entity", "period", (F.col("c") / F.lit(100.0)).alias("revenue"), "orders")


# --- the same bindings as SQL ------------------------------------------------------------------------

def _sums_sql() -> str:
    return ", ".join(f"cast(sum({f'case when {c} then {v} end' if c else v}) as bigint) AS {n}" for n, (c, v) in SUMS.items())


LINES_SQL = ("li AS (SELECT l_orderkey, l_linenumber, l_shipdate, cast(round(l_extendedprice*100) as bigint) px, "
             "cast(round(l_discount*100) as bigint) disc, cast(round(l_tax*100) as bigint) tax, "
             "cast(l_quantity as bigint) qty, l_returnflag rf, l_linestatus ls FROM lineitem)")
QEND = "last_day(make_date(year({0})::bigint, (quarter({0})*3)::bigint, 1))"


def statements_sql(grain: str = "quarter", name: str = "st") -> str:
    period = QEND.format("o_orderdate") if grain == "quarter" else "make_date(year(o_orderdate)::bigint, 12, 31)"
    cols = ", ".join(f"{t}/10000.0::double AS {c}" for c, t in COLUMNS.items())
    return (f"{name}_os AS (SELECT l_orderkey, {_sums_sql()} FROM li GROUP BY 1), "
            f"{name}_g AS (SELECT o_custkey AS entity, {period} AS period, "
            + ", ".join(f"cast(sum({n}) as bigint) AS {n}" for n in SUMS)
            + f" FROM {name}_os JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), "
            f"{name} AS (SELECT entity, period, {cols}, shares_t::double AS shares FROM {name}_g)")


DERIVED_SQL = """dst AS (SELECT * REPLACE (coalesce(gross_profit, revenue - cogs) AS gross_profit),
  ocf - abs(coalesce(capex, 0.0::double)) AS fcf, cash + coalesce(sti, 0.0::double) AS cash_all,
  case when lt_debt is not null or st_debt is not null then coalesce(lt_debt, 0.0::double) + coalesce(st_debt, 0.0::double)
       when debt_legacy is not null then debt_legacy when assets is not null then 0.0::double end AS total_debt FROM st)"""
PRICES_SQL = """px AS (SELECT entity, month, (b.px / 100.0::double / b.qty) AS close FROM (
  SELECT o_custkey AS entity, cast(date_trunc('month', l_shipdate) as date) AS month,
    max({'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'px': px, 'qty': qty}) AS b
  FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))"""
NATION_SQL = f"""nq AS (SELECT n_name AS entity, {QEND.format('o_orderdate')} AS period,
  cast(sum(cast(round(o_totalprice*100) as bigint)) as bigint)/100.0::double AS revenue, count(*) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
