"""Snapshot ratios and table columns (KPI-01..04, AGG-01, 02, 08; FLT-24).

Input is one wide row per entity and period, so an entity has at most one row per quarter of
the calendar. The snapshot is one pass: rank the periods, then conditional aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S


def ranked(df: DataFrame, entity: str = "entity", period: str = "period") -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(entity).orderBy(F.col(period).desc())))


def strict_sum(v, n: int = 4) -> Column:
    """AGG-01 aggregate over rows ranked newest-first in ``_rn``: null unless n values exist."""
    x = F.when(F.col("_rn") <= n, S._c(v))
    return F.when(F.count(x) == n, F.sum(x))


def newest_value(v, period: str = "period") -> Column:
    """AGG-02 aggregate: value of the newest period that has one."""
    return F.max_by(S._c(v), F.when(S._c(v).isNotNull(), F.col(period)))


def newest_key_value(v, period: str = "period") -> Column:
    """AGG-02, the quality-rule variant: value of the newest period even if it is null."""
    return F.max_by(S._c(v), F.col(period))


def newest_four(df: DataFrame, entity: str = "entity") -> DataFrame:
    return ranked(df, entity).where(F.col("_rn") <= 4)


def dividend_per_share(total, shares) -> Column:
    """AGG-08: dividends of the newest four quarters per share; zero for a non-payer, null
    without a share count."""
    sh = F.nullif(S._c(shares), F.lit(0.0))
    return F.when(sh.isNotNull(), F.coalesce(S._c(total), F.lit(0.0)) / sh)


# Metrics the snapshot needs summed over four quarters and taken from the newest period.
SUMMED = ["revenue", "gross_profit", "op_income", "net_income", "ocf", "fcf"]


def snapshot(quarters: DataFrame, years: DataFrame, prices: DataFrame, base: DataFrame,
             entity: str = "entity", ebitda: bool = False, cash_keys: tuple[str, ...] = ("cash_all", "cash")) -> DataFrame:
    """KPI-01 (15 fields); with ``ebitda`` the 16-field variant KPI-03, whose caller also passes
    cash_keys=("cash", "cash_all").

    ``quarters``: entity, period and metric columns; ``years``: entity, period, net_income;
    ``prices``: entity, month, close; ``base``: entity, base_shares (AGG-05)."""
    from tallygrid.operators.shares import latest_close
    summed = SUMMED + (["ebitda"] if ebitda else [])
    flows = ranked(quarters, entity).groupBy(entity).agg(
        *[strict_sum(m).alias(f"ttm_{m}") for m in summed],
        F.sum(F.when(F.col("_rn") <= 4, F.abs("dividends"))).alias("_div"),
        newest_value("equity").alias("_bv"), newest_value(F.coalesce(*cash_keys)).alias("_cash"),
        newest_value(F.coalesce("total_debt", "lt_debt")).alias("_debt"), newest_value("assets").alias("_assets"))
    ann = years.groupBy(entity).agg(newest_value("net_income").alias("_ni_y"))
    x = (flows.join(ann, entity, "left").join(base, entity, "left")
         .join(latest_close(prices, entity), entity, "left"))
    c = F.col
    x = x.withColumn("market_cap", c("price") * c("base_shares"))
    x = x.withColumn("_ev", c("market_cap") + c("_debt") - F.coalesce("_cash", F.lit(0.0)))
    d = S.safe_div
    out = {
        "market_cap": c("market_cap"), "ttm_pe": d("market_cap", "ttm_net_income"),
        "static_pe": d("market_cap", "_ni_y"), "ev_revenue": d("_ev", "ttm_revenue"),
        "pb": d("market_cap", "_bv"), "ps": d("market_cap", "ttm_revenue"), "p_fcf": d("market_cap", "ttm_fcf"),
        "ttm_pocf": d("market_cap", "ttm_ocf"), "debt_asset": d("_debt", "_assets"),
        "gross_margin": d("ttm_gross_profit", "ttm_revenue"), "op_margin": d("ttm_op_income", "ttm_revenue"),
        "net_margin": d("ttm_net_income", "ttm_revenue"), "roe": d("ttm_net_income", "_bv"),
        "roa": d("ttm_net_income", "_assets"), "dividend_rate": dividend_per_share("_div", "base_shares")}
    if ebitda:
        out["ev_ebitda"] = d("_ev", "ttm_ebitda")
    return x.select(entity, *[v.alias(k) for k, v in out.items()])


def snapshot_served(analyzed: DataFrame, snap: DataFrame, quarters: DataFrame, entity: str = "entity") -> DataFrame:
    """KPI-02: every analyzed entity gets its snapshot; without statements the stored cap and
    nulls. Newest-quarter income and the operating cash flow of that same period are added."""
    last = quarters.where(F.col("net_income").isNotNull()).groupBy(entity).agg(
        F.max_by(F.struct(F.col("net_income").alias("latest_q_ni"), F.col("ocf").alias("latest_q_ocf")), "period").alias("q"))
    x = analyzed.select(entity, F.col("market_cap").alias("_stored")).join(snap, entity, "left") \
        .join(last.select(entity, "q.*"), entity, "left")
    return x.withColumn("market_cap", F.coalesce("market_cap", "_stored")).drop("_stored")


# Columns whose absence drops a table column (FLT-24).
HEADLINE = ["revenue", "gross_profit", "op_income", "net_income", "eps", "shares", "ocf", "fcf", "capex", "cash_any",
            "debt_any", "assets"]


# Further statement items that the table shows as they are, where the periods have them.
TABLE_ITEMS = ["ebitda", "pretax_income", "income_tax", "interest_expense", "total_liabilities", "cur_assets", "cur_liab", "retained_earnings",
               "goodwill", "inventory", "receivables"]


def prune_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """FLT-24: keep a row only if one of the headline metrics is present."""
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull())


def table_columns(periods: DataFrame, prices: DataFrame, years: DataFrame, entity: str = "entity") -> DataFrame:
    """KPI-04: the table's column set: raw metrics, per-share values, margins, cost ratios,
    current ratio and static multiples, further items and the source tag (<item>_src) of each cell that
    has one. Prices need the exact month; share count, book value
    and the annual denominators are as-of. One row per entity and period."""
    from tallygrid.operators.asof import asof, newest_in_bucket
    c = F.col
    x = (periods.withColumn("capex", F.abs("capex")).withColumn("cash_any", F.coalesce("cash_all", "cash"))
         .withColumn("debt_any", F.coalesce("total_debt", "lt_debt")).withColumn("eps", S.safe_div("net_income", "shares")))
    x = prune_empty(x, HEADLINE)
    # one as-of pass over narrow keys serves all four looked-up values
    facts = periods.select(entity, "period", c("shares").alias("_sh"), c("equity").alias("_bv")).unionByName(
        years.select(entity, "period", c("net_income").alias("_ni_y"), c("revenue").alias("_rev_y")), allowMissingColumns=True)
    looked = asof(periods.select(entity, "period"), facts, [entity], "period", "period", ["_sh", "_bv", "_ni_y", "_rev_y"], probes_unique=True)
    x = x.join(looked, [entity, "period"])
    month = newest_in_bucket(prices, [entity], "month", ["close"], "month")
    x = x.withColumn("_b", F.trunc("period", "month")).join(month, [entity, "_b"], "left").drop("_b")
    sh, bv = F.coalesce("shares", "_sh"), F.coalesce("equity", "_bv")
    cap = sh * c("close")
    d = S.safe_div
    return x.select(
        entity, "period", "revenue", "gross_profit", "op_income", "net_income", "eps", "shares", "ocf", "fcf", "capex",
        "cash_any", "debt_any", "assets", bv.alias("equity"),
        d(c("revenue"), sh).alias("sps"), d(bv, sh).alias("bvps"), d("gross_profit", "revenue").alias("gm"),
        d("op_income", "revenue").alias("om"), d("net_income", "revenue").alias("nm"), d("rd", "revenue").alias("rd_r"),
        d("sm", "revenue").alias("sm_r"), d("ga", "revenue").alias("ga_r"), d("sga", "revenue").alias("sga_r"),
        d(S.other_opex("gross_profit", "op_income", "rd", "sm", "ga", "sga"), c("revenue")).alias("other_r"),
        d("cur_assets", "cur_liab").alias("current_ratio"), d(cap, c("_ni_y")).alias("static_pe"),
        d(cap, c("_rev_y")).alias("static_ps"), d(cap, bv).alias("pb"), d(cap + c("debt_any") - c("cash_any"), "ebitda").alias("ev_ebitda") if "ebitda" in x.columns else F.lit(None).cast("double").alias("ev_ebitda"),
        *[n for n in TABLE_ITEMS if n in periods.columns], *[n for n in periods.columns if n.endswith("_src")])
