"""Whole-table jobs that chain the operators: blended facts, A-share and release source rows, and
the served snapshot (KPI-02, 05, 11, 12, 14; RM-04, 09)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.operators import blend as L
from tallygrid.operators import extract as X
from tallygrid.operators import fx as FX
from tallygrid.operators import shares as H
from tallygrid.session import small_side
from tallygrid.sources import mappings as M


def blended_quarters(primary: DataFrame, secondary: DataFrame, last_n: int | None = None) -> DataFrame:
    """KPI-05, quarterly: snap secondary periods onto nearby primary ones, then merge cell by cell.
    Facts: entity, metric, period (date), val, partial (primary), source (secondary).

    When two secondary periods of one metric end up on the same date, the one that was moved gives
    way to the exact one."""
    to = L.align_periods(primary, secondary)
    s = secondary.join(to, ["entity", "period"])
    moved = (F.col("aligned") != F.col("period")).alias("moved")
    s = s.groupBy("entity", "metric", F.col("aligned").alias("period")).agg(
        F.min_by(F.struct("val", "source"), F.struct(moved, "period")).alias("b")).select("entity", "metric", "period", "b.*")
    out = L.merge_cells(primary, s, ["entity", "metric", "period"])
    if last_n:
        keep = out.select("entity", "period").distinct().withColumn("_r", L.period_rank_rows(["entity"])).where(F.col("_r") <= last_n)
        out = out.join(keep.drop("_r"), ["entity", "period"], "left_semi")
    return out


def blended_years(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """KPI-05, annual: periods are fiscal years, merged as they are, ADS counts normalised first."""
    counts = lambda df: df.where("metric = 'diluted_shares'").select("entity", F.col("period").alias("fy"), F.col("val").alias("shares"))
    p = H.ads_normalise(primary, H.ads_ratio(counts(primary), counts(secondary))).drop("ads_ratio")
    return L.merge_cells(p, secondary, ["entity", "metric", "period"])


def source_facts(raw: DataFrame, fields: dict[str, dict[str, list[str]]], source: str, by_restatement: bool = True) -> DataFrame:
    """KPI-11 / KPI-12: annual and quarterly facts of one A-share source.

    ``raw`` is long: entity, stmt ('income' | 'balance' | 'cashflow' | 'income_q' | 'cashflow_q'),
    end (date), ann (announcement key), field, val. Steps: newest announcement per cell, fields to
    metrics by priority, year-to-date flows differenced where the single-quarter statement lacks a
    quarter, outflows negated, gross profit derived. Result: entity, grid, metric, period, val,
    source."""
    keys = ["entity", "stmt", "end", "field"]
    newest = F.max_by("val", "ann") if by_restatement else F.min_by("val", "ann")
    cells = raw.where(F.col("val").isNotNull()).groupBy(*keys).agg(newest.alias("val"))
    dim = [(stmt, m, f, i, -1.0 if m in M.NEGATED else 1.0) for stmt, tab in fields.items() for m, fs in tab.items() for i, f in enumerate(fs)]
    d = raw.sparkSession.createDataFrame(dim, "kind string, metric string, field string, rank int, sign double")
    x = cells.withColumn("kind", F.regexp_replace("stmt", "_q$", "")).join(small_side(d), ["kind", "field"])
    x = x.groupBy("entity", "kind", "stmt", "end", "metric").agg(F.min_by(F.col("val") * F.col("sign"), "rank").alias("val"))
    year_end = (F.month("end") == 12) & (F.dayofmonth("end") == 31)
    annual = x.where(~F.col("stmt").endswith("_q") & year_end).select(
        "entity", F.lit("annual").alias("grid"), "metric", F.year("end").cast("string").alias("period"), "val")
    q = x.withColumn("y", F.year("end")).withColumn("q", F.quarter("end"))
    k = ["entity", "kind", "metric"]
    flows = X.statement_quarters(q.where(F.col("stmt").endswith("_q")), q.where(~F.col("stmt").endswith("_q") & (F.col("kind") != "balance")),
                                 k, "y", "q", ["val"]).where(F.col("val").isNotNull())
    end = F.last_day(F.make_date(F.col("y"), F.col("q") * 3, F.lit(1))).cast("string").alias("period")
    quarterly = flows.select("entity", F.lit("quarterly").alias("grid"), "metric", end, "val").unionByName(
        q.where("kind = 'balance'").select("entity", F.lit("quarterly").alias("grid"), "metric", F.col("end").cast("string").alias("period"), "val"))
    facts = annual.unionByName(quarterly)
    gp = L.key_difference(facts, ["entity", "grid", "period"], "revenue", "cost_of_revenue", "gross_profit")
    return facts.unionByName(gp.select(*facts.columns)).withColumn("source", F.lit(source))


def release_facts(standard: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """KPI-14: release metrics, gaps filled from the classified balance-sheet lines. ``standard``:
    keys, metric, val; ``lines``: keys, pos, label, value."""
    derived = L.asset_lines(lines, keys)
    return standard.where(F.col("val").isNotNull()).unionByName(
        derived.join(standard.where(F.col("val").isNotNull()).select(*keys, "metric"), [*keys, "metric"], "left_anti").select(*standard.columns))


def served_facts(facts: DataFrame, fx: DataFrame, order: list[str] = L.SOURCE_ORDER) -> DataFrame:
    """KPI-02, first half: the winning cell of each metric and period over all sources, in USD.
    Facts: entity, metric, period, val, source, ccy (cell tag), source_ccy."""
    best = L.by_precedence(facts, ["entity", "metric", "period"], order)
    tags = facts.groupBy("entity", "metric", "period", "source").agg(F.max("ccy").alias("ccy"), F.max("source_ccy").alias("source_ccy"))
    return FX.cells_to_usd(best.join(tags, ["entity", "metric", "period", "source"]), fx)


def wide_periods(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """Long facts to one wide row per entity and period; the metric names are given."""
    return facts.groupBy("entity", "period").pivot("metric", metrics).agg(F.max("val"))


def index_rows(analyzed: DataFrame, snapshot: DataFrame, columns: list[str], key: str = "entity") -> DataFrame:
    """RM-09: identity and chosen ratios of every analyzed entity that has statements."""
    return analyzed.join(snapshot.select(key, *columns), key)


def company_detail(rows: DataFrame, quarters: DataFrame, years: DataFrame, currency: Column, key: str = "entity") -> DataFrame:
    """RM-04: ticker row with currency and the number of quarters and years on file."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    x = rows.join(n(quarters, "quarters"), key, "left").join(n(years, "years"), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return x.withColumn("currency", currency).withColumn("quarters", zero("quarters")).withColumn("years", zero("years"))


# Statement column -> metric of the label table.
STATEMENT_METRICS = {
    "revenue": "revenue", "cogs": "cost_of_revenue", "gross_profit": "gross_profit", "op_income": "operating_income", "net_income": "net_income",
    "rd": "rd_expense", "sm": "selling_marketing_expense", "ga": "general_admin_expense", "sga": "sga_expense", "ocf": "operating_cf", "capex": "capex",
    "dividends": "cash_dividends_paid", "cash": "cash", "sti": "short_term_investments", "assets": "total_assets", "equity": "stockholders_equity",
    "lt_debt": "long_term_debt", "st_debt": "short_term_debt", "shares": "diluted_shares"}


def labelled(df: DataFrame, grid: str, key: str = "entity") -> DataFrame:
    """FLT-23: long statement rows under the display labels: key, grid, period, item, val."""
    cols = [c for c in STATEMENT_METRICS if c in df.columns]
    named = df.select(key, "period", *[F.col(c).alias(M.METRIC_LABELS[STATEMENT_METRICS[c]]) for c in cols])
    return named.unpivot([key, "period"], named.columns[2:], "item", "val").where(F.col("val").isNotNull()).select(key, F.lit(grid).alias("grid"), "period", "item", "val")


def statement_lists(years: DataFrame, quarters: DataFrame, key: str = "entity") -> DataFrame:
    """The long rows of ``labelled`` in one array per company, newest first: statements are exchanged as wide rows and turned into long ones inside the array."""
    cols = [c for c in STATEMENT_METRICS if c in years.columns and c in quarters.columns]
    wide = lambda df, grid: df.select(key, F.struct(F.lit(grid).alias("grid"), "period", *cols).alias("s"))
    cells = lambda s: F.array(*[F.struct(s["grid"].alias("grid"), s["period"].alias("period"), F.lit(M.METRIC_LABELS[STATEMENT_METRICS[c]]).alias("item"), s[c].alias("val")) for c in cols])
    x = wide(years, "annual").unionByName(wide(quarters, "quarterly")).groupBy(key).agg(F.collect_list("s").alias("s"))
    x = x.select(key, F.reverse(F.sort_array(F.flatten(F.transform("s", lambda s: F.filter(cells(s), lambda c: c["val"].isNotNull()))))).alias("statements"))
    return x.where(F.size("statements") > 0)


def company_page(rows: DataFrame, quarters: DataFrame, years: DataFrame, issues: DataFrame, quotes: DataFrame, key: str = "entity") -> DataFrame:
    """RM-04: one row per company: identity and ratios, statements (annual and quarterly, newest first), validation
    issues, quote currency with its rate. The arrays are bounded by the calendar and the rules."""
    s = statement_lists(years, quarters, key)
    i = issues.groupBy(key, "severity", "rule").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("severity", "rule", "n"))).alias("issues"))
    return rows.join(s, key, "left").join(i, key, "left").join(quotes, key, "left")
