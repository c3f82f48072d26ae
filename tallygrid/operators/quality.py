"""Data-quality rules (DQ-01..17, AGG-26, 27; FLT-27; UDX-05).

The rules work on three narrow frames computed once: ``years`` (one wide row per entity and
fiscal year), ``quarters`` and ``companies`` (one row per entity with stored cap and newest
close). Each rule is a function to a frame of issues; the registry is a plain list."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S

# Thresholds of the rules.
STALE_PRICE_DAYS, STALE_FILING_DAYS = 60, 180
MIN_REVENUE, MIN_REVENUE_INCOME = 1e6, 1e7
MARGIN_RANGE = (-0.05, 1.05)
INCOME_FACTOR, MAX_SHARES, JUMP, SUM_GAP = 1.5, 100e9, 3.0, 0.05
MIN_EPS, EPS_GAP, CAP_GAP = 0.05, 0.05, 0.30
SEVERITIES = ["ok", "info", "warn", "error"]


@dataclass
class Inputs:
    companies: DataFrame      # entity, market_cap, price, price_date, price_rows
    years: DataFrame          # entity, fy, start, end, revenue, cogs, gross_profit, op_income, net_income, shares, eps, assets, equity, spike
    quarters: DataFrame       # entity, start, end, revenue, net_income
    today: Column
    thresholds: dict = None

    def t(self, name, default):
        return (self.thresholds or {}).get(name, default)


def _issues(df: DataFrame, severity, rule, detail) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("entity", lit(severity).alias("severity"), lit(rule).alias("rule"), lit(detail).alias("detail"))


PRESENCE = ["revenue", "op_income", "net_income", "shares", "assets", "equity", "gross_profit", "cogs"]


def _year_counts() -> list[Column]:
    return [F.count(c).alias(f"n_{c}") for c in PRESENCE] + [
        F.max_by(F.struct("fy", "revenue"), F.when(F.col("revenue").isNotNull(), F.col("fy"))).alias("last")]


def _presence(_inp: Inputs) -> list:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    fy, rev = F.col("last.fy").cast("string"), F.col("last.revenue")
    return [
        (zero("n_revenue"), "error", "missing_annual_revenue", "no annual revenue"),
        (rev < 0, "warn", "negative_annual_revenue", F.concat(F.lit("FY"), fy, F.lit(" revenue is negative"))),
        (rev == 0, "info", "zero_annual_revenue", F.concat(F.lit("FY"), fy, F.lit(" revenue is zero"))),
        (zero("n_net_income"), "error", "missing_annual_net_income", "no annual net income"),
        (zero("nq_ni"), "warn", "missing_quarterly_net_income", "no quarterly net income"),
        (zero("n_op_income"), "error", "missing_operating_income", "no annual operating income"),
        (zero("n_shares"), "error", "missing_diluted_shares", "no share count"),
        (zero("n_assets"), "error", "missing_total_assets", "no total assets"),
        (zero("n_equity"), "error", "missing_stockholders_equity", "no equity"),
        (zero("n_gross_profit") & zero("n_cogs"), "warn", "no_gross_profit_source", "neither gross profit nor cost")]


def _explode(df: DataFrame, findings: list) -> DataFrame:
    """One issue for each finding whose condition holds on a row."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    item = lambda cond, sev, rule, text: F.when(cond, F.struct(lit(sev).alias("severity"), lit(rule).alias("rule"), lit(text).alias("detail")))
    found = F.array(*[item(*f) for f in findings])
    return df.select("entity", F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")).select("entity", "i.*")


def presence(inp: Inputs) -> DataFrame:
    """DQ-01..06 in one pass over the years: counts per metric, then one exploded row per finding."""
    y = inp.years.groupBy("entity").agg(*_year_counts())
    q = inp.quarters.groupBy("entity").agg(F.count("net_income").alias("nq_ni"))
    return _explode(inp.companies.select("entity").join(y, "entity", "left").join(q, "entity", "left"), _presence(inp))


def _price_history(inp: Inputs):
    age = F.datediff(inp.today, F.col("price_date"))
    none = F.col("price_date").isNull()
    return (none | (age > STALE_PRICE_DAYS), F.when(none, "error").otherwise("warn"), F.when(none, "no_price_history").otherwise("stale_price"),
            F.when(none, "no dated prices").otherwise(F.concat(F.lit("latest close is "), age.cast("string"), F.lit(" days old"))))


def price_history(inp: Inputs) -> DataFrame:
    """DQ-07."""
    return _rows(inp.companies, _price_history(inp))


def _fy(text: str) -> Column:
    return F.concat(F.lit("FY"), F.col("fy").cast("string"), F.lit(f" {text}"))


# A finding on a row: condition, severity, rule, detail. Rules are stated once and run alone or together.

def _rows(df: DataFrame, finding) -> DataFrame:
    cond, severity, rule, detail = finding
    return _issues(df.where(cond), severity, rule, detail)


def _gross_margin(inp: Inputs):
    gp = F.coalesce(F.col("gross_profit"), F.col("revenue") - F.col("cogs"))
    gm = S.safe_div(gp, F.col("revenue"))
    return ((F.abs("revenue") >= inp.t("min_revenue", MIN_REVENUE)) & ((gm < MARGIN_RANGE[0]) | (gm > MARGIN_RANGE[1])),
            "warn", "gross_margin_out_of_range", _fy("gross margin outside its range"))


def _income_size(inp: Inputs):
    return ((F.abs("revenue") >= inp.t("min_revenue_income", MIN_REVENUE_INCOME)) & (F.abs("net_income") > F.abs("revenue") * inp.t("income_factor", INCOME_FACTOR)),
            "warn", "ni_exceeds_revenue", _fy("net income exceeds revenue"))


def _share_range(inp: Inputs):
    return ((F.col("shares") <= 0) | (F.col("shares") > inp.t("max_shares", MAX_SHARES)), "warn", "shares_out_of_range", _fy("share count out of range"))


def _eps_match(_inp: Inputs):
    gap = S.safe_div(S.safe_div("net_income", "shares") - F.col("eps"), F.abs("eps"))
    return (F.abs("eps") >= MIN_EPS) & (F.abs(gap) > EPS_GAP), "info", "eps_mismatch", _fy("EPS differs from income per share")


def gross_margin(inp: Inputs) -> DataFrame:
    """DQ-08."""
    return _rows(inp.years, _gross_margin(inp))


def income_size(inp: Inputs) -> DataFrame:
    """DQ-09."""
    return _rows(inp.years, _income_size(inp))


def share_range(inp: Inputs) -> DataFrame:
    """DQ-10."""
    return _rows(inp.years, _share_range(inp))


def _newest_quarter() -> Column:
    return F.max(F.when(F.col("revenue").isNotNull(), F.col("end"))).alias("q_end")


def _filing_age(inp: Inputs):
    age = F.datediff(inp.today, F.col("q_end"))
    return age > STALE_FILING_DAYS, "warn", "stale_filings", F.concat(F.lit("latest quarter is "), age.cast("string"), F.lit(" days old"))


def filing_age(inp: Inputs) -> DataFrame:
    """DQ-11."""
    return _rows(inp.quarters.groupBy("entity").agg(_newest_quarter()), _filing_age(inp))


def with_previous(years: DataFrame) -> DataFrame:
    """Adds the previous year on file with revenue: _p (revenue), _py (year), _ps (spike). The window holds one row per
    fiscal year."""
    w = W.partitionBy("entity").orderBy("fy").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("revenue").isNotNull(), F.struct("revenue", "fy", "spike")), True).over(w)
    return years.withColumn("_l", last).select("*", F.col("_l.revenue").alias("_p"), F.col("_l.fy").alias("_py"), F.col("_l.spike").alias("_ps")).drop("_l")


def _revenue_jump(inp: Inputs):
    floor = inp.t("min_revenue", MIN_REVENUE)
    r = S.safe_div("revenue", "_p")
    hit = ((F.abs("revenue") >= floor) & (F.abs("_p") >= floor) & ~F.col("spike") & ~F.col("_ps")
           & (F.col("revenue") != 0) & ((r > JUMP) | (r < 1 / JUMP)))
    return hit, "warn", "yoy_revenue_jump", F.concat(F.lit("FY"), F.col("_py").cast("string"), F.lit(" to FY"), F.col("fy").cast("string"))


def revenue_jump(inp: Inputs) -> DataFrame:
    """DQ-12 / WIN-23: adjacent years on file."""
    return _rows(with_previous(inp.years), _revenue_jump(inp))


def contained_quarters(years: DataFrame, quarters: DataFrame) -> DataFrame:
    """JN-12: quarters inside each fiscal year [start, end]: count and sum. The containment test is
    attached to an equality on the entity, so it stays a hash or merge join."""
    a = years.select("entity", "fy", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("revenue").alias("annual"))
    q = quarters.where(F.col("revenue").isNotNull()).select("entity", F.col("start").alias("_qs"), F.col("end").alias("_qe"),
                                                           F.col("revenue").alias("_qv"))
    return a.join(q, "entity").where((F.col("_qs") >= F.col("_s")) & (F.col("_qe") <= F.col("_e"))) \
        .groupBy("entity", "fy", "annual").agg(F.count("_qv").alias("n"), F.sum("_qv").alias("q_sum"))


def _quarter_sum(_inp: Inputs):
    gap = S.safe_div(F.col("q_sum") - F.col("revenue"), F.col("revenue"))
    return (F.col("n_q") == 4) & (F.col("revenue") != 0) & (F.abs(gap) > SUM_GAP), "warn", "q_sum_vs_annual", _fy("quarters do not add up")


def with_quarter_sums(years: DataFrame, quarters: DataFrame) -> DataFrame:
    """Adds the number and sum of the quarters inside each fiscal year: n_q, q_sum."""
    sums = contained_quarters(years.where(F.col("revenue") != 0), quarters).select("entity", "fy", F.col("n").alias("n_q"), "q_sum")
    return years.join(sums, ["entity", "fy"], "left")


def quarter_sum(inp: Inputs) -> DataFrame:
    """DQ-13."""
    return _rows(with_quarter_sums(inp.years, inp.quarters), _quarter_sum(inp))


def eps_match(inp: Inputs) -> DataFrame:
    """DQ-14."""
    return _rows(inp.years, _eps_match(inp))


def _cap_match(_inp: Inputs):
    gap = S.safe_div(F.col("price") * F.col("_sh") - F.col("market_cap"), F.col("market_cap"))
    return (F.col("_sh") != 0) & (F.abs(gap) > CAP_GAP), "info", "mcap_reconciliation", F.lit("stored cap differs")


def _newest_shares() -> Column:
    return F.max_by("shares", F.when(F.col("shares").isNotNull(), F.col("fy"))).alias("_sh")


def cap_match(inp: Inputs) -> DataFrame:
    """DQ-15: stored cap against newest close x share count of the newest year on file."""
    return _rows(inp.companies.join(inp.years.groupBy("entity").agg(_newest_shares()), "entity"), _cap_match(inp))


# UDX-05 / DQ-16: the registry; the second item says that the rule needs filed statements.
RULES: list[tuple[Callable[[Inputs], DataFrame], bool]] = [
    (presence, True), (price_history, False), (gross_margin, True), (income_size, True), (share_range, True),
    (filing_age, True), (revenue_jump, True), (quarter_sum, True), (eps_match, True), (cap_match, True)]


def all_rules(inp: Inputs, filed_only: DataFrame | None = None) -> DataFrame:
    """DQ-16: the registry's rules in two passes. Each company row, joined with the counts of its years and quarters,
    and each year row, with the year before and its quarters, carries an array of findings."""
    y = inp.years.groupBy("entity").agg(*_year_counts(), _newest_shares())
    q = inp.quarters.groupBy("entity").agg(F.count("net_income").alias("nq_ni"), _newest_quarter())
    company = inp.companies.join(y, "entity", "left").join(q, "entity", "left")
    year = with_quarter_sums(with_previous(inp.years), inp.quarters)
    filed = [*_presence(inp), _filing_age(inp), _cap_match(inp)]
    if filed_only is not None:
        mark = filed_only.select("entity").distinct().withColumn("_filed", F.lit(True))
        company = company.join(mark, "entity", "left")
        year = year.join(mark.select("entity"), "entity", "left_semi")
        filed = [(F.coalesce("_filed", F.lit(False)) & cond, *rest) for cond, *rest in filed]
    on_year = [f(inp) for f in (_gross_margin, _income_size, _share_range, _revenue_jump, _quarter_sum, _eps_match)]
    return _explode(company, [*filed, _price_history(inp)]).unionByName(_explode(year, on_year))


def run_rules(inp: Inputs, rules=None, filed_only: DataFrame | None = None) -> DataFrame:
    """DQ-16: the registry, or a union of the given rules. ``filed_only`` (entity) restricts rules that need filed
    statements to entities that file; the others see everyone."""
    if rules is None:
        return all_rules(inp, filed_only)
    out = []
    for rule, needs_filing in rules:
        df = rule(inp)
        if needs_filing and filed_only is not None:
            df = df.join(filed_only.select("entity"), "entity", "left_semi")
        out.append(df)
    return reduce(DataFrame.unionByName, out)


def severity_rank(sev="severity") -> Column:
    s = S._c(sev)
    return F.when(s == "error", 3).when(s == "warn", 2).when(s == "info", 1).otherwise(0)


def severity_name(rank) -> Column:
    r = S._c(rank)
    return F.when(r == 3, "error").when(r == 2, "warn").when(r == 1, "info").otherwise("ok")


def worst(issues: DataFrame, entities: DataFrame, entity: str = "entity") -> DataFrame:
    """AGG-26: worst severity per entity; ok without issues."""
    w = issues.groupBy(entity).agg(F.max(severity_rank()).alias("_r"))
    return entities.select(entity).join(w, entity, "left").select(
        entity, severity_name(F.coalesce("_r", F.lit(0))).alias("status"))


def status_counts(status: DataFrame) -> DataFrame:
    """AGG-27."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def visible_issues(issues: DataFrame, status: DataFrame, entity: str = "entity", limit: int | None = None) -> DataFrame:
    """FLT-27: non-info issues of entities in warn or error; optionally the first n (by rule and
    detail) per entity."""
    x = issues.join(status.where(F.col("status").isin("warn", "error")).select(entity), entity, "left_semi") \
        .where(F.col("severity") != "info")
    if limit:
        w = W.partitionBy(entity).orderBy("rule", "detail")
        x = x.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
    return x


def strict_entities(entities: DataFrame, status: DataFrame, entity: str = "entity") -> DataFrame:
    """FLT-27 strict mode: entities without an error status."""
    return entities.join(status.where(F.col("status") == "error").select(entity), entity, "left_anti")
