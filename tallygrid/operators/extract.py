"""From filed records to one value per metric and period (FLT-03..08, WIN-05..10, KPI-11..15).

Long filed facts: entity, concept, unit, start, end (DATE), val, form, filed (DATE), fy, fp."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.session import small_side
from tallygrid.sources import mappings as M

# Day spans of an annual period, of a quarter, of year-to-date periods, and
# the form families.
ANNUAL_DAYS = (350, 380)
QUARTER_DAYS = (80, 100)
YTD_DAYS = [(80, 100), (170, 190), (260, 280), (350, 380)]
ANNUAL_FORMS = ["10-K", "20-F", "40-F"]
QUARTERLY_FORMS = ["10-Q", "10-K", "20-F", "40-F", "6-K"]


def span_days(start="start", end="end") -> Column:
    return F.datediff(S._c(end), S._c(start))


def is_annual() -> Column:
    """FLT-03."""
    return F.coalesce(span_days().between(*ANNUAL_DAYS), F.lit(False))


def is_quarter() -> Column:
    """FLT-04."""
    return F.coalesce(span_days().between(*QUARTER_DAYS), F.lit(False))


def is_instant() -> Column:
    """FLT-05."""
    return F.col("start").isNull() & F.col("end").isNotNull()


def is_ytd() -> Column:
    """FLT-06."""
    d = span_days()
    out = d.between(*YTD_DAYS[0])
    for lo_hi in YTD_DAYS[1:]:
        out = out | d.between(*lo_hi)
    return F.coalesce(out, F.lit(False))


def form_in(forms: list[str], form="form") -> Column:
    """FLT-07: family prefix match."""
    return S._c(form).rlike("^(" + "|".join(forms) + ")")


def is_money_unit(unit="unit") -> Column:
    """FLT-08: a three-letter currency unit."""
    u = S._c(unit)
    return (F.length(u) == 3) & ~u.isin("shares", "pure") & ~u.contains("/")


def money_units(facts: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-08: currency units per key, USD where none is tagged."""
    have = facts.where(is_money_unit()).select(*keys, "unit").distinct()
    none = facts.select(*keys).distinct().join(have.select(*keys).distinct(), keys, "left_anti")
    return have.unionByName(none.withColumn("unit", F.lit("USD")))


def pick_filed(facts: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-05..07: one record per key: concept priority, then latest filing, then larger value.

    Written as max_by, so the many restatements of a hot entity are combined before the
    shuffle instead of being ranked in one window."""
    cols = [c for c in facts.columns if c not in keys]
    best = facts.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct(-F.col("rank"), F.coalesce("filed", F.lit("0001-01-01").cast("date")), "val")).alias("b"))
    return best.select(*keys, "b.*")


def annual_values(facts: DataFrame, keys=("entity", "metric", "unit"), instants: bool = False) -> DataFrame:
    """WIN-05: per fiscal year."""
    keep = (is_instant() if instants else is_annual()) & form_in(ANNUAL_FORMS)
    return pick_filed(facts.where(keep).withColumn("fiscal", S.fiscal_year("end")), [*keys, "fiscal"])


def quarterly_values(facts: DataFrame, keys=("entity", "metric", "unit")) -> DataFrame:
    """WIN-06: per quarter end."""
    return pick_filed(facts.where(is_quarter() & form_in(QUARTERLY_FORMS)), [*keys, "end"])


def instant_values(facts: DataFrame, keys=("entity", "metric", "unit")) -> DataFrame:
    """WIN-07: point-in-time values per date."""
    return pick_filed(facts.where(is_instant() & form_in(QUARTERLY_FORMS)), [*keys, "end"])


def quarters_from_ytd(facts: DataFrame, keys=("entity", "metric", "unit")) -> DataFrame:
    """WIN-08: quarters from year-to-date filings.

    Amendments are reduced to the latest filing per (start, end); inside one fiscal start
    each value is reduced by its predecessor; a chain counts only when it opens with a
    quarter-long period. Where several starts reach the same end, the latest start wins."""
    k = list(keys)
    best = facts.where(is_ytd() & form_in(QUARTERLY_FORMS)).groupBy(*k, "start", "end").agg(
        F.max_by(F.struct("val", "filed", "concept"), F.struct("filed", -F.col("rank"), "val")).alias("b")) \
        .select(*k, "start", "end", "b.*")
    w = W.partitionBy(*k, "start").orderBy("end")           # at most a handful of ends per fiscal start
    x = (best.withColumn("_first", F.first(span_days()).over(w))
         .withColumn("val", F.col("val") - F.coalesce(F.lag("val").over(w), F.lit(0.0)))
         .withColumn("from_ytd", span_days() > QUARTER_DAYS[1])
         .withColumn("_prev_end", F.lag("end").over(w)))
    x = x.where(F.col("_first").between(*QUARTER_DAYS))
    out = x.groupBy(*k, "end").agg(F.max_by(F.struct(
        "val", F.coalesce("_prev_end", "start").alias("start"), "filed", "concept", "from_ytd"), "start").alias("b"))
    return out.select(*k, "end", "b.*")


def quarters_from_ytd_strict(rows: DataFrame, keys: list[str], year: str, quarter: str, values: list[str]) -> DataFrame:
    """WIN-09: differencing that requires the adjacent calendar quarter; otherwise the cell is
    dropped. Q1 passes through."""
    w = W.partitionBy(*keys, year).orderBy(quarter)          # four rows per year
    adj = F.lag(quarter).over(w) == F.col(quarter) - 1
    out = rows
    for v in values:
        prev = F.when(adj, F.lag(v).over(w))
        out = out.withColumn(f"_{v}", F.when(F.col(quarter) == 1, F.col(v)).otherwise(F.col(v) - prev))
    return out.select(*keys, year, quarter, *[F.col(f"_{v}").alias(v) for v in values])


def merge_units(values: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-10: one unit per key: a native currency beats USD, then by unit name; tags ccy."""
    cols = [c for c in values.columns if c not in keys and c != "unit"]
    best = values.groupBy(*keys).agg(
        F.min_by(F.struct(*cols, F.col("unit").alias("ccy")), F.struct((F.col("unit") == "USD").alias("u"), "unit")).alias("b"))
    return best.select(*keys, "b.*")


# --- whole source rows -------------------------------------------------------------------------------

def filing_metrics(facts: DataFrame, grid: str = "annual") -> DataFrame:
    """KPI-15: every metric of one grid from filed facts: entity, metric, period, val, ccy,
    concept, partial. The concept dimension is broadcast.

    Plain metrics and composites run through one chain: best record per unit (combined before the
    shuffle), one unit per period, one concept per component group, total or sum. After the
    first step the rows are exchanged once by (entity, metric, period), which serves all
    later steps."""
    dim = M.concept_dimension(facts.sparkSession)
    x = facts.join(small_side(dim), "concept")
    unit_ok = (F.when(F.col("kind") == "shares", F.col("unit") == "shares")
               .when(F.col("kind") == "per_share", F.col("unit").endswith("/shares")).otherwise(is_money_unit()))
    x = x.where(unit_ok).withColumn("unit", F.regexp_replace("unit", "/shares$", "")) \
        .withColumn("part", F.when(F.col("composite"), F.col("concept")).otherwise(""))
    stock = F.col("kind") == "stock"
    k = ["entity", "metric", "grp", "part", "unit", "period"]
    cols = [*k, "val", "concept", "rank", "composite"]
    if grid == "annual":
        keep = F.when(stock, is_instant()).otherwise(is_annual()) & form_in(ANNUAL_FORMS)
        best = pick_filed(x.where(keep).withColumn("period", S.fiscal_year("end")), k).select(*cols)
    else:
        keep = F.when(stock, is_instant()).otherwise(is_quarter()) & form_in(QUARTERLY_FORMS)
        flow = F.col("kind") == "cash_flow"
        best = pick_filed(x.where(keep & ~flow).withColumn("period", F.col("end")), k).select(*cols)
        ytd = quarters_from_ytd(x.where(flow), k[:-1]).withColumnRenamed("end", "period")
        best = best.unionByName(ytd.select(*k, "val", "concept", F.lit(0).alias("rank"), F.lit(False).alias("composite")))
    best = best.repartition("entity", "metric", "period")
    one = merge_units(best, ["entity", "metric", "period", "grp", "part"])
    grp = one.groupBy("entity", "metric", "period", "grp").agg(
        F.min_by(F.struct("concept", "val", "composite"), F.struct((F.col("composite") & (F.col("val") == 0)).alias("z"), "rank")).alias("b"),
        F.min("ccy").alias("ccy")).select("entity", "metric", "period", "grp", "b.*", "ccy")
    tot = F.col("grp") == 0
    parts = F.transform(F.sort_array(F.collect_list(F.struct("grp", "concept"))), lambda g: g["concept"])      # one per component group
    m = grp.groupBy("entity", "metric", "period").agg(
        F.coalesce(F.max(F.when(tot, F.col("val"))), F.sum("val")).alias("val"),
        F.coalesce(F.max(F.when(tot, F.col("concept"))), F.concat(F.lit("sum("), F.array_join(parts, "+"), F.lit(")"))).alias("concept"),
        F.min("ccy").alias("ccy"), F.bool_or("composite").alias("composite"))
    authoritative = [n for n, spec in M.COMPOSITES.items() if spec.get("authoritative")]
    partial = F.when(F.col("composite"), ~F.col("metric").isin(authoritative)).otherwise(F.col("metric").isin(M.PARTIAL_METRICS))
    return rescale_counts(m.withColumn("partial", partial).drop("composite"))


def rescale_counts(values: DataFrame) -> DataFrame:
    """SCL-07 on long facts: share counts filed in thousands."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("val")))
    ref = values.where(F.col("metric").isin("net_income", "diluted_eps")).groupBy("entity", "period").agg(
        pick("net_income").alias("_ni"), pick("diluted_eps").alias("_eps"))
    x = values.join(ref, ["entity", "period"], "left")
    fixed = S.rescale_thousands("val", "_ni", "_eps")
    return x.withColumn("val", F.when(F.col("metric") == "diluted_shares", fixed).otherwise(F.col("val"))) \
        .drop("_ni", "_eps")


def label_values(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-22 / KPI-13: first non-null label per metric and period, with the label that won.
    ``rows``: keys, label, val."""
    x = rows.where(F.col("val").isNotNull() & ~F.isnan("val")).join(small_side(labels), "label")
    best = x.groupBy(*keys, "metric").agg(
        F.min_by(F.struct((F.col("val") * F.col("sign")).alias("val"), F.col("label").alias("concept")), "rank").alias("b"))
    return best.select(*keys, "metric", "b.*")


def statement_quarters(single: DataFrame, ytd: DataFrame, keys: list[str], year: str, quarter: str,
                       values: list[str]) -> DataFrame:
    """KPI-11: single-quarter rows, filled by differenced year-to-date rows for quarters that the
    single-quarter series lacks."""
    d = quarters_from_ytd_strict(ytd, keys, year, quarter, values)
    k = [*keys, year, quarter]
    return single.select(*k, *values).unionByName(d.join(single.select(*k), k, "left_anti").select(*k, *values))


def release_metrics(releases: DataFrame) -> DataFrame:
    """KPI-14: quarterly metrics of results releases: entity, period_type, period_end,
    cash_flow_period_type, metric, val; standard fields only, cash-flow lines only with a three-month column."""
    releases = releases.where(F.col("metric").isin(M.RELEASE_FIELDS))
    keep = (F.col("period_type") == "quarter") & F.col("period_end").isNotNull() & F.col("val").isNotNull()
    cash = ~F.col("metric").isin(M.RELEASE_CASH_FLOW) | (F.col("cash_flow_period_type") == "quarter")
    name = F.col("metric")
    for k, v in M.RELEASE_RENAMES.items():
        name = F.when(F.col("metric") == k, v).otherwise(name)
    return releases.where(keep & F.coalesce(cash, F.lit(False))).withColumn("metric", name) \
        .withColumn("source", F.lit("6k"))


def dividend_cash(dividends: DataFrame, shares: DataFrame, entity: str = "entity") -> DataFrame:
    """AGG-13: cash paid per quarter, negative: executed per-share amounts x the count reported at
    or before the payment. ``dividends``: entity, pay_date, per_share, executed; ``shares``:
    entity, end, shares."""
    from tallygrid.operators.asof import asof
    d = dividends.where(F.col("executed") & (F.col("per_share") != 0) & F.col("pay_date").isNotNull())
    x = asof(d, shares.where(F.col("shares") != 0), [entity], "pay_date", "end", ["shares"], grain="day")
    return x.where(F.col("shares").isNotNull()).groupBy(entity, S.quarter_end("pay_date").alias("quarter")) \
        .agg((-F.sum(F.col("per_share") * F.col("shares"))).alias("cash_dividends_paid"))
