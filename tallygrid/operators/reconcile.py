"""Cross-source reconciliation (AGG-23..25, 28, 44; TOP-03)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators.quality import severity_name, severity_rank

# Fixed values: (source, metric) pairs that are defined differently and never compared.
INCOMPARABLE = {"yfinance": ["gross_profit", "cost_of_revenue", "operating_income"]}
STALE_YEARS = 3


def spread_of(lo, hi, scale) -> Column:
    """AGG-23: relative spread from min, max and largest magnitude; all-zero values agree."""
    lo, hi, scale = map(S._c, (lo, hi, scale))
    return F.when(scale == 0, F.lit(0.0)).otherwise((hi - lo) / F.nullif(scale, F.lit(0.0)))


# Newest periods that are compared, by grid.
WINDOWS = {"annual": 6, "quarterly": 8}


def compare(facts: DataFrame, last_n: int | dict[str, int] | None = None, entity: str = "entity") -> DataFrame:
    """AGG-24: one row per grid, period and metric that at least two sources report: spread, sign
    flip, severity and the values by source. Facts: entity, grid, period, metric, source, val.
    ``last_n``: newest periods, one number or one for each grid; None takes all.

    The newest n periods are found on distinct (entity, grid, period) keys; the comparison is one
    aggregate, its map has one entry per source."""
    x = facts
    if last_n:
        w = W.partitionBy(entity, "grid").orderBy(F.col("period").desc())
        most = F.lit(last_n) if isinstance(last_n, int) else F.coalesce(*[F.when(F.col("grid") == g, F.lit(n)) for g, n in last_n.items()])
        keep = facts.select(entity, "grid", "period").distinct().withColumn("_r", F.row_number().over(w)) \
            .where(F.col("_r") <= F.coalesce(most, F.lit(2 ** 31 - 1))).drop("_r")
        x = x.join(keep, [entity, "grid", "period"], "left_semi")
    for src, metrics in INCOMPARABLE.items():
        x = x.where(~((F.col("source") == src) & F.col("metric").isin(metrics)))
    v = F.col("val")
    g = x.where(v.isNotNull()).groupBy(entity, "grid", "period", "metric").agg(
        F.count(F.lit(1)).alias("n_sources"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.max(F.abs(v)).alias("_sc"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "val")))).alias("values"))
    g = g.where(F.col("n_sources") >= 2).withColumn("spread", spread_of("_lo", "_hi", "_sc")) \
        .withColumn("sign_flip", (F.col("_hi") > 0) & (F.col("_lo") < 0))
    return g.withColumn("severity", S.spread_severity("spread", "sign_flip")).drop("_lo", "_hi", "_sc")


def compare_valuation(ours: DataFrame, published: DataFrame, entity: str = "entity") -> DataFrame:
    """AGG-25: our ratios (cap in USD, per_usd) against published ones (cap in ten-thousands of the
    local unit), in long form with spread and severity."""
    x = ours.join(published, entity)
    c = F.col
    rate = F.coalesce(F.nullif(c("per_usd"), F.lit(0.0)), F.lit(1.0))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), o.cast("double").alias("ours"), t.cast("double").alias("published"))
                      for m, o, t in [("market_cap", c("market_cap") * rate, c("total_mv") * 10000),
                                      ("ttm_pe", c("ttm_pe"), c("pub_ttm_pe")), ("static_pe", c("static_pe"), c("pub_pe")),
                                      ("pb", c("pb"), c("pub_pb"))]])
    y = x.select(entity, F.inline(pairs)).where(c("ours").isNotNull() & c("published").isNotNull())
    lo, hi = F.least("ours", "published"), F.greatest("ours", "published")
    y = y.withColumn("spread", spread_of(lo, hi, F.greatest(F.abs("ours"), F.abs("published"))))
    return y.withColumn("severity", S.spread_severity("spread", F.sign("ours") * F.sign("published") < 0))


def report(cells: DataFrame, valuation: DataFrame, entity: str = "entity") -> DataFrame:
    """AGG-28: per entity the number of compared cells, of disagreements and the worst severity."""
    u = cells.select(entity, "severity", F.lit(1).alias("_c")).unionByName(
        valuation.select(entity, "severity", F.lit(0).alias("_c")))
    return u.groupBy(entity).agg(
        F.sum("_c").alias("cells"), F.sum(F.lit(1) - F.col("_c")).alias("valuations"),
        F.count_if((F.col("_c") == 1) & (F.col("severity") != "ok")).alias("disagreements"),
        severity_name(F.max(severity_rank())).alias("worst"))


def as_issues(cells: DataFrame, valuation: DataFrame, year: int, entity: str = "entity", top: int = 5) -> DataFrame:
    """TOP-03: the five largest disagreements per entity, old ones downgraded to info, and
    valuation findings of at least warn."""
    w = W.partitionBy(entity).orderBy(F.col("spread").desc(), "grid", "period", "metric")
    best = cells.where(F.col("severity") != "ok").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
    stale = (F.lit(year) - F.substring(F.col("period").cast("string"), 1, 4).try_cast("int")) > STALE_YEARS
    a = best.select(entity, F.when(stale, "info").otherwise(F.col("severity")).alias("severity"),
                    F.lit("source_disagreement").alias("rule"),
                    F.concat_ws(" ", "metric", F.col("period").cast("string")).alias("detail"))
    b = valuation.where(F.col("severity").isin("warn", "error")).select(
        entity, "severity", F.lit("valuation_reconcile").alias("rule"), F.col("metric").alias("detail"))
    return a.unionByName(b)
