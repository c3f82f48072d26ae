"""As-of joins at a calendar grain (JN-07, 08, 09, 20) and valuation histories (WIN-16, 17).

Spark has no as-of join. Here both sides are first reduced to one row per key and calendar
bucket (month or day), merged by union and filled forward with one ordered window. The
window therefore holds at most one row per bucket of the calendar, whatever the number of
raw rows a key has; the raw probes get their value back by an equi-join, which Spark
splits when a key is skewed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S


def bucket(ts, grain: str) -> Column:
    c = S._c(ts)
    return c.cast("date") if grain == "day" else F.trunc(c, grain)


def newest_in_bucket(facts: DataFrame, keys: list[str], time: str, values: list[str], grain: str,
                     tie: list | None = None) -> DataFrame:
    """JN-11 / JN-08 helper: last non-null value of each bucket, one row per key and bucket."""
    order = F.struct(F.col(time), *(tie or []))
    return facts.groupBy(*keys, bucket(time, grain).alias("_b")).agg(
        *[F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), order)).alias(v)
          for v in values])


def asof(probes: DataFrame, facts: DataFrame, keys: list[str], probe_time: str, fact_time: str,
         values: list[str], grain: str = "month", tie: list | None = None,
         probes_unique: bool = False) -> DataFrame:
    """JN-07: each probe gets the newest non-null value at or before its bucket.

    Values are looked up independently of each other. ``probes_unique`` says that the
    probes already are one row per key and bucket, which saves the join back."""
    f = newest_in_bucket(facts, keys, fact_time, values, grain, tie)
    w = W.partitionBy(*keys).orderBy("_b", "_probe").rowsBetween(W.unboundedPreceding, 0)
    if probes_unique:
        p = probes.withColumn("_b", bucket(probe_time, grain)).withColumn("_probe", F.lit(1))
        u = p.unionByName(f.withColumn("_probe", F.lit(0)), allowMissingColumns=True)
        out = u.select(*probes.columns, "_probe", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
        return out.where(F.col("_probe") == 1).drop("_probe")
    pb = probes.select(*keys, bucket(probe_time, grain).alias("_b")).distinct().withColumn("_probe", F.lit(1))
    u = pb.unionByName(f.withColumn("_probe", F.lit(0)), allowMissingColumns=True)
    filled = u.select(*keys, "_b", "_probe", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]) \
        .where(F.col("_probe") == 1).drop("_probe")
    return (probes.withColumn("_b", bucket(probe_time, grain))
            .join(filled, [*keys, "_b"], "left").drop("_b"))


def fiscal_year_on_grid(quarters: DataFrame, years: DataFrame, keys: list[str], period: str, fy: str,
                        value: str, out: str) -> DataFrame:
    """JN-09: newest complete fiscal-year value at each quarter. A year shows from its
    December quarter on, otherwise from the following calendar year."""
    visible = F.make_date(F.col(fy).cast("int"), F.lit(12), F.lit(1))
    facts = years.select(*keys, visible.alias("_from"), F.col(value).alias(out))
    return asof(quarters, facts, keys, period, "_from", [out], grain="month", probes_unique=True)


def valuation_history(prices: DataFrame, quarters: DataFrame, years: DataFrame, baseline: DataFrame,
                      entity: str = "entity", band: float = 2.0) -> DataFrame:
    """WIN-16: per price month, multiples on the newest annual income, revenue and book value.

    ``prices``: entity, month, close (one row per month); ``quarters`` / ``years``: entity,
    period, net_income, revenue, shares, equity; ``baseline``: entity, base_shares. A share
    count outside the band around the baseline is replaced by it; months without any
    multiple are dropped."""
    y = years.select(entity, "period", F.col("net_income").alias("ni_y"), F.col("revenue").alias("rev_y"),
                     F.col("shares").alias("sh_y"), F.col("equity").alias("bv_y"))
    q = quarters.select(entity, "period", F.col("shares").alias("sh_q"), F.col("equity").alias("bv_q"))
    facts = y.unionByName(q, allowMissingColumns=True)             # one as-of pass for all six values
    x = asof(prices, facts, [entity], "month", "period", ["ni_y", "rev_y", "sh_y", "bv_y", "sh_q", "bv_q"], probes_unique=True)
    x = x.join(baseline, entity, "left")
    nz = lambda c: F.nullif(F.col(c), F.lit(0.0))
    own = F.coalesce(nz("sh_q"), F.col("sh_y"))
    base = F.col("base_shares")
    shares = F.when((own != 0) & (base != 0) & ~own.between(base / band, base * band), base).otherwise(own)
    cap = shares * F.col("close")
    out = x.select(entity, "month",
                   S.safe_div(cap, F.col("ni_y")).alias("static_pe"),
                   S.safe_div(cap, F.col("rev_y")).alias("static_ps"),
                   S.safe_div(cap, F.coalesce(nz("bv_q"), F.col("bv_y"))).alias("pb"))
    return out.where(F.coalesce("static_pe", "static_ps", "pb").isNotNull())


def quarterly_multiples(quarters: DataFrame, prices: DataFrame, baseline: DataFrame, n: int = 4,
                        entity: str = "entity", band: float = 2.0) -> DataFrame:
    """WIN-17: market cap over four times the quarter's income / free cash flow, newest n quarters.

    ``quarters``: entity, period, net_income, fcf, shares; ``prices``: entity, month, close."""
    w = W.partitionBy(entity).orderBy(F.col("period").desc())
    q = quarters.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    x = asof(q, prices, [entity], "period", "month", ["close"], probes_unique=True).join(baseline, entity, "left")
    own, base = F.col("shares"), F.col("base_shares")
    ok = F.when((own == 0) | (base.isNotNull() & (base != 0) & ~own.between(base / band, base * band)), None) \
        .otherwise(own)
    cap = F.col("close") * F.nullif(F.coalesce(ok, base), F.lit(0.0))
    return x.select(entity, "period", S.safe_div(cap, F.col("net_income") * 4).alias("pqe"),
                    S.safe_div(cap, F.col("fcf") * 4).alias("pqfcf"))
