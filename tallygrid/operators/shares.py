"""Robust share counts and ADS ratios (AGG-03..07, 19, 20)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S

# How many newest counts are judged, the band around their median, the band
# around an independent anchor, and the anchor band of the metric grid.
SHARE_WINDOW = 6
MEDIAN_BAND = 2.0
ANCHOR_BAND = 3.0
GRID_BAND = 3.0


def latest_close(prices: DataFrame, entity: str = "entity", time: str = "month") -> DataFrame:
    """AGG-03: newest non-null close per entity."""
    return prices.where(F.col("close").isNotNull()).groupBy(entity).agg(F.max_by("close", time).alias("price"))


def implied_shares(caps: DataFrame, prices: DataFrame, entity: str = "entity", time: str = "month") -> DataFrame:
    """AGG-06: stored cap over the USD price; ``caps`` has entity, market_cap, price_fx."""
    x = caps.join(latest_close(prices, entity, time), entity, "left")
    fx = F.coalesce(F.nullif(F.col("price_fx"), F.lit(0.0)), F.lit(1.0))
    ok = (F.col("market_cap") != 0) & (F.col("price") != 0)
    return x.select(entity, F.when(ok, S.safe_div(F.col("market_cap"), F.col("price") / fx)).alias("anchor"))


def recent_counts(quarters: DataFrame, entity: str = "entity", window: int = SHARE_WINDOW) -> DataFrame:
    """The newest non-zero counts of each entity, at most ``window`` (group limit before the shuffle)."""
    w = W.partitionBy(entity).orderBy(F.col("period").desc())
    return (quarters.where(F.col("shares").isNotNull() & (F.col("shares") != 0)).select(entity, "period", "shares")
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window))


def reliable_shares(quarters: DataFrame, anchors: DataFrame | None = None, entity: str = "entity") -> DataFrame:
    """AGG-05: share count to value an entity on.

    With an anchor: newest recent count within 3x of it, else the anchor. Without: newest
    recent count within 2x of the recent median, else that median. The at most six recent
    counts travel as one small array, so no second pass over the facts is needed."""
    arr = recent_counts(quarters, entity).groupBy(entity).agg(
        F.sort_array(F.collect_list(F.struct("period", "shares")), asc=False).alias("_r"),
        F.median("shares").alias("_med"))
    if anchors is None:
        x = arr.withColumn("anchor", F.lit(None).cast("double"))
    else:
        x = arr.join(anchors.select(entity, "anchor"), entity, "full_outer")
    a, m = F.nullif(F.col("anchor"), F.lit(0.0)), F.col("_med")
    newest_in = lambda lo, hi: F.get(F.filter("_r", lambda r: r["shares"].between(lo, hi)), F.lit(0))["shares"]
    picked = (F.when(a.isNotNull(), F.coalesce(newest_in(a / ANCHOR_BAND, a * ANCHOR_BAND), a))
              .when(m == 0, F.get(F.col("_r"), F.lit(0))["shares"])
              .otherwise(F.coalesce(newest_in(m / MEDIAN_BAND, m * MEDIAN_BAND), m)))
    return x.select(entity, picked.alias("base_shares"))


def recomputed_cap(prices: DataFrame, base: DataFrame, entity: str = "entity", time: str = "month") -> DataFrame:
    """AGG-07: newest close x reliable count."""
    return base.join(latest_close(prices, entity, time), entity, "left") \
        .select(entity, (F.col("price") * F.col("base_shares")).alias("market_cap"))


def ads_ratio(primary: DataFrame, secondary: DataFrame, entity: str = "entity") -> DataFrame:
    """AGG-19: ordinary shares per ADS, from years both sources report (entity, fy, shares).

    The upper median of the ratios is snapped to an integer 2..100 or to 1/2..1/20, and
    kept when it is within 15 percent and every ratio within 25 percent of it."""
    p = primary.where(F.col("shares") > 0).select(entity, "fy", F.col("shares").alias("_a"))
    s = secondary.where(F.col("shares") > 0).select(entity, "fy", F.col("shares").alias("_b"))
    r = p.join(s, [entity, "fy"]).groupBy(entity).agg(
        F.sort_array(F.collect_list(F.col("_a") / F.col("_b"))).alias("_r"))       # one value per fiscal year
    # the nearest candidate is worked out once per entity, behind the aggregate, from three numbers of the ratios
    x = r.select(entity, F.get("_r", F.floor(F.size("_r") / 2).cast("int")).alias("_med"), F.array_min("_r").alias("_lo"), F.array_max("_r").alias("_hi"))
    # the relative distance falls up to the median and rises after it, so only the neighbours of
    # the median among the integers and among the unit fractions can be nearest
    med = F.col("_med")
    clip = lambda v, hi: F.greatest(F.lit(2.0), F.least(F.lit(float(hi)), v.cast("double")))
    near = [(clip(f(med), 100), False) for f in (F.floor, F.ceil)] + [(clip(f(1 / med), 20), True) for f in (F.floor, F.ceil)]
    cand = [(F.lit(1.0) / k if inv else k, k + 100 if inv else k) for k, inv in near]
    best = F.least(*[F.struct((F.abs(med - c) / c).alias("d"), n.alias("n"), c.alias("c")) for c, n in cand])["c"]
    # an inline of a one-element array keeps Catalyst from copying the expression into the filter
    x = x.select(entity, "_med", "_lo", "_hi", F.explode(F.array(best)).alias("ads_ratio"))
    t = F.col("ads_ratio")
    far = lambda v: F.abs(F.col(v) - t) / t
    return x.where((far("_med") <= 0.15) & (far("_lo") <= 0.25) & (far("_hi") <= 0.25)).select(entity, "ads_ratio")


def ads_normalise(facts: DataFrame, ratios: DataFrame, entity: str = "entity") -> DataFrame:
    """AGG-20: long facts (entity, metric, val) with counts divided and per-share values
    multiplied by the entity's ratio."""
    r = F.col("ads_ratio")
    val = (F.when(r.isNotNull() & (F.col("metric") == "diluted_shares"), F.col("val") / r)
           .when(r.isNotNull() & (F.col("metric") == "diluted_eps"), F.col("val") * r).otherwise(F.col("val")))
    return facts.join(ratios, entity, "left").withColumn("val", val)
