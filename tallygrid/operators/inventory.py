"""Small reports over stored facts: AGG-31..33, 35; TXT-10; SET-02."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.operators.keyed import newest_per_key, top_per_key
from tallygrid.session import small_side


def price_range(prices: DataFrame, entity: str = "entity", time: str = "month", last: int = 12) -> DataFrame:
    """AGG-31: low, high, latest close and the newest ``last`` closes; prices hold one row per month."""
    w = W.partitionBy(entity).orderBy(F.col(time).desc())
    x = prices.withColumn("_rn", F.row_number().over(w))
    recent = F.when(F.col("_rn") <= last, F.struct(time, "close"))
    return x.groupBy(entity).agg(F.min("close").alias("lo"), F.max("close").alias("hi"), F.max_by("close", time).alias("latest"),
                                 F.transform(F.sort_array(F.collect_list(recent)), lambda r: r["close"]).alias("recent"))


def usage_costs(usage: DataFrame, price_table: DataFrame, keys: list[str], model: str, tokens: str) -> DataFrame:
    """AGG-32: token and cost totals; a model without a price has no cost."""
    x = usage.join(small_side(price_table), model, "left")
    return x.groupBy(*keys).agg(F.sum(tokens).alias("tokens"), F.round(F.sum(F.col(tokens) * F.col("price") / 1e6), 9).alias("cost"),
                                F.count_if(F.col("price").isNull()).alias("unpriced"))


def source_inventory(rows: DataFrame, keys: list[str], period: str) -> DataFrame:
    """AGG-33: row count and sorted distinct periods per source. Periods are made distinct by an
    aggregate first, so a list holds each period once."""
    x = rows.groupBy(*keys, F.col(period).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    return x.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sort_array(F.collect_list("_p")).alias("periods"))


def concept_search(facts: DataFrame, keyword: str, entity: str = "entity", limit: int = 40) -> DataFrame:
    """AGG-35: concepts whose name contains the keyword: record count and latest value per unit,
    most used first."""
    g = facts.where(F.contains(F.lower("concept"), F.lit(keyword.lower()))).groupBy(entity, "concept", "unit").agg(
        F.count(F.lit(1)).alias("records"), F.max_by("val", F.struct("end", "filed", "val")).alias("latest"))
    return top_per_key(g, [entity], [F.desc("records"), "concept", "unit"], limit).drop("rn")


def release_of(releases: DataFrame, entity: str = "entity", period: str = "period_end", want=None) -> DataFrame:
    """TXT-10: the release of a period, or each entity's newest."""
    if want is not None:
        return releases.where(F.col(period) == want)
    rest = [c for c in releases.columns if c not in (entity, period)]
    return newest_per_key(releases, [entity], [period, *rest], [period, *rest])


def batch_union(batch: DataFrame, watch: DataFrame, analyzed: DataFrame, key: str = "entity") -> DataFrame:
    """SET-02: today's batch and the watched, analyzed keys outside it."""
    extra = watch.join(analyzed.select(key), key, "left_semi").join(batch.select(key), key, "left_anti")
    return batch.select(key).unionByName(extra.select(key)).distinct()
