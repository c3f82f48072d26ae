"""Currency operators (JN-22..25, AGG-38..40, SRC-15, SNK-12).

Rates are a small dimension (one row per currency code), broadcast after a size check."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.scalars import _c
from tallygrid.session import small_side

# Metrics that are counts, never money.
COUNT_METRICS = ["diluted_shares", "basic_shares", "shares"]


def code(c) -> Column:
    return F.upper(F.coalesce(F.nullif(_c(c), F.lit("")), F.lit("USD")))


def with_rate(df: DataFrame, fx: DataFrame, ccy: Column, out: str = "rate") -> DataFrame:
    """Per-row divisor: the currency's per-USD rate; 1 for USD and for unknown currencies."""
    r = fx.where(F.col("per_usd") > 0).select(F.upper("ccy").alias("_ccy"), F.col("per_usd").alias("_per"))
    x = df.withColumn("_c", code(ccy)).join(small_side(r), F.col("_c") == F.col("_ccy"), "left")
    rate = F.when(F.col("_c") == "USD", F.lit(1.0)).otherwise(F.coalesce("_per", F.lit(1.0)))
    return x.withColumn(out, rate).drop("_c", "_ccy", "_per")


def cells_to_usd(cells: DataFrame, fx: DataFrame, cell_ccy: str = "ccy", source_ccy: str = "source_ccy",
                 metric: str = "metric", val: str = "val") -> DataFrame:
    """JN-22 / JN-23: a cell's own currency tag, else its source's; counts are never scaled."""
    x = with_rate(cells, fx, F.coalesce(F.col(cell_ccy), F.col(source_ccy)))
    return x.withColumn(val, F.when(F.col(metric).isin(COUNT_METRICS), F.col(val))
                        .otherwise(F.col(val) / F.col("rate"))).drop("rate")


def prices_to_usd(prices: DataFrame, fx: DataFrame, quote_ccy: str = "quote_ccy") -> DataFrame:
    """JN-24: prices follow the quote currency, not the reporting one."""
    return with_rate(prices, fx, F.col(quote_ccy)).withColumn("close", F.col("close") / F.col("rate")).drop("rate")


def series_to_usd(points: DataFrame, fx: DataFrame) -> DataFrame:
    """JN-25: user series of unit money are converted, others untouched."""
    x = with_rate(points, fx, F.col("ccy"))
    return x.withColumn("value", F.when(F.col("unit") == "money", F.col("value") / F.col("rate"))
                        .otherwise(F.col("value"))).drop("rate")


def currencies_in_use(*cols_of: tuple[DataFrame, str]) -> DataFrame:
    """AGG-38: distinct non-USD codes over several tables."""
    parts = [df.select(F.upper(c).alias("ccy")) for df, c in cols_of]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("ccy").isNotNull() & (F.col("ccy") != "") & (F.col("ccy") != "USD")).distinct()


def row_currency(annual: DataFrame, entity: str = "entity") -> DataFrame:
    """AGG-39: currency of the newest annual period of the first populated metric among
    total assets, revenue and net income; ``annual`` has entity, metric, fy, ccy."""
    newest = lambda m: F.max_by(F.coalesce("ccy", F.lit("USD")), F.when(F.col("metric") == m, F.col("fy")))
    return annual.groupBy(entity).agg(F.coalesce(
        newest("total_assets"), newest("revenue"), newest("net_income"), F.lit("USD")).alias("currency"))


def reporting_currency(primary_ccy, has_statements, secondary_ccy) -> Column:
    """AGG-40: the primary source's currency when it has statements, else the secondary's, else USD."""
    return F.when(_c(has_statements) & (F.coalesce(_c(primary_ccy), F.lit("")) != ""), F.upper(_c(primary_ccy))) \
        .otherwise(code(secondary_ccy))


def source_currency(source, primary_ccy, secondary_ccy) -> Column:
    """AGG-40: currency a cell of a given source is in; derived cells follow the primary."""
    return F.when(_c(source).isin("sec", "derived"), code(primary_ccy)).otherwise(code(secondary_ccy))


def refresh_rates(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-12: usable new rates replace old ones, a failed currency keeps its last rate."""
    u = old.withColumn("_n", F.lit(0)).unionByName(new.where(F.col("per_usd") > 0).withColumn("_n", F.lit(1)))
    best = u.groupBy("ccy").agg(F.max_by(F.struct("per_usd", "as_of"), F.struct("_n", "as_of")).alias("b"))
    return best.select("ccy", "b.*")
