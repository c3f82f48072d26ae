"""Read models (RM-*, JN-02, 16, 17, 26; AGG-29, 30, 45): saved joins over the tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators.keyed import top_per_key
from tallygrid.operators.select import industry_of
from tallygrid.session import small_side


def ticker_rows(analyzed: DataFrame, status: DataFrame, ratios: DataFrame, key: str = "entity") -> DataFrame:
    """JN-02: analyzed row with validation status (ok by default) and ratios."""
    return analyzed.join(status, key, "left").join(ratios, key, "left").withColumn("status", F.coalesce("status", F.lit("ok")))


def batch_members(log: DataFrame, analyzed: DataFrame, status: DataFrame, key: str, batch: list[str]) -> DataFrame:
    """JN-16 / RM-08: members of each batch in their order; unknown ones skipped. ``log``: batch
    columns and the tickers array."""
    x = log.select(*batch, F.posexplode("tickers").alias("pos", key))
    return x.join(analyzed, key).join(status, key, "left").withColumn("status", F.coalesce("status", F.lit("ok")))


def entry_of(log: DataFrame, date=None, order: list[str] = ("date",)) -> DataFrame:
    """AGG-45: the log entry of a date, or the newest."""
    if date is not None:
        return log.where(F.col("date") == date)
    return log.orderBy(*[F.desc(c) for c in order]).limit(1)


def recent_batches(log: DataFrame, live: DataFrame, digests: DataFrame, key: str, n: int = 10, order: list[str] = ("date",)) -> DataFrame:
    """AGG-29 / RM-06: newest n log entries with their live ticker count, and the summary only when a
    digest of that entry exists. n entries are taken first, so the rest is tiny."""
    top = log.orderBy(*[F.desc(c) for c in order]).limit(n)
    x = top.select(*order, F.explode_outer("tickers").alias(key))
    cnt = x.join(live.select(key, F.lit(1).alias("_live")), key, "left").groupBy(*order).agg(F.count("_live").alias("live"))
    return cnt.join(digests, list(order), "left")


def newest_entry_per_industry(log: DataFrame, digests: DataFrame, key: str = "industry") -> DataFrame:
    """JN-17: per industry the newest log entry naming it; a stored digest of that industry overrides
    the entry's summary when it is not older. ``log``: date, industries, summary, ordinal."""
    x = log.select("date", "ordinal", "summary", F.explode("industries").alias(key))
    last = x.groupBy(key).agg(F.max_by(F.struct("date", "summary"), F.struct("date", "ordinal")).alias("b")).select(key, "b.*")
    d = digests.groupBy(key).agg(F.max_by(F.struct(F.col("date").alias("_d"), F.col("summary").alias("_s")), "date").alias("b")).select(key, "b.*")
    y = last.join(d, key, "left")
    return y.select(key, "date", F.when(F.col("_d") >= F.col("date"), F.col("_s")).otherwise(F.col("summary")).alias("summary"))


def saved_rows(saved: DataFrame, index: DataFrame, rows: DataFrame, key: str = "entity") -> DataFrame:
    """JN-26: KPI rows of saved tickers; unknown ones become a stub named after themselves."""
    x = saved.join(index, key, "left").join(rows, key, "left")
    return x.withColumn("known", F.col("name").isNotNull()).withColumn("name", F.coalesce("name", F.col(key).cast("string")))


def industry_detail(rows: DataFrame, summaries: DataFrame, slug: str) -> DataFrame:
    """RM-02: KPI rows of one industry with its newest summary."""
    x = rows.withColumn("industry", industry_of("industry")).where(S.slug("industry") == slug)
    return x.join(small_side(summaries.select("industry", "summary")), "industry", "left")


def fact_sheet(annual: DataFrame, quarterly: DataFrame, entity: str, metrics: list[str], years: int = 10, quarters: int = 8,
               period: str = "period", factor: DataFrame | None = None, counts: list[str] = ()) -> DataFrame:
    """RM-10: metric x period pivot of each entity's newest fiscal years (y1, the newest, to yN) and quarters (q1 ..).
    Metrics without any value there are dropped. ``factor`` (entity, factor) brings money into the entity's
    own currency; ``counts`` are no money."""
    rows = []
    for df, n, g in ((annual, years, "y"), (quarterly, quarters, "q")):
        x = top_per_key(df.select(entity, period, *metrics), [entity], [F.col(period).desc()], n)
        rows.append(x.withColumn("_slot", F.concat(F.lit(g), F.col("rn").cast("string"))).drop("rn", period))
    long = rows[0].unionByName(rows[1]).unpivot([entity, "_slot"], metrics, "metric", "val").where(F.col("val").isNotNull())
    if factor is not None:
        rate = F.when(F.col("metric").isin(*counts), 1.0).otherwise(F.coalesce("factor", F.lit(1.0)))
        long = long.join(factor.select(entity, "factor"), entity, "left").withColumn("val", F.col("val") * rate).drop("factor")
    slots = [f"y{i}" for i in range(1, years + 1)] + [f"q{i}" for i in range(1, quarters + 1)]
    return long.groupBy(entity, "metric").agg(*[F.max(F.when(F.col("_slot") == c, F.col("val"))).alias(c) for c in slots])
