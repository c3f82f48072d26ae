"""Windows on the period grid (WIN-01..04, 11..13, 18, 19, 24..26).

All of these run after facts were aggregated to one row per entity and period, so a
window partition is bounded by the calendar (quarters, months), not by the data."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S


class Grid:
    """Row windows along one period column, per entity. ``step`` is the number of rows in a
    year: 4 for quarters, 1 for fiscal years."""

    def __init__(self, entity, period="period", annual: bool = False):
        self.keys = [entity] if isinstance(entity, str) else list(entity)
        self.period = period
        self.annual = annual
        self.step = 1 if annual else 4
        self.w = W.partitionBy(*self.keys).orderBy(period)

    def _roll(self, v: Column, n: int, agg) -> Column:
        w = self.w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(v).over(w) == n, agg(v).over(w))

    def rolling_sum(self, v, n: int) -> Column:
        """WIN-01: null unless the window is full and has no gap."""
        return self._roll(S._c(v), n, F.sum)

    def rolling_avg(self, v, n: int) -> Column:
        """WIN-01."""
        return self._roll(S._c(v), n, F.avg)

    def lag(self, v, n: int) -> Column:
        """WIN-02."""
        return F.lag(S._c(v), n).over(self.w)

    def ttm(self, v) -> Column:
        """WIN-03: trailing four quarters; the value itself on an annual grid."""
        return S._c(v) if self.annual else self.rolling_sum(v, 4)

    def yoy(self, v) -> Column:
        """WIN-04: change against the row one year back, on its absolute value."""
        return S.change(S._c(v), self.lag(v, self.step))

    def rank_newest(self) -> Column:
        return F.row_number().over(W.partitionBy(*self.keys).orderBy(F.col(self.period).desc()))

    def last_n(self, df: DataFrame, n: int) -> DataFrame:
        """WIN-12: newest n periods per entity."""
        return df.withColumn("_rn", self.rank_newest()).where(F.col("_rn") <= n).drop("_rn")

    def spikes(self, df: DataFrame, value: str, ratio: float = 2.0) -> DataFrame:
        """WIN-11: isolated spikes: larger than ratio x both neighbours; ends and zeros skipped."""
        v = F.col(value)
        x = df.withColumn("_prev", F.lag(v).over(self.w)).withColumn("_next", F.lead(v).over(self.w))
        one = F.lit(1.0)
        keep = ((F.col("_prev") != 0) & (F.col("_next") != 0) & (v != 0)
                & (F.abs(v) / F.greatest(F.abs("_prev"), one) > ratio)
                & (F.abs(v) / F.greatest(F.abs("_next"), one) > ratio))
        return x.where(keep).drop("_prev", "_next")

    def pad_left(self, df: DataFrame, n: int, slot: str = "slot") -> DataFrame:
        """WIN-24: exactly n slots per entity, newest in the last one, empty ones on the left."""
        rows = self.last_n(df.withColumn(slot, (F.lit(n + 1) - self.rank_newest()).cast("bigint")), n)
        slots = df.select(*self.keys).distinct().select(
            *self.keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias(slot))
        return slots.join(rows, [*self.keys, slot], "left")

    def densify(self, df: DataFrame) -> DataFrame:
        """Optional calendar spine: every quarter between an entity's first and last one."""
        span = df.groupBy(*self.keys).agg(F.min(self.period).alias("_a"), F.max(self.period).alias("_b"))
        spine = span.select(*self.keys, F.explode(F.sequence(
            F.trunc("_a", "quarter"), F.trunc("_b", "quarter"), F.expr("interval 3 months"))).alias("_q")) \
            .select(*self.keys, S.quarter_end("_q").alias(self.period))
        return spine.join(df, [*self.keys, self.period], "left")


def prior_year(df: DataFrame, entity: str, fy: str, quarter: str, values: list[str]) -> DataFrame:
    """JN-18: value of the same period one fiscal year earlier, by label (calendar-safe)."""
    prev = df.select(entity, (F.col(fy) + 1).alias(fy), quarter, *[F.col(v).alias(f"prev_{v}") for v in values])
    return df.join(prev, [entity, fy, quarter], "left")


def tint(new, old) -> Column:
    """WIN-13: up / down class for a change of at least 20 percent."""
    d = S.change(new, old)
    return F.when(d >= 0.20, "up").when(d <= -0.20, "down").otherwise("")


def downsample(df: DataFrame, keys: list[str], order: str, target: int) -> DataFrame:
    """WIN-18: every ceil(n / target)-th point, always the last."""
    w = W.partitionBy(*keys)
    x = (df.withColumn("_n", F.count(F.lit(1)).over(w))
         .withColumn("_i", F.row_number().over(w.orderBy(order)) - 1))
    step = F.greatest(F.ceil(F.col("_n") / F.lit(target)), F.lit(1))
    return x.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_n", "_i")


def next_sibling(df: DataFrame, group: str, member: str, block: Column, out: str = "next_member") -> DataFrame:
    """WIN-19: next member of the group in member order, cyclic; null for a lone member.

    ``block`` is an order-preserving bucket of the member (such as an id range), so a huge
    group is sorted block by block; one row per block links the block edges."""
    x = df.withColumn("_blk", block)
    edges = x.groupBy(group, "_blk").agg(F.min(member).alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    we = W.partitionBy(group)
    edges = edges.select(
        group, "_blk", F.sum("_cnt").over(we).alias("_size"),
        F.coalesce(F.lead("_first").over(we.orderBy("_blk")), F.min("_first").over(we)).alias("_wrap"))
    wi = W.partitionBy(group, "_blk").orderBy(member)
    return (x.withColumn("_succ", F.lead(member).over(wi)).join(edges, [group, "_blk"])
            .withColumn(out, F.when(F.col("_size") > 1, F.coalesce("_succ", "_wrap")))
            .drop("_succ", "_wrap", "_size", "_blk"))


def first_of_year(df: DataFrame, entity: str, date: str) -> DataFrame:
    """WIN-25: first point of each calendar year (axis ticks)."""
    return df.groupBy(entity, F.year(date).cast("bigint").alias("year")).agg(F.min(date).alias("tick"))


def min_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """WIN-26: value scaled to 0..1 inside its series; null for a flat series."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, S.safe_div(F.col(value) - lo, hi - lo))


def bar_height(v, cap: float = 80.0) -> Column:
    """WIN-26: bar size, capped."""
    return F.least(F.abs(S._c(v)), F.lit(cap))
