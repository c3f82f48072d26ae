"""User metrics, series and charts (KPI-06..10, UDX-01..04, JN-19, AGG-17, AGG-43).

A user metric is a Spark SQL expression over the wide period grid, with trailing sums, change,
lag and fiscal-year values available as Column helpers. All metrics of all entities are
columns of one select, so Spark shares the windows between them."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators.grid import Grid
from tallygrid.session import small_side
from tallygrid.sources.mappings import ALIAS_KINDS


class MetricError(ValueError):
    pass


class MetricGrid(Grid):
    """Column helpers with the kind check of UDX-04."""

    def ttm_of(self, name: str) -> Column:
        if ALIAS_KINDS.get(name) in ("stock", "market"):
            raise MetricError(f"a trailing sum does not apply to {name!r}: it is not a flow")
        return self.ttm(name)

    def derived(self, name: str) -> Column:
        """KPI-07: the shorthands."""
        d = S.safe_div
        return {
            "pe": lambda: d(F.col("mcap"), self.ttm_of("net_income")),
            "pb": lambda: d(F.col("mcap"), F.col("equity")),
            "ps": lambda: d(F.col("mcap"), self.ttm_of("revenue")),
            "pfcf": lambda: d(F.col("mcap"), self.ttm_of("fcf")),
            "pocf": lambda: d(F.col("mcap"), self.ttm_of("ocf")),
            "ev": lambda: F.col("mcap") + F.col("total_debt") - F.col("cash_all"),
        }[name]()


def base_grid(facts: DataFrame, prices: DataFrame, base: DataFrame, entity: str = "entity", band: float = 3.0) -> DataFrame:
    """KPI-06: the wide grid plus price (as-of month) and mcap; a share count outside the band
    around the baseline is replaced by it."""
    from tallygrid.operators.asof import asof
    p = prices.select(entity, "month", F.col("close").alias("price"))
    x = asof(facts, p, [entity], "period", "month", ["price"], probes_unique=True).join(base, entity, "left")
    sh, b = F.nullif(F.col("shares"), F.lit(0.0)), F.nullif(F.col("base_shares"), F.lit(0.0))
    used = F.when(b.isNull(), sh).when(sh.between(b / band, b * band), sh).otherwise(b)
    return x.withColumn("mcap", F.col("price") * used).drop("base_shares")


def alias_grid(items: DataFrame, entity: str, period: str) -> DataFrame:
    """KPI-06: statement items (entity, period, item, val) as the columns that user metrics name. Every alias is there,
    null where nothing is on file; cash_all, total_debt and fcf come from their parts where they are not reported."""
    from tallygrid.sources.mappings import ALIAS_METRICS, METRIC_LABELS
    label = {a: METRIC_LABELS[m] for a, m in ALIAS_METRICS.items()}
    wide = items.groupBy(entity, period).agg(*[F.max(F.when(F.col("item") == t, F.col("val"))).alias(a) for a, t in label.items()])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = F.col("lt_debt").isNotNull() | F.col("current_debt").isNotNull()
    return wide.withColumns({
        "cash_all": F.coalesce("cash_all", F.col("cash") + zero("sti") + zero("restricted_cash")),
        "total_debt": F.when(some, zero("lt_debt") + zero("current_debt")),
        "fcf": F.col("ocf") - F.abs(zero("capex"))})


@dataclass(frozen=True)
class Metric:
    """UDX-01: one saved metric."""
    name: str
    expr: str | Column
    format: str = "number"
    position: int = 0


def evaluate(grid: DataFrame, metrics: list[Metric], keys: list[str]) -> DataFrame:
    """KPI-08: all metrics as columns of one select."""
    cols = [(F.expr(m.expr) if isinstance(m.expr, str) else m.expr).cast("double").alias(m.name)
            for m in sorted(metrics, key=lambda m: m.position)]
    return grid.select(*keys, *cols)


def windows_first(grid: DataFrame, g: MetricGrid, sums: list[str] = (), changes: list[str] = (),
                  averages: dict[str, int] | None = None, lags: dict[str, int] | None = None) -> DataFrame:
    """Materialise the helper columns that SQL-text metrics refer to: x_ttm, x_yoy, x_avg<n>, x_lag<n>."""
    cols = [g.ttm_of(c).alias(f"{c}_ttm") for c in sums] + [g.yoy(c).alias(f"{c}_yoy") for c in changes]
    cols += [g.rolling_avg(c, n).alias(f"{c}_avg{n}") for c, n in (averages or {}).items()]
    cols += [g.lag(c, n).alias(f"{c}_lag{n}") for c, n in (lags or {}).items()]
    return grid.select("*", *cols)


def newest_values(values: DataFrame, entity: str, period: str, metrics: list[str], last_n: int | None = None) -> DataFrame:
    """KPI-08 / AGG-43: newest non-null value of each metric, all entities in one pass."""
    x = values
    if last_n:
        w = W.partitionBy(entity).orderBy(F.col(period).desc())
        x = x.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last_n)
    return x.groupBy(entity).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(period))).alias(m) for m in metrics])


def metric_maps(values: DataFrame, entity: str, period: str, metrics: list[str]) -> DataFrame:
    """KPI-09: one row per entity and metric with a {period: value} map (bounded by the calendar)."""
    long = values.unpivot([entity, period], metrics, "metric", "value").where(F.col("value").isNotNull())
    return long.groupBy(entity, "metric").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col(period).cast("string"), "value")))).alias("points"))


# Limits of a chart specification.
CHART_SERIES = (1, 4)
CHART_PERIODS = (2, 40)


@dataclass(frozen=True)
class Chart:
    """UDX-03: one to four expressions on a common period axis."""
    title: str
    series: tuple[Metric, ...]
    last_n: int = 8

    def __post_init__(self):
        if not CHART_SERIES[0] <= len(self.series) <= CHART_SERIES[1]:
            raise MetricError("a chart has one to four series")
        if not CHART_PERIODS[0] <= self.last_n <= CHART_PERIODS[1]:
            raise MetricError("a chart shows 2 to 40 periods")


def chart_data(grid: DataFrame, chart: Chart, entity: str, period: str) -> DataFrame:
    """KPI-10."""
    vals = evaluate(grid, list(chart.series), [entity, period])
    return Grid(entity, period).last_n(vals, chart.last_n)


def align_series(points: DataFrame, grid: DataFrame, entity: str, name: str, annual: bool = False) -> DataFrame:
    """UDX-02 / JN-19: a user series (entity, period text, value, ordinal) becomes column s_<name>
    of the grid: joined by fiscal year or by year-month, the last duplicate wins."""
    n = 4 if annual else 7
    pts = points.groupBy(entity, F.substring("period", 1, n).alias("_k")).agg(
        F.max_by("value", F.struct("period", "ordinal")).alias(f"s_{name}"))
    return grid.withColumn("_k", F.substring(F.col("period").cast("string"), 1, n)).join(pts, [entity, "_k"], "left").drop("_k")


def complete_years(points: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-17: annual view of a quarterly series; null unless exactly four non-null quarters."""
    return points.groupBy(*keys, F.substring("period", 1, 4).alias("fy")).agg(
        F.when((F.count(F.lit(1)) == 4) & (F.count("value") == 4), F.sum("value")).alias("value"))


def applicable(needs: DataFrame, have: DataFrame, entity: str = "entity") -> DataFrame:
    """FLT-25: (metric, entity) pairs where every series the metric needs exists for the entity:
    relational division by counting the matches. ``needs``: metric, series; ``have``: entity, series."""
    req = needs.distinct()
    n = req.groupBy("metric").agg(F.count(F.lit(1)).alias("_need"))
    got = have.select(entity, "series").distinct().join(small_side(req), "series") \
        .groupBy("metric", entity).agg(F.count(F.lit(1)).alias("_have"))
    return got.join(n, "metric").where(F.col("_have") == F.col("_need")).select("metric", entity)


def check_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SCL-14: (usable points, rejects) of a raw series table: grid, period, value text."""
    ok = F.coalesce(S.point_ok("period", "value", F.col("grid")), F.lit(False))
    good = points.where(ok).withColumn("period", S.point_period("period", F.col("grid"))).withColumn("value", S.number("value"))
    return good, points.where(~ok)
