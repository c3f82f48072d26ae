"""Multi-source merge of long facts (JN-03..06, 10, 13, 14, 27; AGG-12, 15, 16, 18, 21, 22).

Facts are long rows: entity, metric, period, val, source, ccy, partial."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S

ALIGN_DAYS = 25                                         # fixed value: tolerance of JN-06
SOURCE_ORDER = ["sec", "ashare", "6k", "yfinance"]       # fixed values: most to least authoritative


def merge_cells(primary: DataFrame, secondary: DataFrame, keys: list[str],
                primary_tag: str = "sec", secondary_tag: str = "yfinance") -> DataFrame:
    """JN-03: cell-level full outer merge with provenance. The primary wins unless its cell is
    marked partial and the secondary has a strictly larger value."""
    p = primary.select(*keys, F.col("val").alias("_pv"), F.col("partial").alias("_pp"), F.lit(True).alias("_p"))
    s = secondary.select(*keys, F.col("val").alias("_sv"), F.lit(True).alias("_s"),
                         *([F.col("source").alias("_ss")] if "source" in secondary.columns else []))
    x = p.join(s, keys, "full_outer")
    tag = F.coalesce(F.col("_ss"), F.lit(secondary_tag)) if "source" in secondary.columns else F.lit(secondary_tag)
    yields = (F.coalesce("_pp", F.lit(False)) & F.col("_sv").isNotNull()
              & (F.col("_sv") > F.coalesce("_pv", F.lit(0.0))))
    use_p = F.coalesce(F.col("_p"), F.lit(False)) & ~F.coalesce(yields, F.lit(False))
    return x.select(*keys, F.when(use_p, F.col("_pv")).otherwise(F.col("_sv")).alias("val"),
                    F.when(use_p, F.lit(primary_tag)).otherwise(tag).alias("source"))


def overlay_cells(base: DataFrame, over: DataFrame, keys: list[str], entity: str = "entity") -> DataFrame:
    """JN-04: overlay cells replace base cells, but only for entities where both report in the
    same currency (row-level ``row_ccy``); entities known to one side pass through."""
    cb = base.groupBy(entity).agg(F.max(F.coalesce("row_ccy", F.lit("USD"))).alias("_cb"))
    ok = over.join(cb, entity, "left").where(
        F.col("_cb").isNull() | (F.coalesce("row_ccy", F.lit("USD")) == F.col("_cb"))).drop("_cb")
    cols = [c for c in base.columns if c not in keys]
    b, o = base.alias("b"), ok.alias("o")
    hit = F.col(f"o.{keys[0]}").isNotNull()
    return b.join(o, [F.col(f"b.{k}") == F.col(f"o.{k}") for k in keys], "full_outer").select(
        *[F.coalesce(F.col(f"o.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        *[F.when(hit, F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in cols])


def by_precedence(facts: DataFrame, keys: list[str], order: list[str] = SOURCE_ORDER) -> DataFrame:
    """JN-05: among several sources the most authoritative non-null cell wins. An aggregate,
    so copies of one cell are combined before the shuffle."""
    prio = reduce(lambda acc, iv: acc.when(F.col("source") == iv[1], -iv[0]), list(enumerate(order))[1:],
                  F.when(F.col("source") == order[0], 0)).otherwise(-len(order))
    best = facts.where(F.col("val").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct("val", "source"), F.struct(prio, "val")).alias("b"))
    return best.select(*keys, "b.*")


def align_periods(primary: DataFrame, secondary: DataFrame, entity: str = "entity", period: str = "period",
                  days: int = ALIGN_DAYS) -> DataFrame:
    """JN-06: map each secondary period to the nearest primary period within ``days``; one
    secondary per primary, the closer one claims it, losers and far ones keep their key.

    Dates are bucketed by month and the secondary side looks into its own and the two
    neighbouring months, so the range join is an equi-join on (entity, month) and no pair
    further than a month apart is ever formed. Returns entity, period, aligned."""
    p = primary.select(entity, F.col(period).alias("_pd")).distinct().withColumn("_m", F.trunc("_pd", "month"))
    s = secondary.select(entity, F.col(period).alias("_sd")).distinct()
    probe = s.withColumn("_m", F.explode(F.array(*[F.trunc(F.add_months("_sd", k), "month") for k in (-1, 0, 1)])))
    dist = F.abs(F.datediff("_pd", "_sd"))
    near = probe.join(p, [entity, "_m"]).where(dist <= days) \
        .groupBy(entity, "_sd").agg(F.min(F.struct(dist.alias("d"), F.col("_pd").alias("pd"))).alias("n")) \
        .where(F.col("n.d") > 0)
    claims = near.groupBy(entity, F.col("n.pd").alias("_pd")).agg(
        F.min(F.struct(F.col("n.d").alias("d"), F.col("_sd").alias("sd"))).alias("c")) \
        .select(entity, F.col("c.sd").alias("_sd"), F.col("_pd").alias("_to"))
    return s.join(claims, [entity, "_sd"], "left").select(
        entity, F.col("_sd").alias(period), F.coalesce("_to", "_sd").alias("aligned"))


def statement_join(inc: DataFrame, bs: DataFrame, cf: DataFrame, keys: list[str]) -> DataFrame:
    """JN-10: income drives; balance and cash-flow cells of the same period are attached."""
    return inc.join(bs, keys, "left").join(cf, keys, "left")


def first_statement(facts: DataFrame, keys: list[str]) -> DataFrame:
    """JN-27: the item's cell from the income statement, else balance sheet, else cash flow."""
    prio = (F.when(F.col("stmt") == "income_statement", 0).when(F.col("stmt") == "balance_sheet", -1).otherwise(-2))
    return facts.where(F.col("val").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct("val", "stmt"), prio).alias("b")).select(*keys, "b.*")


def key_difference(facts: DataFrame, keys: list[str], left: str, right: str, out: str) -> DataFrame:
    """JN-14: out = left - right where both metrics exist for a key; one conditional aggregate
    instead of a self-join."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("val")))
    return facts.where(F.col("metric").isin(left, right)).groupBy(*keys).agg(
        pick(left).alias("_l"), pick(right).alias("_r")) \
        .where(F.col("_l").isNotNull() & F.col("_r").isNotNull()) \
        .select(*keys, F.lit(out).alias("metric"), (F.col("_l") - F.col("_r")).alias("val"))


def dedupe_cells(rows: DataFrame, keys: list[str], order: list[str], cells: list[str]) -> DataFrame:
    """AGG-12: per cell the last non-null value in announcement order."""
    rank = F.struct(*[F.coalesce(F.col(o).cast("string"), F.lit("")) for o in order])
    return rows.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cells])


# --- composites ------------------------------------------------------------------------------

def group_pick(facts: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-16: per group the first concept (``rank``) with a non-zero value, else the first with
    any. Input: keys, rank, concept, val."""
    best = facts.where(F.col("val").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct("concept", "val"), F.struct((F.col("val") == 0).alias("z"), "rank")).alias("b"))
    return best.select(*keys, "b.*")


def composite(parts: DataFrame, total: DataFrame, keys: list[str], group: str = "grp") -> DataFrame:
    """AGG-15: the tagged total when present, else the sum of the group picks with a
    'sum(a+b)' provenance. ``parts``: keys, grp, concept, val; ``total``: keys, concept, val."""
    s = parts.groupBy(*keys).agg(
        F.sum("val").alias("_sum"),
        F.concat(F.lit("sum("), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct(group, "concept"))), lambda x: x["concept"]), "+"),
            F.lit(")")).alias("_how"))                               # one element per component group
    t = total.select(*keys, F.col("val").alias("_tot"), F.col("concept").alias("_tc"))
    return s.join(t, keys, "full_outer").select(
        *keys, F.coalesce("_tot", "_sum").alias("val"),
        F.when(F.col("_tot").isNotNull(), F.col("_tc")).otherwise(F.col("_how")).alias("concept"))


# --- derived cells with provenance ---------------------------------------------------------------

def weakest(*srcs) -> Column:
    """AGG-22: least authoritative tag among the inputs."""
    cs = [S._c(s) for s in srcs]
    has = lambda tag: reduce(lambda a, b: a | b, [F.coalesce(c == tag, F.lit(False)) for c in cs])
    out = F.when(has("yfinance"), "yfinance").when(has("sec"), "sec")
    for tag in reversed(SOURCE_ORDER[1:-1]):
        out = out.when(has(tag), tag)
    return out.otherwise("sec")


def total_debt(lt, st, legacy, assets) -> Column:
    """AGG-21: long + short buckets when either exists, else the legacy total, else zero when a
    balance sheet exists."""
    lt, st, legacy, assets = map(S._c, (lt, st, legacy, assets))
    zero = F.lit(0.0)
    return (F.when(lt.isNotNull() | st.isNotNull(), F.coalesce(lt, zero) + F.coalesce(st, zero))
            .when(legacy.isNotNull(), legacy).when(assets.isNotNull(), zero))


def total_debt_source(lt, st, legacy, assets, lt_s, st_s, legacy_s, assets_s) -> Column:
    """AGG-21: its provenance tag."""
    lt, st, legacy, assets, lt_s, st_s, legacy_s, assets_s = map(
        S._c, (lt, st, legacy, assets, lt_s, st_s, legacy_s, assets_s))
    any_yf = (lt.isNotNull() & (lt_s == "yfinance")) | (st.isNotNull() & (st_s == "yfinance"))
    return (F.when(lt.isNotNull() | st.isNotNull(), F.when(F.coalesce(any_yf, F.lit(False)), "yfinance").otherwise("sec"))
            .when(legacy.isNotNull(), F.coalesce(legacy_s, F.lit("sec")))
            .when(assets.isNotNull(), F.coalesce(assets_s, F.lit("sec"))))


def derive_period(df: DataFrame) -> DataFrame:
    """AGG-22: derived cells of one wide row per entity and period.

    Every metric m is a column with a tag column m_src. Adds or fills revenue (zero when only
    income lines exist), gross_profit, capex sign and default, fcf, cash_all and total_debt,
    each with the weakest tag of its inputs."""
    c = F.col
    rev_zero = c("revenue").isNull() & c("op_income").isNotNull() & c("net_income").isNotNull()
    df = (df.withColumn("revenue_src", F.when(rev_zero, "derived").otherwise(c("revenue_src")))
          .withColumn("revenue", F.when(rev_zero, F.lit(0.0)).otherwise(c("revenue"))))
    gp_new = c("gross_profit").isNull() & c("revenue").isNotNull() & c("cogs").isNotNull()
    df = (df.withColumn("gross_profit_src", F.when(gp_new, weakest("revenue_src", "cogs_src")).otherwise(c("gross_profit_src")))
          .withColumn("gross_profit", F.when(gp_new, c("revenue") - c("cogs")).otherwise(c("gross_profit"))))
    flip = (c("capex") > 0) & (c("capex_src") == "sec")
    capex0 = c("capex").isNull() & c("ocf").isNotNull()
    df = (df.withColumn("capex_src", F.when(capex0, "derived").otherwise(c("capex_src")))
          .withColumn("capex", F.when(flip, -c("capex")).when(capex0, F.lit(0.0)).otherwise(c("capex"))))
    df = (df.withColumn("fcf", c("ocf") - F.abs("capex"))
          .withColumn("fcf_src", F.when(c("fcf").isNotNull(), weakest("ocf_src", "capex_src"))))
    zero = F.lit(0.0)
    used = lambda m: F.when(c(m).isNotNull(), c(f"{m}_src"))
    df = (df.withColumn("cash_all", F.when(c("cash").isNotNull(), c("cash") + F.coalesce("sti", zero)
                                           + F.coalesce("restricted_cash", zero)).otherwise(c("cash_total")))
          .withColumn("cash_all_src", F.when(c("cash").isNotNull(), weakest(
              used("cash"), used("sti"), used("restricted_cash"))).otherwise(c("cash_total_src"))))
    debt = [c(m) for m in ("lt_debt", "st_debt", "debt_legacy", "assets")]
    tags = [c(f"{m}_src") for m in ("lt_debt", "st_debt", "debt_legacy", "assets")]
    return (df.withColumn("total_debt", total_debt(*debt))
            .withColumn("total_debt_src", total_debt_source(*debt, *tags)))


def statement_maps(facts: DataFrame, keys: list[str]) -> DataFrame:
    """KPI-05: one row per entity, statement and period with items and sources as maps. The
    lists hold one entry per metric name, so their size is bounded by the metric table."""
    pair = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", v))))
    return facts.groupBy(*keys).agg(pair("val").alias("items"), pair("source").alias("sources"))


# --- balance-sheet line walk ----------------------------------------------------------------------

def asset_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-18: asset-class totals from ordered balance-sheet lines (keys, pos, label, value).

    The walk is two aggregates per statement instead of an ordered scan: the position of the
    'total current assets' line and the first stop line (total assets, liabilities, equity).
    Lines are then classified independently of each other."""
    lab = F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), "[^a-z ]+", " ")
    x = lines.withColumn("_lab", lab)
    has = lambda t: F.col("_lab").contains(t)
    marker = has("total current assets")
    stop = ~marker & (has("total assets") | has("liabilit") | (has("equity") & ~has("invest")))
    bounds = x.groupBy(*keys).agg(F.min(F.when(marker, F.col("pos"))).alias("_cur"),
                                  F.min(F.when(stop, F.col("pos"))).alias("_stop"))
    x = x.join(bounds, keys).where((F.col("pos") < F.coalesce("_stop", F.lit(2 ** 31 - 1))) & ~marker
                                   & F.col("value").isNotNull() & ~F.col("_lab").startswith("total"))
    late = F.coalesce(F.col("pos") > F.col("_cur"), F.lit(False))
    kind = (F.when(~late & has("cash and cash equivalents") & ~has("restricted"), "cash")
            .when(has("restricted cash"), "restricted_cash")
            .when(~late & has("short") & has("invest"), "short_term_investments")
            .when(~late & (has("receivable") | has("amounts due from")) & ~has("allowance"), "receivables")
            .when(F.col("_lab").startswith("inventor"), "inventory")
            .when(has("goodwill"), "goodwill")
            .when(late & (has("intangible") | has("land use right")), "intangibles")
            .when(has("property") & has("equipment") & ~has("deposit"), "ppe_net")
            .when(late & has("invest") & ~has("short"), "long_term_investments"))
    return x.withColumn("metric", kind).where(F.col("metric").isNotNull()) \
        .groupBy(*keys, "metric").agg(F.sum("value").alias("val"))


def opex_layout(facts: DataFrame, entity: str = "entity", sm: str = "sm", ga: str = "ga") -> DataFrame:
    """AGG-37: does an entity report both selling and general cost in at least two periods."""
    return facts.groupBy(entity).agg(((F.count(sm) >= 2) & (F.count(ga) >= 2)).alias("split_opex"))


def period_rank_rows(keys: list[str], period: str = "period") -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(F.col(period).desc()))
