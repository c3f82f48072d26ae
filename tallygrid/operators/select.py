"""Candidate filtering and batch rotation (FLT-01, 02, 09..13, 15..20, 26..30; WIN-14, 15, 29;
AGG-09, 11; SET-*; JN-01, 15, 28)."""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S

# Label of rows without an industry and names hidden from display.
NO_INDUSTRY = "Uncategorized"
HIDDEN_INDUSTRIES = ["Uncategorized", "(none)"]


@dataclass(frozen=True)
class Criteria:
    """UDX-06: the filter mandate. The defaults are fixed values."""
    min_cap: float = 1e6
    max_cap: float = 1e9
    countries: list[str] = field(default_factory=lambda: ["United States"])
    excluded: list[str] = field(default_factory=lambda: [
        "REIT", "Bank", "Insurance", "Asset Management", "Biotechnology", "Shell Companies"])

    def reason(self, cap="market_cap", country="country", industry="industry") -> Column:
        """FLT-01: code of the first failing test, null for a survivor."""
        ind = F.lower(F.coalesce(S._c(industry), F.lit("")))
        out = (F.when(S._c(cap).isNull(), "no_market_cap").when(S._c(cap) < self.min_cap, "cap_below_min")
               .when(S._c(cap) > self.max_cap, "cap_above_max"))
        if self.countries:
            out = out.when(~F.coalesce(S._c(country).isin(self.countries), F.lit(False)), "country_not_allowed")
        out = out.when(ind == "", "no_industry")
        for x in self.excluded:
            out = out.when(ind.contains(x.lower()), F.lit(f"industry_excluded:{x}"))
        return out


def screen(classified: DataFrame, universe: DataFrame, criteria: Criteria, key: str = "entity") -> DataFrame:
    """JN-01: every classified row with its universe columns and the reject reason."""
    x = classified.join(universe.withColumn("_known", F.lit(True)), key, "left")
    return x.withColumn("reason", F.when(F.col("_known").isNull(), "not_in_universe").otherwise(criteria.reason())).drop("_known")


def reject_histogram(screened: DataFrame, n: int = 10) -> DataFrame:
    """AGG-11: most frequent reasons."""
    return screened.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "reason").limit(n)


def merge_classification(rows: DataFrame, data: str, meta: str) -> DataFrame:
    """FLT-02: classification and meta default to empty maps."""
    empty = F.create_map().cast("map<string,string>")
    return rows.withColumn(data, F.coalesce(data, empty)).withColumn(meta, F.coalesce(meta, empty))


def clean_keys(df: DataFrame, col: str, out: str = "ticker") -> DataFrame:
    """FLT-09 / SET-04: trimmed upper-case distinct keys, blanks dropped."""
    k = F.upper(F.trim(F.col(col)))
    return df.select(k.alias(out)).where(F.col(out) != "").distinct()


def is_ashare(ticker) -> Column:
    """FLT-10."""
    return F.upper(S._c(ticker)).rlike(r"\.(SS|SH|SZ|BJ)$")


def exchange_code(ticker) -> Column:
    """FLT-10: canonical code: .SS becomes .SH; bare digits are routed by their first digit."""
    t = F.upper(F.trim(S._c(ticker)))
    head, tail = F.substring_index(t, ".", 1), F.substring_index(t, ".", -1)
    bare = (F.when(head.rlike("^6"), F.concat(head, F.lit(".SH"))).when(head.rlike("^[48]"), F.concat(head, F.lit(".BJ")))
            .otherwise(F.concat(head, F.lit(".SZ"))))
    return F.when(~t.contains("."), bare).when(tail == "SS", F.concat(head, F.lit(".SH"))).otherwise(t)


def search(df: DataFrame, query: str, key: str, name: str, cap: str, limit: int = 12) -> DataFrame:
    """FLT-11: key-prefix hits before name-substring hits, then by cap."""
    q = query.strip()
    pre, sub = F.upper(F.col(key)).startswith(q.upper()), F.lower(F.col(name)).contains(q.lower())
    return df.where(pre | sub).withColumn("rank", F.when(pre, 0).otherwise(1)) \
        .orderBy("rank", F.col(cap).desc_nulls_last(), key).limit(limit)


def search_plain(df: DataFrame, query: str, key: str, name: str, limit: int = 40) -> DataFrame:
    """FLT-12: the client variant: index order, no cap ranking."""
    q = query.strip()
    pre, sub = F.upper(F.col(key)).startswith(q.upper()), F.lower(F.col(name)).contains(q.lower())
    return df.where(pre | sub).withColumn("rank", F.when(pre, 0).otherwise(1)).orderBy("rank", key).limit(limit)


def search_index(universe: DataFrame, analyzed: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """FLT-13 / SET-01: universe joined with analyzed rows, which win."""
    u, a = universe.alias("u"), analyzed.alias("a")
    return u.join(a, F.col(f"u.{key}") == F.col(f"a.{key}"), "full_outer").select(
        F.coalesce(f"a.{key}", f"u.{key}").alias(key),
        *[F.coalesce(f"a.{c}", f"u.{c}").alias(c) for c in cols if c != "market_cap"],
        F.coalesce("a.market_cap", "u.market_cap").cast("bigint").alias("market_cap"),
        F.col(f"a.{key}").isNotNull().alias("analyzed"))


def exhibit_candidates(names, primary) -> Column:
    """FLT-15: exhibits by name, else everything but the primary document."""
    n = S._c(names)
    hit = F.filter(n, lambda x: F.lower(x).rlike("ex-?99"))
    return F.when(F.size(hit) > 0, hit).otherwise(F.filter(n, lambda x: x != S._c(primary)))


# Roll-up rows of a segment table and its kind codes.
SEGMENT_ROLLUPS = ["地区", "行业", "产品", "合计特别调整", "合计"]
SEGMENT_KINDS = {"D": "region", "I": "industry", "P": "product"}


def segments(df: DataFrame, year: str | None = None, rollups=SEGMENT_ROLLUPS) -> DataFrame:
    """FLT-16: segment rows without roll-ups, with a readable kind. Columns: period, item, code."""
    kind = reduce(lambda acc, kv: F.when(F.col("code") == kv[0], kv[1]).otherwise(acc), SEGMENT_KINDS.items(), F.lit("other"))
    x = df.where(~F.trim("item").isin(rollups)).withColumn("kind", kind)
    return x.where(F.col("period").cast("string").startswith(year)) if year else x


def stale_keys(universe: DataFrame, state: DataFrame, key: str, today, days: int) -> DataFrame:
    """FLT-17 / INC-05: keys never fetched or fetched more than n days ago."""
    x = universe.select(key).join(state.select(key, "fetched_at"), key, "left")
    return x.where(F.col("fetched_at").isNull() | (F.datediff(today, F.col("fetched_at")) > days)).select(key)


def quarters_to_check(entities: DataFrame, calls: DataFrame, checks: DataFrame, today, n: int = 8, recheck: int = 3,
                      window: int = 120, idle: int = 30, entity: str = "entity") -> DataFrame:
    """FLT-18: (entity, quarter) still to fetch. An entity without any call but with a check is
    probed only for the newest quarter, monthly. ``checks``: entity, quarter, checked (date)."""
    cand = entities.select(entity).distinct().select(entity, F.posexplode(S.ended_quarters(today, n)).alias("_i", "quarter"))
    has = calls.select(entity).distinct().withColumn("_has", F.lit(True))
    chk = checks.select(entity).distinct().withColumn("_chk", F.lit(True))
    x = (cand.join(calls.select(entity, "quarter").distinct(), [entity, "quarter"], "left_anti")
         .join(has, entity, "left").join(chk, entity, "left").join(checks, [entity, "quarter"], "left"))
    age = F.datediff(today, F.col("checked"))
    closed = F.datediff(today, S.quarter_key_end("quarter"))
    idle_case = F.col("_has").isNull() & F.col("_chk").isNotNull()
    normal = F.col("checked").isNull() | ((age >= recheck) & (closed <= window))
    probe = (F.col("_i") == 0) & (F.col("checked").isNull() | (age >= idle))
    return x.where(F.when(idle_case, probe).otherwise(normal)).select(entity, "quarter")


def industry_of(col) -> Column:
    """FLT-20."""
    return F.coalesce(F.nullif(S._c(col), F.lit("")), F.lit(NO_INDUSTRY))


def display_names(names) -> Column:
    """FLT-20: placeholder names removed from an array for display."""
    return F.filter(S._c(names), lambda x: ~x.isin(HIDDEN_INDUSTRIES))


def recent_from_newest(df: DataFrame, key: str, date: str, months: int) -> DataFrame:
    """FLT-26: rows within n months of the key's newest date. The newest date is a small aggregate
    joined back, not a window over the whole history."""
    top = df.groupBy(key).agg(F.max(date).alias("_top"))
    return df.join(top, key).where(F.col(date) >= F.add_months("_top", -months)).drop("_top")


def targets(df: DataFrame, key: str, include: list[str] | None = None, exclude: list[str] = (), limit: int | None = None) -> DataFrame:
    """FLT-28."""
    x = df.select(key).distinct()
    x = x.where(F.col(key).isin(include)) if include else x.where(~F.col(key).isin(list(exclude)))
    x = x.orderBy(key)
    return x.limit(limit) if limit else x


def unknown_targets(wanted: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """FLT-28 / JN-15: asked-for keys that do not exist."""
    return wanted.join(df.select(key), key, "left_anti")


def daily_window(df: DataFrame, date: str, start, today) -> DataFrame:
    """FLT-29: on or after the later of a start date and 1 January two years ago."""
    floor = F.make_date(F.year(today) - 2, F.lit(1), F.lit(1))
    return df.where(F.col(date) >= F.greatest(F.lit(start).cast("date"), floor))


def industries(df: DataFrame, date: str = "analyzed_date") -> DataFrame:
    """AGG-09: count, newest date and slug per industry."""
    return df.groupBy(industry_of("industry").alias("industry")).agg(
        F.count(F.lit(1)).alias("n"), F.max(date).alias("latest")).withColumn("slug", S.slug("industry"))


# --- rotation --------------------------------------------------------------------------------------

def pick_industries(rows: DataFrame, used: DataFrame, target: int = 20) -> DataFrame:
    """WIN-14 / SET-05: industries by size until the running total reaches the target, crossing one
    included. Every industry has at least one row, so no more than ``target`` industries can be
    chosen: a distributed top-``target`` precedes the running total, whose window is that small."""
    sizes = rows.groupBy(industry_of("industry").alias("industry")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.join(used.select("industry"), "industry", "left_anti").orderBy(F.desc("n"), "industry").limit(target)
    w = W.orderBy(F.desc("n"), "industry").rowsBetween(W.unboundedPreceding, 0)
    return top.withColumn("_run", F.sum("n").over(w)).where(F.col("_run") - F.col("n") < target).drop("_run")


def cycle_state(log: DataFrame) -> DataFrame:
    """WIN-15: current cycle and its first date (one row)."""
    per = log.groupBy(F.coalesce("cycle", F.lit(1)).cast("bigint").alias("cycle")).agg(F.min("date").alias("cycle_start"))
    return per.agg(F.max_by(F.struct("cycle", "cycle_start"), "cycle").alias("s")).select("s.*")


def used_industries(log: DataFrame) -> DataFrame:
    """WIN-15: industries already used in the current cycle (a scalar subquery, not a join)."""
    cur = log.agg(F.max(F.coalesce("cycle", F.lit(1)))).scalar()
    return log.where(F.coalesce("cycle", F.lit(1)) == cur).select(F.explode("industries").alias("industry")).distinct()


def plan_pick(rows: DataFrame, log: DataFrame, target: int = 20) -> DataFrame:
    """WIN-15: today's industries; when the current cycle is used up, a new one starts. Both
    candidate picks hold at most ``target`` rows before they are compared."""
    cur = log.agg(F.coalesce(F.max(F.coalesce("cycle", F.lit(1))), F.lit(1)).cast("bigint")).scalar()
    fresh = pick_industries(rows, used_industries(log), target).withColumn("restarted", F.lit(False))
    nothing = log.select(F.lit("").alias("industry")).limit(0)
    again = pick_industries(rows, nothing, target).withColumn("restarted", F.lit(True))
    any_fresh = F.max(F.when(~F.col("restarted"), 1)).over(W.partitionBy(F.lit(1)))
    u = fresh.unionByName(again).withColumn("_f", F.coalesce(any_fresh, F.lit(0)) == 1)
    return u.where(F.col("restarted") != F.col("_f")).drop("_f") \
        .withColumn("cycle", cur + F.col("restarted").cast("bigint"))


def done_in_cycle(date, cycle_start) -> Column:
    """WIN-15: analyzed on or after the cycle's first day; false without a start."""
    return F.coalesce(S._c(date) >= S._c(cycle_start), F.lit(False))
