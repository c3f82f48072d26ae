"""Findings kept from run to run (DQ-16, 17; AGG-26; FLT-27).

One row per entity in a merge-on-read table: the version of the inputs that its findings came from, and the findings. The version is a sum of
row hashes over everything that the rules read of the entity, so it does not depend on the order of rows and is one aggregate with partial sums. Days
enter it through the outcome of the rules that count them, so that an entity does not change each day it merely grows older.

A run compares versions (two narrow columns), evaluates the rules for the entities whose version differs, and writes only these. How many it has
evaluated, and their findings by severity, are counted by the write itself."""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallygrid.operators import quality as Q
from tallygrid.session import materialise, small_side
from tallygrid.sources import merge_table as M


@dataclass
class Run:
    """What a run has done."""
    evaluated: int
    removed: int
    findings: dict[str, int]


def versions(inp: Q.Inputs, filed_only: DataFrame | None = None) -> DataFrame:
    """(entity, version) of every company."""
    def one(df: DataFrame, seed: int, *more) -> DataFrame:
        cols = sorted(c for c in df.columns if c != "entity")
        # a null and a missing field hash alike, so each value goes with a mark; halves of the hash keep sums within a long
        h = F.xxhash64(F.lit(seed), *[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols], *more)
        return df.select("entity", F.shiftright(h, 32).alias("a"), (h.bitwiseAND(0xFFFFFFFF)).alias("b"))

    age = lambda c, days: F.datediff(inp.today, c) > days
    stale = F.when(age(F.col("price_date"), Q.STALE_PRICE_DAYS), F.datediff(inp.today, F.col("price_date")))
    newest = inp.quarters.groupBy("entity").agg(Q._newest_quarter())
    old = newest.where(age(F.col("q_end"), Q.STALE_FILING_DAYS)).select("entity", F.datediff(inp.today, F.col("q_end")).alias("late"))
    thresholds = F.lit(repr(sorted((inp.thresholds or {}).items())))
    parts = [one(inp.companies, 1, stale, thresholds), one(inp.years, 2), one(inp.quarters, 3), one(old, 4)]
    if filed_only is not None:
        parts.append(one(filed_only.select("entity").distinct(), 5))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = rows.groupBy("entity").agg(F.xxhash64(F.sum("a"), F.sum("b"), F.count(F.lit(1))).alias("version"))
    return sums.join(inp.companies.select("entity"), "entity", "left_semi")


def create(spark, path: str, entity: str = "long", buckets: int | None = None) -> M.MergeTable:
    """An empty table of findings."""
    return M.MergeTable.create(spark.createDataFrame([], f"entity {entity}, version long, findings array<struct<severity:string,rule:string,detail:string>>"), path, ["entity"], buckets)


def refresh(table: M.MergeTable, inp: Q.Inputs, filed_only: DataFrame | None = None) -> Run:
    """Bring the table up to the inputs; only entities whose inputs have changed are evaluated."""
    m = table.manifest()
    now = materialise(versions(inp, filed_only), "versions")
    stored = table.read(m, columns=["version"])
    changed = materialise(now.join(stored, ["entity", "version"], "left_anti"), "changed")
    gone = materialise(stored.select("entity").join(now, "entity", "left_anti"), "gone")
    if changed.isEmpty() and gone.isEmpty():
        return Run(0, 0, dict.fromkeys(Q.SEVERITIES[1:], 0))
    only = lambda df: df.join(small_side(changed.select("entity")), "entity", "left_semi")
    some = replace(inp, companies=only(inp.companies), years=only(inp.years), quarters=only(inp.quarters))
    issues = Q.run_rules(some, filed_only=filed_only)
    # a list holds at most one finding for each rule of the company and of each of its fiscal years
    lists = issues.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("severity", "rule", "detail"))).alias("findings"))
    rows = changed.join(lists, "entity", "left").select("entity", "version", F.coalesce("findings", F.array()).alias("findings"), F.lit(M.REPLACE).alias("how"))
    rows = rows.unionByName(gone.select("entity", F.lit(M.REMOVE).alias("how")), allowMissingColumns=True)
    seen = Observation()
    of = lambda sev: F.sum(F.when(F.col("how") == M.REPLACE, F.size(F.filter("findings", lambda f: f["severity"] == sev))).otherwise(0)).alias(sev)
    rows = rows.observe(seen, F.count_if(F.col("how") == M.REPLACE).alias("evaluated"), F.count_if(F.col("how") == M.REMOVE).alias("removed"), *[of(s) for s in Q.SEVERITIES[1:]])
    table.apply(rows, F.col("how"), at=m)
    got = seen.get
    return Run(got["evaluated"], got["removed"], {s: got[s] or 0 for s in Q.SEVERITIES[1:]})


def issues(table: M.MergeTable) -> DataFrame:
    """(entity, severity, rule, detail), as the rules themselves give them."""
    return table.read(columns=["findings"]).select("entity", F.inline("findings"))


def status(table: M.MergeTable) -> DataFrame:
    """AGG-26 from the kept lists, without an exchange: every entity has its row."""
    rank = F.aggregate("findings", F.lit(0), lambda a, f: F.greatest(a, Q.severity_rank(f["severity"])))
    return table.read(columns=["findings"]).select("entity", Q.severity_name(rank).alias("status"))


def visible(table: M.MergeTable) -> DataFrame:
    """FLT-27 from the kept lists: findings beyond info of entities in warn or error, in one pass over the table."""
    worth = F.filter("findings", lambda f: f["severity"] != "info")
    return table.read(columns=["findings"]).select("entity", F.inline(F.filter(worth, lambda f: f["severity"] != "ok")))
