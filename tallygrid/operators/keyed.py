"""Operators on keyed rows, written so that one hot key never has to fit one task.

* newest-row-per-key is an aggregate (``max_by``), combined before the shuffle;
* top-n-per-key relies on Spark's group-limit pushdown (each task forwards at most n rows);
* running totals are computed in blocks of the ordering value: totals per block first
  (small), then inside each block, so a hot key is spread over its blocks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, keys: list[str], order: list, payload: list[str] | None = None) -> DataFrame:
    """AGG-10 and friends: the row with the greatest order tuple per key.

    Express a descending tie-break by a negated column (as in a first-row-wins ordinal)."""
    payload = payload or [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), rank).alias("_best"))
    return best.select(*keys, "_best.*")


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int, rank_col: str = "rn") -> DataFrame:
    """TOP-*: the first n rows of each key. The row_number <= n filter is pushed below the
    shuffle as a group limit."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n) \
        .withColumn(rank_col, F.col(rank_col).cast("bigint"))


def running_totals(df: DataFrame, keys: list[str], order: str, sums: dict[str, str],
                   block: int = 4096, descending: bool = False, depth: int = 2) -> DataFrame:
    """Running totals (current row included) along a unique integer order column, several in one
    pass: ``sums`` maps output names to value columns. Exact for integers.

    Null keys are a key of their own; rows with a null order come after all others. Rows are cut into
    blocks of ``block`` consecutive order values. Block totals are aggregated
    (with map-side combine) and accumulated per key, themselves in blocks while ``depth`` allows;
    each block then adds its own offset. With two levels the widest window holds one block, or one
    row per block squared, of a key."""
    sign = -1 if descending else 1
    tot, acc, off = ({o: f"_{p}_{o}" for o in sums} for p in ("tot", "acc", "off"))
    rows = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    totals = rows.groupBy(*keys, F.col("_blk").alias("_ord")).agg(*[F.sum(v).alias(tot[o]) for o, v in sums.items()])
    if depth > 1:
        totals = running_totals(totals, keys, "_ord", {acc[o]: tot[o] for o in sums}, block, descending, depth - 1)
        offset = {o: F.col(acc[o]) - F.col(tot[o]) for o in sums}
    else:
        wb = W.partitionBy(*keys).orderBy((F.col("_ord") * sign).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
        offset = {o: F.coalesce(F.sum(tot[o]).over(wb), F.lit(0)) for o in sums}
    offsets = totals.select(*keys, F.col("_ord").alias("_blk"), *[offset[o].alias(off[o]) for o in sums])
    wi = W.partitionBy(*keys, "_blk").orderBy((F.col(order) * sign).asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    inside = rows.select("*", *[F.sum(v).over(wi).alias(f"_in_{o}") for o, v in sums.items()])
    same = [*keys, "_blk"]
    offsets = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(same)], *off.values())
    x = inside.join(offsets, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(same)])
    return x.select(*df.columns, *[(F.col(f"_in_{o}") + F.col(off[o])).alias(o) for o in sums])


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                  block: int = 4096, descending: bool = False) -> DataFrame:
    """One running total; see ``running_totals``."""
    return running_totals(df, keys, order, {out: value}, block, descending)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-04: non-null new fields overwrite, null ones keep the stored value."""
    cols = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    cond = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in cols:
        pick.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns
                    else F.col(f"o.{c}").alias(c))
    return o.join(n, cond, "full_outer").select(*pick)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-05/10: rows of refreshed keys are replaced, others stay, new ones are appended."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def carry_over(new: DataFrame, old: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """SNK-05: selected columns fall back to the previous row when not recomputed."""
    o = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in cols])
    out = new.join(o, keys, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_old_{c}"))).drop(f"_old_{c}")
    return out


def pending(universe: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """SET-03 / INC-01: keys not processed yet."""
    return universe.join(done.select(*keys), keys, "left_anti")


def fill_missing(primary: DataFrame, secondary: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """JN-13: secondary values fill only what the primary lacks."""
    p, s = primary.alias("p"), secondary.alias("s")
    cond = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys]
    return p.join(s, cond, "full_outer").select(
        *[F.coalesce(F.col(f"p.{k}"), F.col(f"s.{k}")).alias(k) for k in keys],
        *[F.coalesce(F.col(f"p.{v}"), F.col(f"s.{v}")).alias(v) for v in values])
