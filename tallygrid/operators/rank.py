"""Top-k selections (TOP-01..09). Each row_number filter becomes a group limit below the shuffle."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.operators.keyed import newest_per_key, top_per_key
from tallygrid.session import small_side

# Asset lines in order of preference, with the class they belong to.
ASSET_LINES = [
    ("Goodwill", "goodwill"), ("Other Intangible Assets", "intangibles"),
    ("Goodwill And Other Intangible Assets", "intangibles"), ("Net PPE", "ppe"),
    ("Property Plant And Equipment Net", "ppe"), ("Property Plant And Equipment Gross", "ppe"), ("Gross PPE", "ppe"),
    ("Inventory", "inventory"), ("Receivables", "receivables"), ("Accounts Receivable", "receivables"),
    ("Other Short Term Investments", "investments"), ("Available For Sale Securities", "investments"),
    ("Long Term Investments", "investments"), ("Other Investments", "investments"),
    ("Investments And Advances", "investments"), ("Other Non Current Assets", "other_assets"), ("Other Assets", "other_assets"),
]
# Liability lines.
LIABILITY_LINES = ["Long Term Debt", "Current Debt", "Accounts Payable", "Accrued Liabilities", "Deferred Revenue",
                   "Lease Obligations"]


def line_dimension(spark, lines=None) -> DataFrame:
    """Made in the plan: Catalyst knows its size, so that cells are not exchanged by their few items to meet it."""
    rows = [F.struct(F.lit(item).alias("item"), F.lit(cat).alias("category"), F.lit(i).alias("ord")) for i, (item, cat) in enumerate(lines or ASSET_LINES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _newest_sheet(cells: DataFrame, entity: str, positive: bool) -> DataFrame:
    """Cells of the newest sheet that has a candidate: quarterly before annual, then by period.
    ``cells``: entity, grid ('quarterly' | 'annual'), period, item, val."""
    use = cells.where(F.col("val").isNotNull() & ((F.col("val") > 0) | F.lit(not positive)))
    w = W.partitionBy(entity).orderBy((F.col("grid") == "quarterly").desc(), F.col("period").desc())
    # a group limit: each task forwards one sheet of an entity
    return use.withColumn("_r", F.rank().over(w)).where((F.col("_r") == 1) & F.col("period").isNotNull()).drop("_r")


def top_assets(cells: DataFrame, dim: DataFrame, entity: str = "entity", n: int | None = None) -> DataFrame:
    """TOP-01: asset classes of the newest sheet, largest first; of near-aliases in one class only
    the first-listed positive one counts."""
    x = _newest_sheet(cells.join(small_side(dim), "item"), entity, positive=False).where(F.col("val") > 0)
    one = x.groupBy(entity, "category").agg(F.min_by(F.struct("item", "val", "ord"), "ord").alias("b")) \
        .select(entity, "category", "b.*")
    w = W.partitionBy(entity).orderBy(F.col("val").desc(), "ord")
    out = one.withColumn("rn", F.row_number().over(w).cast("bigint")).drop("ord")
    return out.where(F.col("rn") <= n) if n else out


def top_liabilities(cells: DataFrame, dim: DataFrame, entity: str = "entity", n: int = 3) -> DataFrame:
    """TOP-02: largest liabilities of the newest sheet with any positive candidate."""
    x = _newest_sheet(cells.join(small_side(dim), "item"), entity, positive=True)
    return top_per_key(x, [entity], [F.col("val").desc(), F.col("ord")], n).drop("ord", "category")


def newest_records(df: DataFrame, entity: str, kind: str, order: list, limits: dict[str, int]) -> DataFrame:
    """TOP-04 / TOP-06: newest records per child table with a limit per kind. The common upper
    limit is pushed below the shuffle, the exact one applied after it."""
    x = top_per_key(df, [entity, kind], order, max(limits.values()))
    lim = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    return x.where(F.col("rn") <= F.element_at(lim, F.col(kind)))


def top_in_newest(df: DataFrame, entity: str, period: str, order: list, n: int) -> DataFrame:
    """TOP-04 (pay) / TOP-05: largest rows of the entity's newest period."""
    newest = df.groupBy(entity).agg(F.max(period).alias(period))
    return top_per_key(df.join(newest, [entity, period], "left_semi"), [entity], order, n)


def holders(main: DataFrame, floats: DataFrame, entity: str, period: str, order: list, n: int = 10) -> DataFrame:
    """TOP-05: top holders of the newest period of the main list; the float list uses that period too
    when it has it, else its own newest."""
    want = main.groupBy(entity).agg(F.max(period).alias("_want"))
    top = top_per_key(main.join(want, entity).where(F.col(period) == F.col("_want")).drop("_want"), [entity], order, n)
    f = floats.join(want, entity, "left")
    pick = f.groupBy(entity).agg(F.coalesce(F.max(F.when(F.col(period) == F.col("_want"), F.col(period))),
                                            F.max(period)).alias("_pick"))
    sel = floats.join(pick, entity).where(F.col(period) == F.col("_pick")).drop("_pick")
    return top.withColumn("list", F.lit("holders")).unionByName(
        top_per_key(sel, [entity], order, n).withColumn("list", F.lit("float")))


def indicator_row(df: DataFrame, entity: str, period: str, fields: list[str], prefix: str | None = None) -> DataFrame:
    """TOP-07: newest (or prefix-matching) indicator row in long form, nulls dropped."""
    x = df.where(F.col(period).cast("string").startswith(prefix)) if prefix else df
    best = newest_per_key(x, [entity], [period, *fields], [period, *fields])
    return best.unpivot([entity, period], fields, "indicator", "value").where(F.col("value").isNotNull())


def newest_reports(filings: DataFrame, entity: str, keep: int = 3) -> DataFrame:
    """TOP-08: newest annual reports, amendments excluded."""
    return top_per_key(filings.where(~F.col("form").endswith("/A")), [entity],
                       [F.col("filed").desc(), F.col("accession").desc()], keep)


def concept_facts(facts: DataFrame, concept: str, keys: list[str], n: int) -> DataFrame:
    """TOP-09: raw facts of one concept, newest first, n per unit."""
    return top_per_key(facts.where(F.col("concept") == concept), [*keys, "unit"],
                       [F.col("end").desc(), F.col("filed").desc(), F.col("val").desc()], n)
