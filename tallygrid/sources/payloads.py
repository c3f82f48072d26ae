"""Nested payloads to rows (SRC-09..14, 16, 18..21)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import scalars as S
from tallygrid.operators.keyed import top_per_key

FACTS_DDL = "map<string,struct<units:map<string,array<struct<start:date,end:date,val:double,form:string,filed:date,fy:int,fp:string>>>>>"


def company_facts(docs: DataFrame, keys: list[str], body: str) -> DataFrame:
    """SRC-09: {concept: {units: {unit: [record]}}} JSON to long filed facts."""
    x = docs.select(*keys, F.explode(F.from_json(body, FACTS_DDL)).alias("concept", "_c"))
    x = x.select(*keys, "concept", F.explode("_c.units").alias("unit", "_r"))
    return x.select(*keys, "concept", "unit", F.inline("_r"))


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "period", value: str = "val") -> DataFrame:
    """SRC-10: wide frame to long rows, nulls and NaN dropped."""
    x = df.unpivot(ids, columns, name, value)
    return x.where(F.col(value).isNotNull() & ~F.isnan(value))


def pivot_back(df: DataFrame, ids: list[str], name: str, names: list[str], value: str = "val") -> DataFrame:
    """SRC-10: inverse; the column names are given, so no extra pass finds them."""
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value))


def column_payload(df: DataFrame, keys: list[str], fields: str, items: str) -> DataFrame:
    """SRC-11: {fields: [], items: [[]]} to one map per row, with its position."""
    rows = F.transform(F.col(items), lambda r: F.map_from_arrays(F.col(fields), r))
    return df.select(*keys, F.posexplode(rows).alias("pos", "row"))


# Exchanges kept from the listing.
EXCHANGES = ["NYSE", "Nasdaq"]


def listing(rows: DataFrame, keys: list[str] = (), exchanges=EXCHANGES) -> DataFrame:
    """SRC-12: kept exchanges, no empty ticker, first occurrence per ticker."""
    x = rows.where(F.col("exchange").isin(exchanges) & (F.coalesce("ticker", F.lit("")) != ""))
    cols = [c for c in x.columns if c != "ticker"]
    return x.groupBy("ticker").agg(F.min_by(F.struct(*cols), F.struct(*keys, "pos")).alias("b")).select("ticker", "b.*")


def profiles(df: DataFrame, short: str, long: str, overview: str) -> DataFrame:
    """SRC-13: short name else long name; rows without an overview dropped."""
    nz = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.where(F.coalesce(F.trim(overview), F.lit("")) != "").withColumn("name", F.coalesce(nz(short), nz(long)))


def price_rows(df: DataFrame, keys: list[str], data: str) -> DataFrame:
    """SRC-14: price arrays to rows: close to 4 decimals, NaN volume to null, null closes dropped."""
    x = df.select(*keys, F.inline(data))
    vol = F.when(~F.isnan(F.col("volume").cast("double")), F.col("volume")).cast("bigint")
    return x.where(F.col("close").isNotNull() & ~F.isnan("close")).withColumn("close", F.round("close", 4)).withColumn("volume", vol)


def filings(pages: list[DataFrame], keys: list[str], arrays: list[str], forms: list[str], since: str | None = None) -> DataFrame:
    """SRC-16: parallel arrays of several pages to filing rows of the wanted forms, filed on or after
    a date. Ordering is left to the caller."""
    u = pages[0]
    for p in pages[1:]:
        u = u.unionByName(p)
    x = u.select(*keys, F.inline(F.arrays_zip(*arrays)))
    x = x.where(F.col("form").isin(forms))
    return x.where(F.col("filed") >= since) if since else x


# Titles that are a report and titles that are not.
REPORT_TITLE = "年度报告|半年度报告|第一季度报告|第三季度报告"
NOT_A_REPORT = "摘要|英文|English|更正|已取消|公告$"


def announcements(df: DataFrame, keys: list[str], keep: int = 3, wanted: str = REPORT_TITLE, skip: str = NOT_A_REPORT,
                  title: str = "title", time: str = "time", tie: str = "id") -> DataFrame:
    """SRC-18: report announcements, newest ``keep`` per entity and category."""
    x = df.where(F.col(title).rlike(wanted) & ~F.col(title).rlike(skip))
    return top_per_key(x, keys, [F.col(time).desc(), F.col(tie).desc()], keep)


def transcript_turns(df: DataFrame, keys: list[str], calls: str) -> DataFrame:
    """SRC-19: quarter -> turns maps to rows, turns without content dropped."""
    x = df.select(*keys, F.explode(calls).alias("quarter", "_t")).select(*keys, "quarter", F.posexplode("_t.turns").alias("turn", "_r"))
    y = x.select(*keys, "quarter", "turn", "_r.speaker", "_r.title", F.trim("_r.content").alias("content"), "_r.sentiment")
    return y.where(F.coalesce("content", F.lit("")) != "")


def first_by_end(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """SRC-20: the first row per period wins."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), ordinal).alias("b")).select(*keys, "b.*")


def child_table(bundle: DataFrame, keys: list[str], child: str) -> DataFrame:
    """SRC-21: one child array of a bundle as its own table; other children are pruned from the scan."""
    return bundle.select(*keys, F.inline(child))


# Dates inside addresses and text.
URL_DATE = r"(20\d{2})[/-](\d{1,2})[/-](\d{1,2})"


def source_date(published, url, snippet) -> Column:
    """AGG-41: publication date of a source: its field, else a date in its address, else in its text."""
    def within(c):
        p = lambda i: F.lpad(F.regexp_extract(S._c(c), URL_DATE, i), 2, "0")
        return F.try_to_date(F.concat_ws("-", F.regexp_extract(S._c(c), URL_DATE, 1), p(2), p(3)))
    return F.coalesce(F.try_to_date(F.substring(S._c(published).cast("string"), 1, 10)), within(url), within(snippet))
