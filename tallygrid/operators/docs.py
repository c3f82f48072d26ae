"""Document jobs (TXT-02..06, 09, 11, 12; WIN-20, 21).

Documents are one row each; ``lines`` explodes them without a shuffle, and only heading rows
(a small part of the text) are shuffled for section ends."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.functions.scalars import _c

# Numbering that sets a heading's level, outermost first.
HEADING_MARKERS = [r"^第[一二三四五六七八九十]+节", r"^[一二三四五六七八九十]+[、.]", r"^[（(][一二三四五六七八九十\d]+[)）]", r"^\d+[、.]"]
MAX_TITLE = 120
ITEM_PATTERN = r"(?i)^ITEM\s+(\d{1,2}[A-C]?)\s*[.:]?\s*\|?\s*(.*)$"
NOTE_PATTERN = r"(?i)^(?:NOTE\s+)?(\d{1,2})\s*\.\s*\|?\s*([A-Z][^|]{3,90}?)\s*(\(continued\))?\s*$"
NOTE_NUMBER = r"(?i)^(?:NOTE\s+)?(\d{1,2})\s*\.\s*$"
NOTE_TITLE = r"^[A-Z][^|]{3,90}$"
NOTES_START = r"(?i)NOTES TO (THE )?CONSOLIDATED FINANCIAL STATEMENTS"


def lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line: keys, line (0-based), text, n_lines, next_text.

    Each line is zipped with its successor before the explode, so that an output row carries two
    lines and not the whole text."""
    arr = F.split(F.col(text), "\n")
    x = docs.select(*keys, F.size(arr).alias("n_lines"), F.arrays_zip(arr.alias("text"), F.slice(arr, 2, F.size(arr)).alias("next_text")).alias("_z"))
    return x.select(*keys, "n_lines", F.posexplode("_z").alias("line", "_p")).select(*keys, "n_lines", "line", "_p.text", "_p.next_text")


def markdown_headings(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """TXT-02: heading lines with their numbering level: keys, line, key, title, level, n_lines."""
    x = lines(docs, keys, text).where(F.col("text").startswith("#"))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^[# ]+", ""), "</?(mark|u|b|i)>", ""), r"\s+", " "))
    x = x.withColumn("title", title).where((F.col("title") != "") & (F.length("title") <= MAX_TITLE))
    level = F.lit(len(HEADING_MARKERS) + 1)
    key = F.substring("title", 1, 24)
    for i, p in reversed(list(enumerate(HEADING_MARKERS, 1))):
        level = F.when(F.col("title").rlike(p), i).otherwise(level)
        key = F.when(F.col("title").rlike(p), F.regexp_extract("title", "(" + p + ")", 1)).otherwise(key)
    return x.select(*keys, "line", F.btrim(key, F.lit("、. ")).alias("key"), "title", level.alias("level"), "n_lines")


def section_ends(heads: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-20: a section runs to the next heading of its own or a shallower level.

    Walking the headings of a document backwards, the nearest later heading at level <= L is a
    running minimum, one per level. The windows share one sort of the heading rows (the text is
    not carried along), and a document's headings came from a single row."""
    w = W.partitionBy(*keys).orderBy(F.col("line").desc()).rowsBetween(W.unboundedPreceding, -1)
    top = len(HEADING_MARKERS) + 1
    nxt = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(w) for k in range(1, top + 1)]
    x = heads
    for k, c in enumerate(nxt, 1):
        x = x.withColumn(f"_n{k}", c)
    pick = F.lit(None).cast("int")
    for k in range(1, top + 1):
        pick = F.when(F.col("level") == k, F.col(f"_n{k}")).otherwise(pick)
    return x.withColumn("end", F.coalesce(pick, "n_lines")).drop(*[f"_n{k}" for k in range(1, top + 1)])


def longest_per_key(heads: DataFrame, keys: list[str], by: str) -> DataFrame:
    """WIN-21: of repeated headings the one with the longest span, the earliest on a tie."""
    cols = [c for c in heads.columns if c not in (*keys, by)]
    best = heads.groupBy(*keys, by).agg(F.max_by(F.struct(*cols), F.struct(F.col("end") - F.col("line"), -F.col("line"))).alias("b"))
    return best.select(*keys, by, "b.*")


def markdown_toc(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """TXT-02 + WIN-20 + WIN-21."""
    return longest_per_key(section_ends(markdown_headings(docs, keys, text), keys), keys, "title")


def item_toc(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """TXT-03: ITEM and NOTE headings: keys, key, title, line, end."""
    strip = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" |"))
    x = lines(docs, keys, text).withColumn("s", strip(F.col("text"))).withColumn("nx", strip(F.col("next_text")))
    dots = lambda c: F.btrim(c, F.lit(" ."))
    own = dots(F.regexp_extract("s", ITEM_PATTERN, 2))
    title = F.when(own != "", own).when(F.col("next_text").isNotNull() & (F.length("nx") <= 140), dots(F.col("nx"))).otherwise("")
    title = F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r"[\s.|]*\d+\s*$", "")
    num = F.regexp_extract("s", ITEM_PATTERN, 1)
    items = x.where(F.col("s").rlike(ITEM_PATTERN) & (F.length("s") <= 140)).select(
        *keys, "line", "n_lines", F.concat(F.lit("item "), F.lower(num)).alias("key"),
        F.concat(F.lit("Item "), F.upper(num), F.lit(". "), title).alias("title"))
    w = W.partitionBy(*keys).orderBy("line")
    items = items.withColumn("end", F.coalesce(F.lead("line").over(w), F.col("n_lines"))).drop("n_lines")
    best = longest_per_key(items, keys, "key").select(*keys, "key", "title", "line", "end")

    start = x.where(F.col("s").rlike(NOTES_START)).groupBy(*keys).agg(F.min("line").alias("_start"))
    full = F.col("s").rlike(NOTE_PATTERN)
    split_ = F.col("s").rlike(NOTE_NUMBER) & F.col("nx").rlike(NOTE_TITLE)
    n = F.when(full, F.regexp_extract("s", NOTE_PATTERN, 1)).otherwise(F.regexp_extract("s", NOTE_NUMBER, 1))
    t = F.when(full, F.trim(F.regexp_extract("s", NOTE_PATTERN, 2))) \
        .otherwise(F.trim(F.regexp_replace("nx", r"(?i)\s*\(continued\)\s*$", "")))
    notes = (x.where(full | split_).withColumn("num", n).withColumn("t", t).join(start, keys, "left")
             .where(F.col("line") >= F.coalesce("_start", F.lit(0)))
             .groupBy(*keys, "num").agg(F.min(F.struct("line", "t", "n_lines")).alias("b")).select(*keys, "num", "b.*"))
    notes = notes.withColumn("end", F.coalesce(F.lead("line").over(w), F.col("n_lines"))).select(
        *keys, F.concat(F.lit("note "), F.col("num")).alias("key"),
        F.concat(F.lit("Note "), F.col("num"), F.lit(". "), F.col("t")).alias("title"), "line", "end")
    return best.unionByName(notes)


def find_section(toc: DataFrame, keys: list[str], query: str) -> DataFrame:
    """TXT-04: by key ('item 5', 'note 12'), by 'line:N', or the longest section whose title
    contains the query."""
    import re
    q = " ".join(query.strip().lower().split())
    if q.startswith("line:"):
        at = int(q[5:])
        return toc.select(*keys).distinct().select(*keys, F.lit(at).alias("line"), F.lit(None).cast("int").alias("end"),
                                                   F.lit(q).alias("key"), F.lit(f"from line {at}").alias("title"))
    m = re.fullmatch(r"(item|note)\s*(\d{1,2}[a-c]?)\.?", q)
    hit = toc.where(F.col("key") == f"{m.group(1)} {m.group(2)}") if m else toc.where(F.lower("title").contains(q))
    best = hit.groupBy(*keys).agg(F.max_by(F.struct("line", "end", "key", "title"),
                                           F.struct(F.coalesce("end", F.lit(0)) - F.col("line"), -F.col("line"))).alias("b"))
    return best.select(*keys, "b.*")


def section_text(docs: DataFrame, sections: DataFrame, keys: list[str], text: str = "text", offset: int = 0,
                 max_chars: int = 12000) -> DataFrame:
    """TXT-05: a page of the section: title, chunk, total characters, next offset."""
    x = sections.select(*keys, "line", "end", "title").join(docs.select(*keys, text), keys)
    arr = F.split(F.col(text), "\n")
    body = F.array_join(F.slice(arr, F.col("line") + 1, F.greatest(F.coalesce("end", F.size(arr)) - F.col("line"), F.lit(0))), "\n")
    x = x.withColumn("_b", body)
    return x.select(*keys, "title", F.substring("_b", offset + 1, max_chars).alias("chunk"), F.length("_b").cast("bigint").alias("total"),
                    F.least(F.lit(offset + max_chars), F.length("_b")).cast("bigint").alias("next_offset"))


def search_lines(docs: DataFrame, keys: list[str], keyword: str, text: str = "text", limit: int = 12, context: int = 1,
                 width: int = 600) -> DataFrame:
    """TXT-06: first hits per document with context lines. Done inside the row with array functions:
    no shuffle, and a document without a hit costs one substring test."""
    kw = keyword.lower()
    arr = F.split(F.col(text), "\n")
    x = docs.where(F.contains(F.lower(F.col(text)), F.lit(kw))).select(*keys, arr.alias("_l"))
    hits = F.slice(F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.contains(F.lower(F.get("_l", i)), F.lit(kw))), 1, limit)
    lo = lambda i: F.greatest(i - context, F.lit(0))
    cut = lambda i: F.substring(F.array_join(F.slice("_l", lo(i) + 1, i + context - lo(i) + 1), "\n"), 1, width)
    found = F.transform(hits, lambda i: F.struct(i.cast("bigint").alias("line"), cut(i).alias("snippet")))
    return x.select(*keys, F.inline(found))


def toc_budget(toc: DataFrame, keys: list[str], budget: int = 70) -> DataFrame:
    """TXT-09: per document the deepest level whose cumulative heading count fits the budget, the
    number of listed and of hidden headings."""
    deepest = len(HEADING_MARKERS) + 1
    cnt = toc.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 *[F.count_if(F.col("level") <= k).alias(f"c{k}") for k in range(1, deepest + 1)],
                                 F.max("level").alias("deepest"))
    lvl, shown = F.lit(0), F.lit(0).cast("bigint")
    for k in range(1, deepest + 1):
        lvl = F.when(F.col(f"c{k}") <= budget, F.lit(k)).otherwise(lvl)
        shown = F.when(F.col(f"c{k}") <= budget, F.col(f"c{k}")).otherwise(shown)
    return cnt.select(*keys, F.least(lvl, "deepest").cast("bigint").alias("level"), shown.alias("shown"), (F.col("n") - shown).alias("hidden"))


def join_sections(parts: DataFrame, keys: list[str], order: str, body: str, budget: int, block: int = 4096) -> DataFrame:
    """TXT-11: sections in order until the character budget is reached, joined and cut."""
    from tallygrid.operators.keyed import running_total
    x = running_total(parts.withColumn("_len", F.length(body)), keys, order, "_len", "_run", block)
    keep = x.where(F.col("_run") - F.col("_len") < budget)
    txt = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, body))), lambda s: s[body]), "\n\n")
    return keep.groupBy(*keys).agg(F.substring(txt, 1, budget).alias("text"))


def render(template: str, values: dict[str, str | Column]) -> Column:
    """TXT-12: {{name}} placeholders replaced by column values."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(_c(v).cast("string"), F.lit("")))
    return out
