"""HTML to text (TXT-01). Scripts, rows, block tags, tags and white space are column expressions;
only the table-row rewrite and entity decoding run in one Arrow UDF, over whole texts."""
from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallygrid.functions.scalars import _c

_ROW = re.compile(r"(?is)<tr\b[^>]*>(.*?)</tr>")
_CELL = re.compile(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>")


def _cells(match: re.Match) -> str:
    parts = (" ".join(re.sub(r"<[^>]+>", " ", c).split()) for c in _CELL.findall(match.group(1)))
    return "\n" + " | ".join(parts) + "\n"


@F.pandas_udf(StringType())
def table_rows(doc: pd.Series) -> pd.Series:
    """Each table row on one line, its cells joined by ' | '."""
    return doc.map(lambda s: None if s is None else _ROW.sub(_cells, s))


@F.pandas_udf(StringType())
def decode_entities(doc: pd.Series) -> pd.Series:
    return doc.map(lambda s: None if s is None else _html.unescape(s))


# Entities decoded by column expressions; '&amp;' must come last.
COMMON_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " ", "copy": "\u00a9",
                   "middot": "\u00b7", "mdash": "\u2014", "ndash": "\u2013", "amp": "&"}
_RARE_ENTITY = r"&(?!(?:" + "|".join(COMMON_ENTITIES) + r");)[#A-Za-z]"


def unescape(text) -> Column:
    """Entity decoding: by column expressions when a text holds common entities only; other texts
    (and no others) are passed to the Arrow UDF."""
    x = _c(text)
    plain = x
    for name, char in COMMON_ENTITIES.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    return F.coalesce(decode_entities(F.when(x.rlike(_RARE_ENTITY), x)), plain)


def html_to_text(doc, max_chars: int | None = None) -> Column:
    """TXT-01. The UDFs receive null, not the text, for documents that do not need them."""
    x = F.regexp_replace(_c(doc), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.coalesce(table_rows(F.when(F.lower(x).contains("<tr"), x)), x)
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</p>|</div>|</li>|</h\d>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = unescape(x)
    x = F.regexp_replace(F.regexp_replace(x, "\\u00a0", " "), "\\u200b", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"( ?\| ?)+", " | ")
    x = F.regexp_replace(x, r"(?m)^[ \t\r\f|]+|[ \t\r\f|]+$", "")
    x = F.regexp_replace(x, r"\n+", "\n")
    x = F.btrim(x, F.lit("\n "))
    if max_chars:
        x = F.when(F.length(x) > max_chars, F.concat(F.left(x, F.lit(max_chars)), F.lit("\n…(truncated)"))).otherwise(x)
    return x


# What a results release says near its top, and headings of its statements.
RESULTS_PATTERN = (
    r"(?i)(financial results|results for the (first|second|third|fourth) quarter|"
    r"(first|second|third|fourth)[- ]quarter .* results|unaudited .* results|"
    r"(interim|half[- ]year|six months) results)")
STATEMENT_PATTERN = (
    r"(?i)(balance sheets?|balance sheet data|statements? of operations|income statements?|"
    r"statements? of (comprehensive )?(income|loss)|statements? of cash flows?|cash flows? statements?)")


def looks_like_results(text, results: str = RESULTS_PATTERN, statement: str = STATEMENT_PATTERN) -> Column:
    """FLT-14: announces results in its first 4000 characters and carries a statement heading; both
    tested on white-space-collapsed text."""
    flat = F.regexp_replace(_c(text), r"\s+", " ")
    return F.substring(flat, 1, 4000).rlike(results) & flat.rlike(statement)
