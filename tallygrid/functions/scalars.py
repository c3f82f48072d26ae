"""Scalar column functions (SCL family) and null-strict algebra.

Every function takes and returns Columns, so all of it stays in whole-stage codegen."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --- SCL-01, SCL-02, SCL-12: periods -----------------------------------------

def fiscal_year(end) -> Column:
    """SCL-01: an end in June or later closes that year, an earlier one the year before;
    unreadable dates give null."""
    d = F.try_to_date(_c(end).cast("string"))
    return F.when(F.month(d) >= 6, F.year(d)).otherwise(F.year(d) - 1).cast("bigint")


def fy_label(end, short: bool = False) -> Column:
    """SCL-02: FY2025, or FY25 when short."""
    y = fiscal_year(end).cast("string")
    return F.concat(F.lit("FY"), F.right(y, F.lit(2)) if short else y)


def quarter_label(end, short: bool = False) -> Column:
    """SCL-02: '2026 Q1', or Q1'26 when short."""
    d = F.try_to_date(_c(end).cast("string"))
    y, q = F.year(d).cast("string"), F.quarter(d).cast("string")
    if short:
        return F.concat(F.lit("Q"), q, F.lit("'"), F.right(y, F.lit(2)))
    return F.concat(y, F.lit(" Q"), q)


def quarter_end(ts) -> Column:
    """Last day of the calendar quarter a date falls in."""
    d = _c(ts)
    return F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1)))


def compact_date(s) -> Column:
    """SCL-12: yyyymmdd text to a date; null when unreadable."""
    return F.try_to_date(_c(s).cast("string"), "yyyyMMdd")


def quarter_key(ts) -> Column:
    """SCL-12: 2026Q2 label of a date."""
    return F.concat(F.year(_c(ts)).cast("string"), F.lit("Q"), F.quarter(_c(ts)).cast("string"))


def quarter_key_end(label) -> Column:
    """SCL-12: the end date of a 2026Q2 label; null when the label is malformed."""
    y = F.regexp_extract(_c(label), r"^(\d{4})Q([1-4])$", 1)
    q = F.regexp_extract(_c(label), r"^(\d{4})Q([1-4])$", 2)
    return F.when(y != "", F.last_day(F.make_date(F.expr("1") * y.try_cast("int"), q.try_cast("int") * 3, F.lit(1))))


def ended_quarters(as_of, n: int) -> Column:
    """SCL-12: array of the last n calendar quarters that ended before the quarter of
    ``as_of``, newest first."""
    first = F.trunc(_c(as_of), "quarter")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: quarter_key(F.add_months(first, i * -3)))


# --- SCL-03, SCL-04: null-strict arithmetic ------------------------------------

def safe_div(a, b) -> Column:
    """SCL-03: null when a side is missing or the divisor is zero."""
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))


def _strict(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def truth(cond: Column) -> Column:
    """SCL-04: a comparison as 1.0 / 0.0, null when undecided."""
    return cond.cast("int").cast("double")


def both(a, b) -> Column:
    """SCL-04: logical and, null when either side is null."""
    a, b = _c(a), _c(b)
    return _strict(a, b, truth((a != 0) & (b != 0)))


def either(a, b) -> Column:
    """SCL-04: logical or, null when either side is null."""
    a, b = _c(a), _c(b)
    return _strict(a, b, truth((a != 0) | (b != 0)))


def negate(a) -> Column:
    """SCL-04: logical not on a numeric truth value."""
    return truth(_c(a) == 0)


def max_of(a, b) -> Column:
    """SCL-04: larger of two, null when either is null."""
    a, b = _c(a), _c(b)
    return _strict(a, b, F.greatest(a, b))


def min_of(a, b) -> Column:
    """SCL-04: smaller of two, null when either is null."""
    a, b = _c(a), _c(b)
    return _strict(a, b, F.least(a, b))


def change(new, old) -> Column:
    """Relative change on the absolute base; null on a missing or zero base."""
    return safe_div(_c(new) - _c(old), F.abs(_c(old)))


# --- SCL-05..07, SCL-17: bands ---------------------------------------------------

AGREE, SLIGHT, NOTABLE = 0.001, 0.01, 0.05


def spread_severity(spread, sign_flip=None) -> Column:
    """SCL-05: ok / info / warn / error for a relative spread; a sign flip is an error."""
    s = _c(spread)
    out = (F.when(s.isNull() | (s <= AGREE), "ok").when(s <= SLIGHT, "info")
           .when(s <= NOTABLE, "warn").otherwise("error"))
    return out if sign_flip is None else F.when(_c(sign_flip), "error").otherwise(out)


def other_opex(gp, op, rd, sm, ga, sga) -> Column:
    """SCL-06: operating expense left after R&D and selling/general cost."""
    sell = F.coalesce(_c(sga), _c(sm) + _c(ga))
    return _c(gp) - _c(op) - F.coalesce(_c(rd), F.lit(0.0)) - sell


def rescale_thousands(shares, net_income, eps) -> Column:
    """SCL-07: a count filed in thousands is multiplied by 1000 when income / EPS says so."""
    sh, ni, e = _c(shares), _c(net_income), _c(eps)
    ratio = safe_div(F.abs(safe_div(ni, e)), sh)
    return F.when((sh > 0) & (F.abs(e) >= 0.05) & ratio.between(500, 2000), sh * 1000).otherwise(sh)


def cap_tier(cap) -> Column:
    """SCL-17: size band of a market cap."""
    c = _c(cap)
    return (F.when(c.isNull(), None).when(c < 300e6, "micro").when(c < 2e9, "small")
            .when(c < 10e9, "mid").when(c < 200e9, "large").otherwise("mega"))


# --- SCL-08, SCL-11, SCL-14..16: text ---------------------------------------------

def slug(s) -> Column:
    """SCL-08: lower-case, other characters to '-', trimmed; empty becomes 'uncategorized'."""
    x = F.regexp_replace(F.lower(F.coalesce(_c(s), F.lit(""))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(x, "^-+|-+$", ""), F.lit("")), F.lit("uncategorized"))


def number(s) -> Column:
    """SCL-11: text to double; blank, malformed and NaN become null."""
    v = F.nullif(F.trim(_c(s).cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(v), v)


def series_name(s) -> Column:
    """SCL-14: lower-case name of letters, digits and underscores."""
    x = F.regexp_replace(F.lower(F.trim(_c(s))), r"[^a-z0-9_]+", "_")
    return F.regexp_replace(x, "^_+|_+$", "")


def point_period(period, grid) -> Column:
    """SCL-14: period of a series point on its grid: a fiscal year, or a quarter-end date; null
    when it fits neither. A full date on the annual grid counts as its year."""
    p = F.trim(_c(period).cast("string"))
    year = F.when(p.rlike(r"^\d{4}(-\d{2}-\d{2})?$"), F.substring(p, 1, 4))
    return F.when(_c(grid) == "annual", year).otherwise(F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}$"), p))


def point_ok(period, value, grid) -> Column:
    """SCL-14: usable point: its period fits the grid and its value is empty or a number."""
    return point_period(period, grid).isNotNull() & (_c(value).isNull() | number(value).isNotNull())


# Legal-form words dropped from company names.
NAME_SUFFIXES = ["incorporated", "inc", "corporation", "corp", "company", "co", "holding", "holdings",
                 "group", "plc", "ltd", "limited", "llc", "lp", "sa", "nv", "ag", "se", "trust",
                 "bancorp", "the"]


def company_key(s) -> Column:
    """SCL-15: comparable company name: legal-form words removed, lower-case words only."""
    x = F.regexp_replace(F.lower(F.coalesce(_c(s), F.lit(""))),
                         r"\b(" + "|".join(NAME_SUFFIXES) + r")\b\.?", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def title_of(s, width: int = 60) -> Column:
    """SCL-16: one-line title, cut with an ellipsis."""
    x = F.trim(F.regexp_replace(_c(s), r"\s+", " "))
    return F.when(F.length(x) > width, F.concat(F.rtrim(F.left(x, F.lit(width - 1))), F.lit("…"))).otherwise(x)


def collapse(s) -> Column:
    return F.regexp_replace(_c(s), r"\s+", " ")


# --- SCL-13: report titles -----------------------------------------------------------

# Periodic report names, the month-day each closes, and whether its figures
# run from the start of the year.
REPORT_FORMS = [
    ("半年度报告", "06-30", True),
    ("第一季度报告", "03-31", False),
    ("第三季度报告", "09-30", True),
    ("年度报告", "12-31", True),
]
OTHER_FORM = "定期报告"


def report_form(title) -> Column:
    """SCL-13: which periodic report a title announces."""
    t = _c(title)
    return reduce(lambda acc, f: acc.when(t.contains(f[0]), f[0]), REPORT_FORMS[1:],
                  F.when(t.contains(REPORT_FORMS[0][0]), REPORT_FORMS[0][0])).otherwise(OTHER_FORM)


def report_year(title, announced) -> Column:
    """SCL-13: the 20xx year named in a title, else the year before the announcement."""
    y = F.regexp_extract(F.coalesce(_c(title), F.lit("")), r"(20\d{2})\s*年", 1)
    return F.coalesce(F.nullif(y, F.lit("")), (F.year(_c(announced)) - 1).cast("string"))


def report_period(form, year) -> Column:
    """SCL-13: ISO end date of a report's period."""
    f = _c(form)
    md = reduce(lambda acc, r: acc.when(f == r[0], r[1]), REPORT_FORMS[1:],
                F.when(f == REPORT_FORMS[0][0], REPORT_FORMS[0][1])).otherwise("12-31")
    return F.concat(_c(year).cast("string"), F.lit("-"), md)


def report_cumulative(form) -> Column:
    """SCL-13: are the figures cumulative from January."""
    return ~_c(form).isin([r[0] for r in REPORT_FORMS if not r[2]])


# --- SCL-18: payload check --------------------------------------------------------------

def _ddl_fields(schema: str) -> str:
    from pyspark.sql import types as T
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def payload_check(raw, schema: str, required: list[str], enums: dict[str, list[str]] | None = None):
    """SCL-18: parse JSON text and name the first problem.

    Returns (struct column, error column); error is null for a valid payload."""
    # read as the only element of an array, so that text after the object is noticed
    arr = F.from_json(F.concat(F.lit("["), _c(raw), F.lit("]")), f"array<struct<{_ddl_fields(schema)}>>", {"mode": "PERMISSIVE"})
    body = F.get(arr, F.lit(0))
    err = F.when(F.coalesce(F.size(arr), F.lit(0)) != 1, F.lit("not json"))
    for path in required:
        v = body.getField(path) if "." not in path else reduce(lambda c, p: c.getField(p), path.split("."), body)
        err = err.when(v.isNull() | (F.trim(v.cast("string")) == ""), F.lit(f"missing {path}"))
    for path, allowed in (enums or {}).items():
        v = reduce(lambda c, p: c.getField(p), path.split("."), body)
        err = err.when(~v.isin(allowed), F.lit(f"bad {path}"))
    return body, err


# --- SCL-19 --------------------------------------------------------------------------------

def header_cap(cap, native_cap, rate, native) -> Column:
    """SCL-19: market cap in the display unit: the stored native figure (or cap x rate)
    when the company is shown in its own currency, else the USD cap."""
    return F.when(_c(native), F.coalesce(_c(native_cap), _c(cap) * F.coalesce(_c(rate), F.lit(1.0)))).otherwise(_c(cap))


def is_native(quote_ccy, report_ccy) -> Column:
    """SCL-19: quoted and reported in one and the same non-USD currency."""
    return (_c(quote_ccy) == _c(report_ccy)) & (_c(quote_ccy) != "USD")


# --- FLT-21 -----------------------------------------------------------------------------------

def first_of(*cols) -> Column:
    """FLT-21: first non-null among several."""
    return F.coalesce(*[_c(c) for c in cols])


def first_source(values: list, sources: list) -> Column:
    """FLT-21: source tag of the first non-null value."""
    out = F.when(_c(values[0]).isNotNull(), _c(sources[0]))
    for v, s in zip(values[1:], sources[1:]):
        out = out.when(_c(v).isNotNull(), _c(s))
    return out
