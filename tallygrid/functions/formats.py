"""Display formats (SCL-09, SCL-10). Numbers are rounded half-even as the printed form
of a double is, so a figure reads the same wherever it is shown."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions.scalars import _c

# Symbols of reporting currencies.
CURRENCY_SYMBOLS = {"USD": "$", "CNY": "¥", "HKD": "HK$", "EUR": "€", "GBP": "£", "JPY": "¥"}

_SCALES = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]


def currency_symbol(code) -> Column:
    """SCL-10: symbol of a currency code; unknown codes give an empty text."""
    c = F.upper(F.coalesce(F.nullif(_c(code), F.lit("")), F.lit("USD")))
    out = F.lit("")
    for k, v in CURRENCY_SYMBOLS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def fixed(v, decimals: int, commas: bool = False) -> Column:
    x = _c(v).cast("double")
    r = F.bround(x, decimals)
    sign = F.when((x < 0) & (r == 0), "-").otherwise("")          # a tiny negative prints as -0.0
    return F.when(x.isNotNull(), F.concat(sign, F.format_string(f"%{',' if commas else ''}.{decimals}f", r)))


def money(v, decimals: int = 0, symbol="$", missing: str = "n/a") -> Column:
    """SCL-09: 1.5B style amount with a fixed number of decimals."""
    return _scaled(v, symbol, missing, {s: decimals for _, s in _SCALES} | {"": decimals})


def money_compact(v, symbol="$") -> Column:
    """SCL-09: table variant: blank when missing, one decimal from a billion up."""
    return _scaled(v, symbol, "", {"T": 1, "B": 1, "M": 0, "K": 0, "": 0})


def _scaled(v, symbol, missing, decimals) -> Column:
    x = _c(v).cast("double")
    sym = symbol if isinstance(symbol, Column) else F.lit(symbol)
    out = F.when(x.isNull(), F.lit(missing))
    for scale, letter in _SCALES:
        out = out.when(F.abs(x) >= scale, F.concat(sym, fixed(x / scale, decimals[letter]), F.lit(letter)))
    return out.otherwise(F.concat(sym, fixed(x, decimals[""])))


def percent(v, decimals: int = 0, missing: str = "n/a") -> Column:
    """SCL-09: 0.25 to '25%'."""
    return F.coalesce(F.concat(fixed(_c(v) * 100, decimals), F.lit("%")), F.lit(missing))


def grouped(v, decimals: int = 0, missing: str = "n/a") -> Column:
    """SCL-09: thousands separators."""
    return F.coalesce(fixed(v, decimals, commas=True), F.lit(missing))


def ratio_x(v, decimals: int = 1, missing: str = "—") -> Column:
    """SCL-09: multiple with a trailing x."""
    return F.coalesce(F.concat(fixed(v, decimals), F.lit("x")), F.lit(missing))


def per_share(v, decimals: int = 2, symbol: str = "$", missing: str = "n/a") -> Column:
    """SCL-09: amount per share."""
    return F.coalesce(F.concat(F.lit(symbol), fixed(v, decimals)), F.lit(missing))


def share_count(v, missing: str = "—") -> Column:
    """SCL-09: share count in millions."""
    return F.coalesce(F.concat(fixed(_c(v) / 1e6, 1, commas=True), F.lit("M")), F.lit(missing))
