"""The most used scalar functions as temporary SQL functions, so that user metrics and ad-hoc SQL can
call them by name. They are SQL bodies that Catalyst inlines, not UDFs."""
from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "safe_div": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN a / nullif(b, 0D)",
    "rel_change": "(new DOUBLE, old DOUBLE) RETURNS DOUBLE RETURN (new - old) / nullif(abs(old), 0D)",
    "fy_of": "(d DATE) RETURNS INT RETURN CASE WHEN month(d) >= 6 THEN year(d) ELSE year(d) - 1 END",
    "both_true": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN double(int(a <> 0 AND b <> 0)) END",
    "any_true": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN double(int(a <> 0 OR b <> 0)) END",
    "max_of": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END",
    "min_of": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END",
    "slug_of": "(s STRING) RETURNS STRING RETURN coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), 'uncategorized')",
}


def register_sql_functions(spark: SparkSession) -> None:
    """UDX-01: create or replace the temporary functions in a session."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
