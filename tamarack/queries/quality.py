"""Queries of the general training-data problems: orphan references (1) and units (3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.operators import orphans, units
from tamarack.queries import orphan_sql, unit_sql

QUERIES = {
    "p1_found": lambda spark, d: orphans.orphans_of(spark, d).select("from_table", "row_id", "col_name", "reason"),
    "p1_report": lambda spark, d: orphans.orphan_report(orphans.orphans_of(spark, d)),
    "p3_found": lambda spark, d: units.other_units(units.values_of(spark, d)),
    "p3_values": lambda spark, d: units.values_of(spark, d).select("row_id", "col_name", "quantity", "unit", "common", F.round("value", 6).alias("value")),
}
ORACLE = {"p1_found": orphan_sql.P1_FOUND, "p1_report": orphan_sql.P1_REPORT, "p3_found": unit_sql.P3_FOUND}
