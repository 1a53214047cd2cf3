"""Queries of the general data-quality operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diskloom.operators.orphans import orphan_references, orphan_report
from diskloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """File references to discs and images that did not hold when the file was seen."""
    return orphan_references(
        table(spark, d, "library_files"), {"disks": ("disk_id", table(spark, d, "disks")), "images": ("image_id", table(spark, d, "images"))}
    )


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """The same references counted per table, month and cause."""
    return orphan_report(p2_found(spark, d))


_P2 = """
    SELECT DISTINCT f.id AS file_id, '{t}' AS ref_table, strftime(f.last_seen, '%Y-%m') AS period,
           CASE WHEN p.id IS NULL THEN 'missing' WHEN p.added_at > f.last_seen THEN 'late' ELSE 'deleted' END AS cause
    FROM library_files f LEFT JOIN {t} p ON p.id = f.{fk}
    WHERE f.{fk} IS NOT NULL AND (p.id IS NULL OR p.added_at > f.last_seen OR p.removed_at <= f.last_seen)
"""
_P2_FOUND = _P2.format(t="disks", fk="disk_id") + " UNION " + _P2.format(t="images", fk="image_id")

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _P2_FOUND,
    "p2_report": f"SELECT ref_table, period, cause, count(*) AS n_references, count(DISTINCT file_id) AS n_files FROM ({_P2_FOUND}) GROUP BY ALL",
}
