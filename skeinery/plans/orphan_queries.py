"""Queries on orphan references and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinery.operators.orphans import orphan_references, orphan_report
from skeinery.session import prepare, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return orphan_references(table(spark, d, "link_records"), table(spark, d, "page_records"), table(spark, d, "page_tombstones"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("link_id", "ref_field", "kind")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


_ORPHANS = """
WITH refs AS (
  SELECT link_id, 'from_page' AS ref_field, from_page AS key, discovered_at FROM link_records WHERE from_page IS NOT NULL
  UNION ALL
  SELECT link_id, 'to_page', to_page, discovered_at FROM link_records WHERE to_page IS NOT NULL
), one AS (
  SELECT link_id, ref_field, arg_min(key, discovered_at) AS key, min(discovered_at) AS discovered_at FROM refs GROUP BY link_id, ref_field
), parents AS (
  SELECT page_id, min(crawled_at) AS parent_at FROM page_records GROUP BY page_id
), gone AS (
  SELECT DISTINCT page_id FROM page_tombstones
), judged AS (
  SELECT o.*, CASE WHEN p.page_id IS NULL THEN CASE WHEN g.page_id IS NULL THEN 'missing' ELSE 'deleted' END
                   WHEN p.parent_at > o.discovered_at + INTERVAL 7 DAY THEN 'late' END AS kind
  FROM one o LEFT JOIN parents p ON p.page_id = o.key LEFT JOIN gone g ON g.page_id = o.key
)
"""

QUERIES = {"p7_found": p7_found, "p7_report": p7_report}

SQL = {
    "p7_found": _ORPHANS + "SELECT link_id, ref_field, kind FROM judged WHERE kind IS NOT NULL",
    "p7_report": _ORPHANS
    + """SELECT 'link_records' AS child_table, ref_field, strftime(discovered_at AT TIME ZONE 'UTC', '%Y-%m') AS month, kind,
         count(*) AS n_orphans, count(DISTINCT key) AS n_keys
         FROM judged WHERE kind IS NOT NULL GROUP BY ref_field, month, kind""",
}
