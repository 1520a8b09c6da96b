"""Problem 3 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators.orphans import citation_orphans, orphans_per_period
from quire.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return citation_orphans(table(spark, folder, "markers"), table(spark, folder, "bib_entries"))


def p3_per_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphans_per_period(p3_found(spark, folder))


_FOUND = r"""
  SELECT DISTINCT r.from_table, r.from_id, r.cite_key, strftime(r.t, '%Y-%m') AS period
  FROM (SELECT from_table, from_id, doc_id, t, regexp_replace(k, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS cite_key
        FROM (SELECT 'markers' AS from_table, marker_id AS from_id, doc_id, edited_at AS t, unnest(keys) AS k FROM markers
              UNION ALL
              SELECT 'bib_entries', entry_id, doc_id, added_at, unnest(map_extract(fields, 'crossref')) FROM bib_entries)) r
  WHERE r.cite_key <> '' AND r.t IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM bib_entries b
                    WHERE b.doc_id = r.doc_id AND regexp_replace(b.key, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') = r.cite_key
                      AND b.added_at <= r.t AND (b.deleted_at IS NULL OR b.deleted_at > r.t))
"""

QUERIES = {"p3_found": p3_found, "p3_per_month": p3_per_month}
SQL = {
    "p3_found": _FOUND,
    "p3_per_month": f"SELECT from_table, period, count(*) AS n_refs, count(DISTINCT cite_key) AS n_keys FROM ({_FOUND}) GROUP BY 1, 2",
}
