"""Clean-up of differences and the figures of reports, over rows derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleanup import cleaned, report
from .mechanisms import _NUMBER_SQL, numbered_lines
from .registry import query

# An order is a job and its lines are differences: few values, some in the margins, some page numbers and cells.
_SQL_LINES = f"""x AS (SELECT l_orderkey AS job, k AS number, CASE WHEN l_suppkey % 5 = 0 THEN 'Page ' || CAST(k AS VARCHAR) || ' of 9' ELSE 'Status ' || l_returnflag END AS before, CASE WHEN l_partkey % 4 = 0 THEN 'x' ELSE 'Status ' || l_linestatus END AS after,
k % 2 + 1 AS page, CASE WHEN l_quantity > 40 THEN 'table_cell_change' ELSE 'text_modification' END AS type, l_partkey % 3 = 0 AS zone, CASE l_returnflag WHEN 'A' THEN 'material' WHEN 'N' THEN 'substantive' ELSE 'cosmetic' END AS significance FROM (SELECT *, {_NUMBER_SQL} AS k FROM lineitem))"""


def _lines(spark, d):
    number = F.col("k")
    before = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("Page "), number.cast("string"), F.lit(" of 9"))).otherwise(F.concat(F.lit("Status "), "l_returnflag"))
    after = F.when(F.col("l_partkey") % 4 == 0, "x").otherwise(F.concat(F.lit("Status "), "l_linestatus"))
    page = (number % 2 + 1).cast("long")
    significance = F.when(F.col("l_returnflag") == "A", "material").when(F.col("l_returnflag") == "N", "substantive").otherwise("cosmetic")
    return numbered_lines(spark, d).select(
        F.col("l_orderkey").alias("job"), number.alias("number"), before.alias("before"), after.alias("after"), page.alias("page_a"), page.alias("page_b"), F.when(F.col("l_quantity") > 40, "table_cell_change").otherwise("text_modification").alias("type"),
        F.when(F.col("l_partkey") % 3 == 0, 0.02).otherwise(0.4).alias("y_a"), F.lit(0.05).alias("height_a"), F.lit(0.4).alias("y_b"), F.lit(0.05).alias("height_b"), F.lit("text").alias("context"), significance.alias("significance"), F.lit(0.9).alias("confidence"), F.lit(False).alias("auto_confirmed"), F.lit("line").alias("summary"),
    )


@query(rf"""WITH {_SQL_LINES},
m AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY job, before, after, type, zone ORDER BY number) AS r FROM x WINDOW w AS (PARTITION BY job, before, after, type, zone)),
z AS (SELECT *, zone AND n > 1 AS several FROM m WHERE NOT zone OR r = 1),
p AS (SELECT * FROM z WHERE NOT regexp_matches(before, '(?i)^\s*(?:page\s+)?\d+\s*(?:of\s+\d+)?\s*$')),
s AS (SELECT *, row_number() OVER (PARTITION BY job, before, after, page, type ORDER BY number) AS k FROM p)
SELECT job, CAST(row_number() OVER (PARTITION BY job ORDER BY number) AS INTEGER) AS number, before, after, page AS page_a, CASE WHEN several THEN 'cosmetic' ELSE significance END AS significance, CAST(CASE WHEN several THEN 0.98 ELSE 0.9 END AS DOUBLE) AS confidence, several AS auto_confirmed, CASE WHEN several THEN 'line (repeated on ' || CAST(n AS VARCHAR) || ' pages)' ELSE 'line' END AS summary
FROM s WHERE k = 1 OR type = 'table_cell_change'""")
def difference_cleanup(spark, d):
    """Repeats in the margins collapse, page numbers go and equal values of a page keep their first, job by job."""
    return cleaned(_lines(spark, d)).select("job", "number", "before", "after", "page_a", "significance", "confidence", "auto_confirmed", "summary")


@query(rf"""WITH {_SQL_LINES}, s AS (SELECT job, CASE WHEN zone AND page = 1 THEN 'uncertain' ELSE significance END AS significance, ['confirmed', 'dismissed', 'flagged', 'corrected', 'pending'][number % 5 + 1] AS status FROM x),
g AS (SELECT job, count(*) AS total, count(*) FILTER (significance = 'material') AS material, count(*) FILTER (significance = 'substantive') AS substantive, count(*) FILTER (significance = 'cosmetic') AS cosmetic, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'dismissed') AS dismissed, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (status = 'corrected') AS corrected, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status <> 'pending') AS verified FROM s GROUP BY job)
SELECT *, verified < total AS is_partial, CASE WHEN verified < total THEN '[PARTIAL] ' ELSE '' END || CASE WHEN material > 0 THEN material || ' material difference(s) found — documents contain substantively different content requiring review.' WHEN substantive > 0 THEN substantive || ' substantive difference(s) found — documents differ in meaningful ways with no material impact.' WHEN cosmetic > 0 THEN cosmetic || ' cosmetic difference(s) only — documents are functionally equivalent.' ELSE 'No differences detected — documents appear identical.' END AS verdict FROM g""")
def report_verdict(spark, d):
    """Eleven figures of a report, whether it is partial, and its verdict."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("confirmed", "dismissed", "flagged", "corrected", "pending")]), (F.col("number") % 5 + 1).cast("int"))
    x = _lines(spark, d)
    unsure = (F.col("y_a") < 0.1) & (F.col("page_a") == 1)
    return report(x.withColumns({"significance": F.when(unsure, "uncertain").otherwise(F.col("significance")), "status": status}))
