"""Named queries of the core and the SQL they are checked against."""

from __future__ import annotations

from corpusloom.operators import snapshot_diff
from corpusloom.plans import evidence_queries, state_queries, text_queries
from corpusloom.runtime import table


PARTS = [state_queries, text_queries, evidence_queries]


def p2_found(spark, folder):
    return snapshot_diff.snapshot_changes(table(spark, folder, "report_items"), table(spark, folder, "crawl_jobs"))


def queries():
    return {"p2_found": p2_found} | {f.__name__: f for part in PARTS for f in part.QUERIES}


P2_FOUND = """
WITH jobs AS (
  SELECT job_id, min(plugin) AS plugin, min(created_at) AS created_at FROM crawl_jobs
  WHERE status = 'completed' GROUP BY job_id
), ordered AS (
  SELECT *, lead(job_id) OVER (PARTITION BY plugin ORDER BY created_at, job_id) AS next_job FROM jobs
), members AS (
  SELECT job_id, lower(trim(item_id)) AS item_id,
    arg_max(CASE WHEN trim(snapshot_hash) <> '' THEN lower(trim(snapshot_hash)) END, (received_at, report_row_id)) AS h
  FROM report_items JOIN jobs USING (job_id) WHERE item_id IS NOT NULL GROUP BY 1, 2
), pairs AS (
  SELECT job_id AS old_job, next_job AS new_job FROM ordered WHERE next_job IS NOT NULL
), old AS (
  SELECT p.new_job, m.item_id, m.h FROM pairs p JOIN members m ON m.job_id = p.old_job
), new AS (
  SELECT p.new_job, m.item_id, m.h FROM pairs p JOIN members m ON m.job_id = p.new_job
)
SELECT new_job AS job_id, item_id,
  CASE WHEN o.here IS NULL THEN 'added' WHEN n.here IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT *, true AS here FROM old) o FULL JOIN (SELECT *, true AS here FROM new) n USING (new_job, item_id)
WHERE o.here IS NULL OR n.here IS NULL OR o.h <> n.h
"""


def oracle_sql():
    return {"p2_found": P2_FOUND} | {name: sql for part in PARTS for name, sql in part.SQL.items()}
