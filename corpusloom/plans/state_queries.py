"""Queries on the state of the crawl: jobs, items, history, attempts, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import reports, state
from corpusloom.runtime import table

HOSTS = ["www.manuals.example", "manuals.example"]

JOBS = "(SELECT DISTINCT * FROM crawl_jobs)"
ITEMS = """(SELECT * EXCLUDE (n) FROM (
  SELECT * REPLACE (lower(trim(item_id)) AS item_id), row_number() OVER (
    PARTITION BY job_id, lower(trim(item_id)) ORDER BY received_at DESC NULLS LAST, report_row_id DESC) AS n
  FROM report_items WHERE job_id IS NOT NULL AND item_id IS NOT NULL) WHERE n = 1)"""


def _jobs(spark, d):
    return state.distinct_jobs(table(spark, d, "crawl_jobs"))


def _items(spark, d):
    return state.items_of(table(spark, d, "report_items"))


def job_by_id(spark, d):
    return _jobs(spark, d).where("plugin = 'med_atlas' and status = 'completed'").select("job_id", "plugin", "status", "stop_requested")


def items_in_status(spark, d):
    return _items(spark, d).where(F.col("status").isin("parsed", "cleaned")).select("job_id", "item_id", "status")


def items_status_counts(spark, d):
    return _items(spark, d).groupBy("job_id", "status").agg(F.count("*").alias("items"))


def jobs_items_join(spark, d):
    joined = _items(spark, d).select("job_id", "item_id", "status").join(_jobs(spark, d).select("job_id", "plugin"), "job_id")
    return joined.groupBy("plugin", "status").agg(F.count_distinct("item_id").alias("items"))


def completed_item_ids(spark, d):
    parsed = _items(spark, d).where("status = 'parsed'").select("job_id", "item_id")
    return parsed.join(_jobs(spark, d).select("job_id", "plugin"), "job_id").select("plugin", "item_id").distinct()


def anti_join_history(spark, d):
    return reports.new_to_plugin(_items(spark, d), _jobs(spark, d))


def latest_per_item(spark, d):
    rows = table(spark, d, "report_items").where("item_id is not null").withColumn("item_id", F.lower(F.trim("item_id")))
    order = [F.col("received_at").desc_nulls_last(), F.col("report_row_id").desc()]
    return state.latest_rows(rows, ["item_id"], order).select("item_id", "job_id", "report_row_id", "status")


def job_status_view(spark, d):
    counts = _items(spark, d).groupBy("job_id").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "parsed").alias("parsed"))
    return _jobs(spark, d).join(counts, "job_id", "left").select(
        "job_id", "plugin", "status", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("parsed", F.lit(0)).alias("parsed")
    )


def incremental_baseline(spark, d):
    return reports.baselines(_items(spark, d), _jobs(spark, d)).select("job_id", "item_id", "baseline_job", "baseline_hash")


def change_status(spark, d):
    return reports.baselines(_items(spark, d), _jobs(spark, d)).groupBy("job_id", "derived_status").agg(F.count("*").alias("items"))


def record_increment(spark, d):
    return reports.baselines(_items(spark, d), _jobs(spark, d)).select(
        "job_id", "item_id", "derived_status", "baseline_job", "baseline_hash", "previous_content_hash"
    )


def changed_components(spark, d):
    each = _items(spark, d).select("job_id", F.explode("changed_components").alias("component"))
    return each.groupBy("component").agg(F.count("*").alias("items"), F.count_distinct("job_id").alias("jobs"))


def component_diff(spark, d):
    return reports.component_changes(_items(spark, d))


def ordered_warnings(spark, d):
    return reports.ordered_distinct(_items(spark, d), "job_id", "warnings", ["item_id"])


def upsert_items(spark, d):
    items = _items(spark, d).select("item_id", "job_id", "title", "source_url", "status")
    pair = reports.two_latest(items, _jobs(spark, d))
    keep = ["item_id", "title", "source_url", "status"]
    return state.upsert(pair.where("place = 2").select(*keep), pair.where("place = 1").select(*keep), ["item_id"], ["source_url"], ["title"])


def url_canonical(spark, d):
    rows = table(spark, d, "report_items").select("source_url").where("source_url is not null").distinct()
    return rows.select("source_url", urls.canonical_url(F.col("source_url")).alias("canonical"))


def url_item_id(spark, d):
    rows = table(spark, d, "report_items").select("source_url").where("source_url is not null").distinct()
    u = urls.canonical_url(F.col("source_url"))
    return rows.select("source_url", urls.item_id(F.lit("web"), u).alias("id"), urls.candidate_id(F.lit("page"), u).alias("candidate"))


def url_dedup_first_seen(spark, d):
    rows = table(spark, d, "report_items").where("source_url is not null")
    rows = rows.select(urls.canonical_url(F.col("source_url")).alias("canonical"), "received_at", "report_row_id")
    return rows.groupBy("canonical").agg(F.min(F.struct("received_at", "report_row_id")).alias("f"), F.count("*").alias("rows")).select(
        "canonical", F.col("f.report_row_id").alias("first_row"), "rows"
    )


def host_allowlist(spark, d):
    u = F.col("source_url")
    rows = table(spark, d, "report_items").where("source_url is not null")
    return rows.groupBy(urls.host(u).alias("host")).agg(
        F.count("*").alias("rows"), F.count_if(urls.is_allowed(u, HOSTS)).alias("allowed"),
        F.count_if(urls.is_detail(u)).alias("details"), F.count_if(urls.is_mutating(F.lit(""), u)).alias("mutating"),
    )


def candidate_best_per_url(spark, d):
    rows = table(spark, d, "search_candidates").where("url is not null")
    best = F.min_by("candidate_id", F.struct("rank_no", "candidate_id"))
    return rows.groupBy("url").agg(best.alias("candidate_id"), F.min("rank_no").alias("rank_no"))


def item_state_fold(spark, d):
    return state.state_fold(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], "click", "error")


def next_attempt_no(spark, d):
    return state.next_attempt(table(spark, d, "events"), ["user_id", "event_type"])


def stage_progress(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value")
    )


def retry_backoff(spark, d):
    e = state.numbered_attempts(table(spark, d, "events").where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], F.to_date("ts"))
    return e.groupBy("attempt_no").agg(F.count("*").alias("retries")).select(
        "attempt_no", "retries", state.backoff_seconds(F.col("attempt_no"), 2.0, 60.0).alias("wait_seconds")
    )


def crash_recover(spark, d):
    rows = _items(spark, d)
    status = F.when(F.col("status") == "cleaned", "fetching").otherwise(F.col("status"))
    got = state.recovered_status(status, F.coalesce(F.trim("artifact_dir") != "", F.lit(False)))
    return rows.groupBy(got.alias("recovered")).agg(F.count("*").alias("items"))


def batch_select(spark, d):
    rows = _items(spark, d).where("status <> 'parsed'")
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("canonical_url", "item_id"))
    return rows.withColumn("place", first).where("place <= 5").select("job_id", "item_id", "place")


def required_artifacts(spark, d):
    need = F.array(*[F.lit(x) for x in reports.REQUIRED_ARTIFACTS])
    rows = _items(spark, d).select("job_id", F.array_join(F.array_sort(F.array_except(need, F.coalesce("artifacts", F.array().cast("array<string>")))), ",").alias("missing"))
    return rows.groupBy("job_id", "missing").agg(F.count("*").alias("items"))


def job_report(spark, d):
    return reports.job_report(_items(spark, d), _jobs(spark, d))


def kpi_by_plugin(spark, d):
    return reports.kpis(_items(spark, d), _jobs(spark, d))


def missing_field_counts(spark, d):
    return reports.missing_counts(_items(spark, d))


def coverage_checks(spark, d):
    return reports.coverage(_items(spark, d))


def coverage_rollup(spark, d):
    c = reports.coverage(_items(spark, d))
    return c.groupBy("job_id").agg(
        F.count("*").alias("checked"), F.count_if("complete").alias("complete"), F.sum("n_blockers").alias("blockers"),
        F.bool_and("complete").alias("all_complete"),
    )


def coverage_messages(spark, d):
    return reports.coverage_messages(_items(spark, d))


def exception_listing(spark, d):
    rows = _items(spark, d).where("last_error_code is not null or not complete_artifact_set or size(missing_fields) > 2")
    return rows.select("job_id", "item_id", "last_error_code")


def audit_summary(spark, d):
    return reports.audit(_items(spark, d))


def top_complete(spark, d):
    return reports.top_complete(_items(spark, d), 5)


def tokens_rollup(spark, d):
    return reports.token_totals(table(spark, d, "events"))


def cross_job_summary(spark, d):
    return reports.cross_job(_items(spark, d), _jobs(spark, d))


def artifact_rows(spark, d):
    return _items(spark, d).select("job_id", "item_id", F.posexplode("artifacts").alias("pos", "artifact")).select(
        "job_id", "item_id", (F.col("pos") + 1).alias("artifact_order"), "artifact"
    )


QUERIES = [
    job_by_id, items_in_status, items_status_counts, jobs_items_join, completed_item_ids, anti_join_history, latest_per_item,
    job_status_view, incremental_baseline, change_status, record_increment, changed_components, component_diff, ordered_warnings,
    upsert_items, url_canonical, url_item_id, url_dedup_first_seen, host_allowlist, candidate_best_per_url, item_state_fold,
    next_attempt_no, stage_progress, retry_backoff, crash_recover, batch_select, required_artifacts, job_report, kpi_by_plugin,
    missing_field_counts, coverage_checks, coverage_rollup, coverage_messages, exception_listing, audit_summary, top_complete,
    tokens_rollup, cross_job_summary, artifact_rows,
]

CANON = r"""(lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' || lower(regexp_extract(source_url, '^[^:]*://([^/?#]*)', 1))
  || (CASE WHEN regexp_extract(source_url, '^[^:]*://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/'
      ELSE rtrim(regexp_extract(source_url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/') END)
  || (CASE WHEN len(list_filter(string_split(regexp_extract(source_url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))) = 0 THEN ''
      ELSE '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(source_url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))), '&') END))"""

BASELINES = f"""
WITH i AS (SELECT * FROM {ITEMS} JOIN (SELECT job_id, plugin, created_at FROM {JOBS}) USING (job_id)),
b AS (
  SELECT a.job_id, a.item_id, a.snapshot_hash AS h, b.job_id AS baseline_job, lower(b.snapshot_hash) AS baseline_hash, b.content_hash AS previous_content_hash,
    row_number() OVER (PARTITION BY a.job_id, a.item_id ORDER BY b.created_at DESC, b.received_at DESC NULLS LAST, b.job_id) AS n
  FROM i a LEFT JOIN i b ON a.item_id = b.item_id AND a.plugin = b.plugin AND b.created_at < a.created_at
    AND b.status = 'parsed' AND b.snapshot_hash IS NOT NULL AND b.content_hash IS NOT NULL
), r AS (
  SELECT *, CASE WHEN baseline_job IS NULL THEN 'new' WHEN h IS NULL THEN 'unknown' WHEN lower(h) = baseline_hash THEN 'unchanged' ELSE 'updated' END AS derived_status
  FROM b WHERE n = 1
)
"""

COVERAGE = f"""
SELECT job_id, item_id, has_title, has_hash, has_artifacts, has_url, data_ok,
  CAST((NOT has_title)::INT + (NOT has_hash)::INT + (NOT has_artifacts)::INT + (NOT has_url)::INT AS INTEGER) AS n_blockers,
  has_title AND has_hash AND has_artifacts AND has_url AND data_ok AS complete
FROM (SELECT job_id, item_id, coalesce(trim(title) <> '', false) AS has_title, coalesce(trim(content_hash) <> '', false) AS has_hash,
  coalesce(len(list_filter(['raw.html', 'clean.md', 'disease.json'], lambda x: NOT list_contains(artifacts, x))) = 0, false) AS has_artifacts,
  coalesce(trim(canonical_url) <> '', false) AS has_url, coalesce(len(missing_fields) = 0, false) AS data_ok FROM {ITEMS})
"""

SQL = {
    "job_by_id": f"SELECT job_id, plugin, status, stop_requested FROM {JOBS} WHERE plugin = 'med_atlas' AND status = 'completed'",
    "items_in_status": f"SELECT job_id, item_id, status FROM {ITEMS} WHERE status IN ('parsed', 'cleaned')",
    "items_status_counts": f"SELECT job_id, status, count(*) AS items FROM {ITEMS} GROUP BY ALL",
    "jobs_items_join": f"SELECT plugin, status, count(DISTINCT item_id) AS items FROM {ITEMS} i JOIN (SELECT job_id, plugin FROM {JOBS}) USING (job_id) GROUP BY ALL",
    "completed_item_ids": f"SELECT DISTINCT plugin, item_id FROM {ITEMS} i JOIN (SELECT job_id, plugin FROM {JOBS}) USING (job_id) WHERE i.status = 'parsed'",
    "anti_join_history": f"""WITH i AS (SELECT i.job_id, item_id, i.status, plugin, created_at FROM {ITEMS} i JOIN (SELECT job_id, plugin, created_at FROM {JOBS}) USING (job_id))
        SELECT job_id, item_id FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.item_id = a.item_id AND b.plugin = a.plugin AND b.status = 'parsed' AND b.created_at < a.created_at)""",
    "latest_per_item": """SELECT item_id, job_id, report_row_id, status FROM (SELECT * REPLACE (lower(trim(item_id)) AS item_id),
        row_number() OVER (PARTITION BY lower(trim(item_id)) ORDER BY received_at DESC NULLS LAST, report_row_id DESC) n FROM report_items WHERE item_id IS NOT NULL) WHERE n = 1""",
    "job_status_view": f"""SELECT j.job_id, plugin, j.status, count(i.item_id) AS items, count(*) FILTER (i.status = 'parsed') AS parsed
        FROM {JOBS} j LEFT JOIN {ITEMS} i USING (job_id) GROUP BY ALL""",
    "incremental_baseline": BASELINES + "SELECT job_id, item_id, baseline_job, baseline_hash FROM r",
    "change_status": BASELINES + "SELECT job_id, derived_status, count(*) AS items FROM r GROUP BY ALL",
    "record_increment": BASELINES + "SELECT job_id, item_id, derived_status, baseline_job, baseline_hash, previous_content_hash FROM r",
    "changed_components": f"SELECT component, count(*) AS items, count(DISTINCT job_id) AS jobs FROM (SELECT job_id, unnest(changed_components) AS component FROM {ITEMS}) GROUP BY ALL",
    "component_diff": f"""WITH l AS (SELECT item_id, job_id, lower(content_hash) AS c, lower(snapshot_hash) AS s, sha256(lower(trim(title))) AS t, received_at, report_row_id FROM {ITEMS}),
        w AS (SELECT *, lag(c) OVER o AS pc, lag(s) OVER o AS ps, lag(t) OVER o AS pt, row_number() OVER o AS n FROM l WINDOW o AS (PARTITION BY item_id ORDER BY received_at NULLS FIRST, report_row_id))
        SELECT item_id, job_id, array_to_string(list_filter([CASE WHEN c IS DISTINCT FROM pc THEN 'main' END, CASE WHEN s IS DISTINCT FROM ps THEN 'snapshot' END, CASE WHEN t IS DISTINCT FROM pt THEN 'title' END], lambda x: x IS NOT NULL), ',') AS changed FROM w WHERE n > 1""",
    "ordered_warnings": f"""WITH e AS (SELECT job_id, item_id, unnest(warnings) AS value, generate_subscripts(warnings, 1) AS i FROM {ITEMS}),
        f AS (SELECT job_id, value, min((item_id, i)) AS f FROM e GROUP BY ALL)
        SELECT job_id, value, CAST(row_number() OVER (PARTITION BY job_id ORDER BY f, value) AS INTEGER) AS place FROM f""",
    "upsert_items": f"""WITH p AS (SELECT i.*, dense_rank() OVER (PARTITION BY plugin ORDER BY created_at DESC, job_id) AS place FROM {ITEMS} i JOIN (SELECT job_id, plugin, created_at, status AS js FROM {JOBS}) USING (job_id) WHERE js = 'completed'),
        o AS (SELECT * FROM p WHERE place = 2), n AS (SELECT * FROM p WHERE place = 1)
        SELECT coalesce(n.item_id, o.item_id) AS item_id, coalesce(n.title, o.title) AS title,
          CASE WHEN n.item_id IS NOT NULL THEN n.source_url ELSE o.source_url END AS source_url, o.status AS status
        FROM o FULL JOIN n ON o.item_id = n.item_id""",
    "url_canonical": f"SELECT source_url, {CANON} AS canonical FROM (SELECT DISTINCT source_url FROM report_items WHERE source_url IS NOT NULL)",
    "url_item_id": f"""SELECT source_url, sha256('web' || chr(10) || {CANON}) AS id, 'candidate-' || substr(sha256('page' || chr(10) || {CANON}), 1, 20) AS candidate
        FROM (SELECT DISTINCT source_url FROM report_items WHERE source_url IS NOT NULL)""",
    "url_dedup_first_seen": f"""SELECT canonical, arg_min(report_row_id, (received_at, report_row_id)) AS first_row, count(*) AS rows
        FROM (SELECT {CANON} AS canonical, received_at, report_row_id FROM report_items WHERE source_url IS NOT NULL) GROUP BY ALL""",
    "host_allowlist": r"""SELECT host, count(*) AS rows, count(*) FILTER (host IN ('www.manuals.example', 'manuals.example') AND regexp_matches(source_url, '(?i)^https?://')) AS allowed,
        count(*) FILTER (regexp_matches(regexp_replace(source_url, '[?#].*$', ''), '(?i)(/([a-z]{2}_)?(med|medical|disease)_[^/?#]+\.html?|/diseases?/[^/?#]+/?)$')) AS details,
        count(*) FILTER (regexp_matches(regexp_extract(source_url, '^[^:]*://[^/?#]*([^?#]*)', 1), '(?i)edit|cart|delete|logout')) AS mutating
        FROM (SELECT *, lower(regexp_extract(source_url, '^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM report_items WHERE source_url IS NOT NULL) GROUP BY host""",
    "candidate_best_per_url": "SELECT url, arg_min(candidate_id, (rank_no, candidate_id)) AS candidate_id, min(rank_no) AS rank_no FROM search_candidates WHERE url IS NOT NULL GROUP BY url",
    "item_state_fold": """SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type = 'click') AS attempts,
        count(*) FILTER (event_type = 'error') AS failures, count(*) AS n_events FROM events GROUP BY user_id""",
    "next_attempt_no": "SELECT user_id, event_type, CAST(count(*) + 1 AS INTEGER) AS next_attempt_no FROM events GROUP BY ALL",
    "stage_progress": "SELECT user_id, event_type, min(ts) AS started_at, max(ts) AS finished_at, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL",
    "retry_backoff": """SELECT CAST(a AS INTEGER) AS attempt_no, count(*) AS retries, least(2.0::DOUBLE * pow(2, a - 1), 60.0::DOUBLE) AS wait_seconds
        FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events WHERE event_type = 'error') GROUP BY a""",
    "crash_recover": f"""SELECT CASE WHEN status = 'cleaned' THEN (CASE WHEN coalesce(trim(artifact_dir) <> '', false) THEN 'fetched' ELSE 'discovered' END) ELSE status END AS recovered,
        count(*) AS items FROM {ITEMS} GROUP BY ALL""",
    "batch_select": f"""SELECT job_id, item_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY canonical_url NULLS FIRST, item_id) AS place
        FROM {ITEMS} WHERE status <> 'parsed') WHERE place <= 5""",
    "required_artifacts": f"""SELECT job_id, array_to_string(list_sort(list_filter(['raw.html', 'clean.md', 'disease.json'], lambda x: NOT list_contains(coalesce(artifacts, []), x))), ',') AS missing,
        count(*) AS items FROM {ITEMS} GROUP BY ALL""",
    "job_report": f"""SELECT j.job_id, plugin, j.status, count(i.item_id) AS total, count(*) FILTER (i.status = 'parsed') AS parsed, count(*) FILTER (last_error_code IS NOT NULL) AS failed,
        count(*) FILTER (change_status = 'new') AS new_items, count(*) FILTER (change_status = 'updated') AS updated_items, count(*) FILTER (change_status = 'unchanged') AS unchanged_items,
        CAST(coalesce(sum(len(missing_fields)), 0) AS BIGINT) AS missing_fields, count(*) FILTER (i.complete_artifact_set) AS complete_sets
        FROM {JOBS} j LEFT JOIN {ITEMS} i USING (job_id) GROUP BY ALL""",
    "kpi_by_plugin": f"""SELECT plugin, count(*) AS rows, count(DISTINCT item_id) AS items, round_even(100.0::DOUBLE * count(*) FILTER (i.status = 'parsed') / nullif(count(*), 0), 2) AS parsed_pct,
        round_even(100.0::DOUBLE * count(*) FILTER (change_status = 'unchanged') / nullif(count(*) FILTER (change_status IS NOT NULL), 0), 2) AS reuse_pct,
        round_even(count(*)::DOUBLE / nullif(count(DISTINCT i.job_id), 0), 2) AS items_per_job
        FROM {ITEMS} i JOIN (SELECT job_id, plugin FROM {JOBS}) USING (job_id) GROUP BY plugin""",
    "missing_field_counts": f"SELECT name, count(*) AS items FROM (SELECT DISTINCT job_id, item_id, unnest(list_transform(missing_fields, lambda x: lower(trim(x)))) AS name FROM {ITEMS}) GROUP BY name",
    "coverage_checks": COVERAGE,
    "coverage_rollup": f"SELECT job_id, count(*) AS checked, count(*) FILTER (complete) AS complete, CAST(sum(n_blockers) AS BIGINT) AS blockers, bool_and(complete) AS all_complete FROM ({COVERAGE}) GROUP BY job_id",
    "coverage_messages": f"""SELECT job_id, item_id, 'blocker' AS kind, b AS message FROM (SELECT job_id, item_id, unnest([CASE WHEN NOT has_title THEN 'title' END, CASE WHEN NOT has_hash THEN 'content_hash' END,
        CASE WHEN NOT has_artifacts THEN 'artifacts' END, CASE WHEN NOT has_url THEN 'canonical_url' END]) AS b FROM ({COVERAGE})) WHERE b IS NOT NULL
        UNION ALL SELECT job_id, item_id, 'warning', unnest(list_transform(missing_fields, lambda x: 'missing_field:' || lower(trim(x)))) FROM {ITEMS}""",
    "exception_listing": f"SELECT job_id, item_id, last_error_code FROM {ITEMS} WHERE last_error_code IS NOT NULL OR NOT complete_artifact_set OR len(missing_fields) > 2",
    "audit_summary": f"""SELECT count(*) AS items, count(*) FILTER (data_complete) AS complete, round_even(100.0::DOUBLE * count(*) FILTER (data_complete) / nullif(count(*), 0), 2) AS complete_pct,
        count(DISTINCT lower(content_hash)) AS contents, count(*) FILTER (title IS NULL OR trim(title) = '') AS untitled,
        round_even(avg(len(missing_fields)), 2) AS mean_missing, CAST(max(len(missing_fields)) AS INTEGER) AS most_missing FROM {ITEMS}""",
    "top_complete": f"""SELECT item_id, job_id, CAST(filled AS INTEGER) AS filled, CAST(n_chars AS INTEGER) AS n_chars FROM (SELECT item_id, job_id, 10 - len(missing_fields) AS filled, length(coalesce(title, '')) AS n_chars, lower(coalesce(title, '')) AS folded FROM {ITEMS} WHERE missing_fields IS NOT NULL)
        ORDER BY filled DESC, n_chars DESC, folded DESC, job_id, item_id LIMIT 5""",
    "tokens_rollup": """SELECT event_type, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, round_even(avg(value), 4) AS mean_value FROM events GROUP BY ROLLUP (event_type)""",
    "cross_job_summary": f"""SELECT count(DISTINCT canonical_url) AS urls, count(DISTINCT nullif(lower(trim(title)), '')) AS titles, count(DISTINCT item_id) AS items, count(DISTINCT i.job_id) AS jobs
        FROM {ITEMS} i JOIN (SELECT job_id, status AS js FROM {JOBS}) USING (job_id) WHERE js = 'completed' AND i.status = 'parsed'""",
    "artifact_rows": f"SELECT job_id, item_id, CAST(unnest(generate_series(1, len(artifacts))) AS INTEGER) AS artifact_order, unnest(artifacts) AS artifact FROM {ITEMS}",
}
