"""History, coverage and reports over jobs and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED_ARTIFACTS = ("raw.html", "clean.md", "disease.json")
FIELD_COUNT = 10


def percent(n, of):
    """Rounded to two places, halves to even; null of nothing."""
    return F.bround(F.lit(100.0) * n / F.nullif(of, F.lit(0)), 2)


def baselines(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each item of each job with its baseline: the last parsed row of the item in an earlier job.

    Columns baseline_job, baseline_hash, previous_content_hash and derived_status (new,
    unchanged, updated, or unknown without a hash). The last qualifying row before this one
    is found by a window over each item's own history, one row for each job, so that no
    pairs of jobs are made.
    """
    rows = items.join(jobs.select("job_id", "plugin", "created_at"), "job_id")
    good = (F.col("status") == "parsed") & F.col("snapshot_hash").isNotNull() & F.col("content_hash").isNotNull()
    found = F.when(good, F.struct(F.col("job_id").alias("job"), F.lower("snapshot_hash").alias("hash"), F.col("content_hash").alias("content")))
    earlier = Window.partitionBy("plugin", "item_id").orderBy("created_at", F.col("received_at").asc_nulls_first(), F.col("job_id").desc())
    before = F.last(found, ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__b", before).select(
        "job_id", "item_id", F.col("__b.job").alias("baseline_job"), F.col("__b.hash").alias("baseline_hash"),
        F.col("__b.content").alias("previous_content_hash"),
        F.when(F.col("__b").isNull(), "new").when(F.col("snapshot_hash").isNull(), "unknown")
        .when(F.lower("snapshot_hash") == F.col("__b.hash"), "unchanged").otherwise("updated").alias("derived_status"),
    )


def new_to_plugin(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, item_id) of items that no earlier job of the plugin has parsed."""
    rows = items.join(jobs.select("job_id", "plugin", "created_at"), "job_id")
    first = rows.where("status = 'parsed'").groupBy("plugin", "item_id").agg(F.min("created_at").alias("first_parsed"))
    return rows.join(first, ["plugin", "item_id"], "left").where(
        F.col("first_parsed").isNull() | (F.col("first_parsed") >= F.col("created_at"))
    ).select("job_id", "item_id")


def two_latest(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items of the two latest completed jobs of each plugin, with place 1 and 2."""
    place = F.row_number().over(Window.partitionBy("plugin").orderBy(F.col("created_at").desc(), "job_id"))
    latest = jobs.where("status = 'completed'").withColumn("place", place).where("place <= 2").select("job_id", "place")
    return items.join(F.broadcast(latest), "job_id")  # two jobs for each plugin


def component_changes(items: DataFrame) -> DataFrame:
    """(item_id, job_id, changed): names of components that differ from the item's row before.

    Components are a map of names to hashes; those that only one side has differ.
    """
    components = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("main").alias("k"), F.lower("content_hash").alias("v")),
                F.struct(F.lit("snapshot").alias("k"), F.lower("snapshot_hash").alias("v")),
                F.struct(F.lit("title").alias("k"), F.sha2(F.lower(F.trim("title")), 256).alias("v")),
            ),
            lambda x: x["v"].isNotNull(),
        )
    )
    rows = items.withColumn("now", components)
    past = F.lag("now").over(Window.partitionBy("item_id").orderBy("received_at", "report_row_id"))
    rows = rows.withColumn("past", past).where("past is not null")
    zipped = F.map_zip_with("now", "past", lambda k, a, b: ~a.eqNullSafe(b))
    names = F.array_sort(F.map_keys(F.map_filter(zipped, lambda k, v: v)))
    return rows.select("item_id", "job_id", F.array_join(names, ",").alias("changed"))


def ordered_distinct(rows: DataFrame, key: str, values: str, order: list[str]) -> DataFrame:
    """(key, value, place): distinct values of an array column in the order they first come."""
    each = rows.select(key, *order, F.posexplode(values).alias("__i", "value"))
    first = each.groupBy(key, "value").agg(F.min(F.struct(*order, "__i")).alias("f"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("f", "value"))
    return first.select(key, "value", place.alias("place"))


def job_report(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row for each job, also for those without items."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    counts = items.groupBy("job_id").agg(
        F.count("*").alias("total"), is_("status", "parsed").alias("parsed"), F.count("last_error_code").alias("failed"),
        is_("change_status", "new").alias("new_items"), is_("change_status", "updated").alias("updated_items"),
        is_("change_status", "unchanged").alias("unchanged_items"),
        F.coalesce(F.sum(F.size("missing_fields")), F.lit(0)).alias("missing_fields"),
        F.count_if("complete_artifact_set").alias("complete_sets"),
    )
    names = [c for c in counts.columns if c != "job_id"]
    return jobs.join(counts, "job_id", "left").select("job_id", "plugin", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def kpis(items: DataFrame, jobs: DataFrame) -> DataFrame:
    rows = items.join(jobs.select("job_id", "plugin"), "job_id")
    n = F.count("*")
    return rows.groupBy("plugin").agg(
        n.alias("rows"), F.count_distinct("item_id").alias("items"),
        percent(F.count_if(F.col("status") == "parsed"), n).alias("parsed_pct"),
        percent(F.count_if(F.col("change_status") == "unchanged"), F.count("change_status")).alias("reuse_pct"),
        F.bround(n / F.nullif(F.count_distinct("job_id"), F.lit(0)), 2).alias("items_per_job"),
    )


def missing_counts(items: DataFrame) -> DataFrame:
    each = items.select(F.explode(F.array_distinct(F.transform("missing_fields", lambda x: F.lower(F.trim(x))))).alias("name"))
    return each.groupBy("name").agg(F.count("*").alias("items"))


def coverage(items: DataFrame) -> DataFrame:
    """Checks of each item, how many of the blocking ones fail, and whether all hold."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    need = F.array(*[F.lit(x) for x in REQUIRED_ARTIFACTS])
    checks = {
        "has_title": filled("title"), "has_hash": filled("content_hash"),
        "has_artifacts": F.coalesce(F.size(F.array_except(need, "artifacts")) == 0, F.lit(False)),
        "has_url": filled("canonical_url"), "data_ok": F.coalesce(F.size("missing_fields") == 0, F.lit(False)),
    }
    rows = items.select("job_id", "item_id", *[c.alias(k) for k, c in checks.items()])
    blocking = F.array("has_title", "has_hash", "has_artifacts", "has_url")
    return rows.withColumns(
        {
            "n_blockers": F.size(F.filter(blocking, lambda x: ~x)),
            "complete": F.forall(F.array(*checks), lambda x: x),
        }
    )


def coverage_messages(items: DataFrame) -> DataFrame:
    """(job_id, item_id, kind, message): failed checks as blockers, missing fields as warnings."""
    named = {"has_title": "title", "has_hash": "content_hash", "has_artifacts": "artifacts", "has_url": "canonical_url"}
    failed = F.array_compact(F.array(*[F.when(~F.col(c), n) for c, n in named.items()]))
    blockers = coverage(items).select("job_id", "item_id", F.lit("blocker").alias("kind"), F.explode(failed).alias("message"))
    warnings = F.transform("missing_fields", lambda x: F.concat(F.lit("missing_field:"), F.lower(F.trim(x))))
    return blockers.union(items.select("job_id", "item_id", F.lit("warning"), F.explode(warnings)))


def audit(items: DataFrame) -> DataFrame:
    n = F.count("*")
    return items.agg(
        n.alias("items"), F.count_if("data_complete").alias("complete"), percent(F.count_if("data_complete"), n).alias("complete_pct"),
        F.count_distinct(F.lower("content_hash")).alias("contents"),
        F.count_if(F.col("title").isNull() | (F.trim("title") == "")).alias("untitled"),
        F.bround(F.avg(F.size("missing_fields")), 2).alias("mean_missing"), F.max(F.size("missing_fields")).alias("most_missing"),
    )


def top_complete(items: DataFrame, n: int) -> DataFrame:
    """The n items with the most fields, then the longest title, then the last by name."""
    title = F.coalesce("title", F.lit(""))
    rows = items.where("missing_fields is not null").select(
        "item_id", "job_id", (F.lit(FIELD_COUNT) - F.size("missing_fields")).alias("filled"), F.length(title).alias("n_chars"), F.lower(title).alias("f")
    )
    return rows.orderBy(F.desc("filled"), F.desc("n_chars"), F.desc("f"), "job_id", "item_id").limit(n).drop("f")


def token_totals(events: DataFrame) -> DataFrame:
    """Calls and tokens of each agent, and of all (null)."""
    tokens = F.get_json_object("props", "$.k").cast("long")
    return events.rollup("event_type").agg(
        F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.bround(F.avg("value"), 4).alias("mean_value")
    )


def cross_job(items: DataFrame, jobs: DataFrame) -> DataFrame:
    done = jobs.where("status = 'completed'").select("job_id")
    rows = items.where("status = 'parsed'").join(done, "job_id", "left_semi")
    title = F.nullif(F.lower(F.trim("title")), F.lit(""))
    return rows.agg(
        F.count_distinct("canonical_url").alias("urls"), F.count_distinct(title).alias("titles"),
        F.count_distinct("item_id").alias("items"), F.count_distinct("job_id").alias("jobs"),
    )
