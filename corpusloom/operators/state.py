"""The state of the crawl: folds of event logs, upserts, attempts, retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_jobs(jobs: DataFrame) -> DataFrame:
    """One row for each job, however often it was delivered: the one that finished last."""
    columns = [c for c in jobs.columns if c != "job_id"]
    best = F.max_by(F.struct(*columns), F.struct(F.coalesce("finished_at", "started_at", "created_at"), "status"))
    return jobs.where("job_id is not null").groupBy("job_id").agg(best.alias("j")).select("job_id", "j.*")


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; ties must be told apart by the order's last columns."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def items_of(reports: DataFrame) -> DataFrame:
    """One row for each (job_id, item_id), ids cleaned, the one received last."""
    rows = reports.where("job_id is not null and item_id is not null").withColumn("item_id", F.lower(F.trim("item_id")))
    return latest_rows(rows, ["job_id", "item_id"], [F.col("received_at").desc_nulls_last(), F.col("report_row_id").desc()])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], replace: Sequence[str], keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` merged in by key.

    Columns of ``replace`` take the new value, those of ``keep_old_if_null`` too unless it is
    null, all others stay as they were and are null in rows that are new. One shuffle of
    either side by the key, none if both are already partitioned by it.
    """
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in keep_old_if_null:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        elif c in replace:
            out.append(F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}"))
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return o.join(n, condition, "full").select(*out)


def state_fold(events: DataFrame, key: str, event: str, order: Sequence[str], starts: str, fails: str) -> DataFrame:
    """(key, state, attempts, failures, n_events): the last event of each key and what led there.

    Aggregates before the shuffle, so that a key with very many events is no burden.
    """
    at = F.struct(*order)
    return events.groupBy(key).agg(
        F.max_by(event, at).alias("state"),
        F.count_if(F.col(event) == starts).alias("attempts"),
        F.count_if(F.col(event) == fails).alias("failures"),
        F.count("*").alias("n_events"),
    )


def numbered_attempts(events: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Events with attempt_no INT, counted from 1 within their keys in ``order``.

    ``bucket`` grows with the order (such as its day). Events are numbered within their bucket
    and moved by the events of the buckets before, so that a key with a third of all events
    is spread over as many tasks as it has buckets.
    """
    rows = events.withColumn("__b", bucket)
    counts = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    within = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    numbered = rows.withColumn("__n", within).join(offsets, [*keys, "__b"])
    return numbered.withColumn("attempt_no", (F.col("__n") + F.col("__o")).cast("int")).drop("__b", "__n", "__o")


def next_attempt(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, next_attempt_no): one more than the events there are, combined before the shuffle."""
    return events.groupBy(*keys).agg((F.count("*") + 1).cast("int").alias("next_attempt_no"))


def backoff_seconds(attempt: Column, base: float, longest: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(longest))


def recovered_status(status: Column, has_artifact: Column) -> Column:
    """Of items found in the middle of a fetch: fetched if their artifact is there, else to do again."""
    return F.when(status == "fetching", F.when(has_artifact, "fetched").otherwise("discovered")).otherwise(status)
