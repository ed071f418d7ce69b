"""Functions on arrays and maps, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded_list(json: Column) -> Column:
    """A list written as JSON; null and unreadable text give the empty list."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def all_hold(checks: Column) -> Column:
    """Whether every check of a map holds; a null check does not."""
    return F.forall(F.map_values(checks), lambda x: F.coalesce(x, F.lit(False)))


def changed_keys(now: Column, past: Column) -> Column:
    """Keys, sorted, whose values differ or that only one map has."""
    empty = F.expr("cast(map() as map<string,string>)")
    zipped = F.map_zip_with(F.coalesce(now, empty), F.coalesce(past, empty), lambda k, a, b: ~a.eqNullSafe(b))
    return F.array_sort(F.map_keys(F.map_filter(zipped, lambda k, v: v)))


def lacking(required: Column, present: Column) -> Column:
    """What of ``required`` is not present, sorted; a null list has nothing."""
    return F.array_sort(F.array_except(required, F.coalesce(present, F.array().cast("array<string>"))))


def joined_texts(texts: Column) -> Column:
    """Texts that are neither null nor empty, one on a line."""
    return F.array_join(F.filter(texts, lambda x: x != ""), "\n")


def total_length(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))


def after_prefix(texts: Column, prefix: str) -> Column:
    """What follows the prefix in those texts that begin with it."""
    return F.transform(F.filter(texts, lambda x: x.startswith(prefix)), lambda x: F.substr(x, F.lit(len(prefix) + 1)))


def component_map(parts: Column) -> Column:
    """A map of (key, hash) structs sorted by key, so that equal parts give equal maps."""
    return F.map_from_entries(F.array_sort(parts))


def map_digest(components: Column) -> Column:
    """A digest of a map that does not depend on the order of its entries; null values count as such."""
    entries = F.array_sort(F.map_entries(components))
    texts = F.transform(entries, lambda e: F.concat(e["key"], F.lit(chr(31)), F.coalesce(F.concat(F.lit("="), e["value"]), F.lit("-"))))
    return F.sha2(F.array_join(texts, chr(30)), 256)


def kind_of_status(status: Column) -> Column:
    """What an HTTP status means for a caller."""
    return (
        F.when(status.isin(401, 403), "auth").when(status == 429, "rate_limit").when(status == 408, "timeout")
        .when(status.between(500, 599), "server").when(status.between(400, 499), "request").when(status.between(200, 299), "ok")
        .otherwise("unknown")
    )


def retry_after_seconds(header: Column) -> Column:
    """Seconds of a retry-after header, never negative; null if it is no number."""
    seconds = F.trim(header).try_cast("double")
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))
