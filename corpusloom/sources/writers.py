"""Writers: versions of tables, appended logs, and the normalised tables of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.state import upsert


def append_log(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Adds rows to a table that is only ever added to."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def merge_version(old: DataFrame, new: DataFrame, path: str, keys: Sequence[str], replace: Sequence[str], keep_old_if_null: Sequence[str] = ()) -> None:
    """Writes the merged table as a new version beside the old one, which is never overwritten while it is read."""
    upsert(old, new, keys, replace, keep_old_if_null).write.mode("errorifexists").parquet(path)


def merged_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(job_id, item_id, artifacts, warnings): new artifacts over the old ones of the same name, and all
    warnings in the order they first came."""
    empty = F.array().cast("array<string>")
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.job_id") == F.col("n.job_id")) & (F.col("o.item_id") == F.col("n.item_id")), "full")
    before = F.coalesce("o.artifacts", F.expr("cast(map() as map<string,string>)"))
    after = F.coalesce("n.artifacts", F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(before, lambda k, v: ~F.map_contains_key(after, k))
    return both.select(
        F.coalesce("o.job_id", "n.job_id").alias("job_id"), F.coalesce("o.item_id", "n.item_id").alias("item_id"),
        F.map_concat(kept, after).alias("artifacts"),
        F.array_distinct(F.concat(F.coalesce("o.warnings", empty), F.coalesce("n.warnings", empty))).alias("warnings"),
    )


def normalised(documents: DataFrame) -> dict[str, DataFrame]:
    """Tables of nested documents: each array or map becomes rows with an order that counts from 1.

    ``documents`` (document_id, fields map<string, array<string>>, sections array<struct>, tabs
    array<struct<key, label, tables array<array<array<string>>>>>, checks map<string, boolean>).
    """
    pos = lambda c, n: documents.select("document_id", F.posexplode(c).alias("p", n))
    fields = documents.select("document_id", F.explode("fields").alias("field_name", "values")).select(
        "document_id", "field_name", F.posexplode("values").alias("p", "value")
    )
    tabs = pos("tabs", "tab")
    tables = tabs.select("document_id", F.col("tab.key").alias("tab_key"), F.posexplode("tab.tables").alias("p", "rows"))
    return {
        "documents": documents.select("document_id", F.to_json(F.struct(*documents.columns)).alias("document_json")),
        "field_values": fields.select("document_id", "field_name", (F.col("p") + 1).alias("value_order"), "value"),
        "sections": pos("sections", "s").select("document_id", (F.col("p") + 1).alias("section_order"), "s.*"),
        "tabs": tabs.select("document_id", F.col("tab.key").alias("tab_key"), F.col("tab.label").alias("label")),
        "tab_tables": tables.select("document_id", "tab_key", (F.col("p") + 1).alias("table_order"), F.to_json("rows").alias("rows_json")),
        "checks": documents.select("document_id", F.explode("checks").alias("check_name", "passed")),
    }
