"""Trees from indents and trails from breadcrumbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold

STEP_PX = 25


def indent_level(padding_px: Column) -> Column:
    """Depth of a row by its left padding, halves to even; without padding the top."""
    return F.coalesce(F.bround(padding_px / STEP_PX, 0), F.lit(0.0)).cast("int")


def off_grid(padding_px: Column) -> Column:
    """Whether the padding is no multiple of a step."""
    return F.coalesce(F.abs(padding_px / STEP_PX - F.bround(padding_px / STEP_PX, 0)) > 0.01, F.lit(False))


def paths(rows: Column) -> Column:
    """The path of each of a table's rows (structs name, level, in order).

    A row that is deeper than a child of the row before it counts as its child. Within one
    table only: the repair of a row feeds the next, so this is a fold over the array.
    """

    def step(done: Column, row: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.array().cast("array<string>"))
        above = F.slice(last, F.lit(1), F.least(F.greatest(row["level"], F.lit(0)), F.size(last)))
        return F.concat(done, F.array(F.concat(above, F.array(row["name"]))))

    return F.aggregate(rows, F.array().cast("array<array<string>>"), step)


def path_id(path: Column) -> Column:
    """An id that is the same wherever the path is, whatever its letter case."""
    return F.sha2(F.array_join(F.transform(path, fold), chr(31)), 256)


def tree_rows(tables: DataFrame, key: str, rows: str) -> DataFrame:
    """(key, row_no, name, level, path, node_id, parent_id, is_leaf) of each row of each table."""
    each = tables.select(key, F.posexplode(paths(F.col(rows))).alias("pos", "path"))
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    following = F.lead(F.size("path")).over(Window.partitionBy(key).orderBy("pos"))
    return each.select(
        key, (F.col("pos") + 1).alias("row_no"), F.element_at("path", -1).alias("name"), (F.size("path") - 1).alias("level"),
        F.array_join("path", " > ").alias("path"), path_id(F.col("path")).alias("node_id"),
        F.when(F.size("path") > 1, path_id(parent)).alias("parent_id"),
        (F.coalesce(following, F.lit(0)) <= F.size("path")).alias("is_leaf"),
    )


def aligned(cells: Column, width: Column) -> Column:
    """A row's cells cut or filled to the table's width."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width, F.lit(0)).cast("int"))), F.lit(1), width)


def ratings(headers: Column, cells: Column) -> Column:
    """Cells by their header, the blank ones left out; the first column is the name."""
    names = F.slice(headers, F.lit(2), F.greatest(F.size(headers) - 1, F.lit(0)))
    values = F.slice(aligned(cells, F.size(headers)), F.lit(2), F.greatest(F.size(headers) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: (x["k"] != "") & (x["v"] != ""))
    return F.map_from_entries(pairs)


def menu_levels(trails: DataFrame, key: str, trail: str, current: str) -> DataFrame:
    """(key, level, distance, label, is_current): a breadcrumb trail, ended by the page itself."""
    whole = F.when(
        F.col(current).isNull() | (fold(F.coalesce(F.try_element_at(trail, F.lit(-1)), F.lit(""))) == fold(F.col(current))),
        F.col(trail),
    ).otherwise(F.concat(F.col(trail), F.array(current)))
    each = trails.select(key, whole.alias("t")).select(key, F.size("t").alias("n"), F.posexplode("t").alias("pos", "label"))
    return each.select(
        key, (F.col("pos") + 1).alias("level"), (F.col("n") - 1 - F.col("pos")).alias("distance"), "label",
        (F.col("pos") == F.col("n") - 1).alias("is_current"),
    )
