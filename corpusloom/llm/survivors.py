"""One surviving record for each group of duplicate records, by skyline selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.times import instant_micros

SPACE = " \t\r\n" + chr(0xA0)
UNKNOWN_COMPLETENESS = 2**31 - 1
EARLIEST = -(2**63) + 1
FIELDS = ("title", "content_hash", "artifact_dir")


def missing_count(names: Column) -> Column:
    """Number of different names, case and outer spaces ignored; null behind every list.

    Null and blank entries are no names.
    """
    plain = F.transform(names, lambda x: F.lower(F.btrim(x, F.lit(SPACE))))
    kept = F.array_distinct(F.filter(plain, lambda x: x.isNotNull() & (x != "")))
    return F.when(names.isNull(), UNKNOWN_COMPLETENESS).otherwise(F.size(kept))


def report_doubts() -> Column:
    """Marks against a row of report_items, 0 (trusted) to 2: an error, artifacts not complete."""
    error = F.col("last_error_code").isNotNull() & (F.btrim("last_error_code") != "")
    return error.cast("int") + (~F.coalesce(F.col("complete_artifact_set"), F.lit(False))).cast("int")


def dominance_layers(cells: Column) -> Column:
    """The Pareto layer (1 is undominated) of each cell of a sorted array.

    Cells are structs that begin with completeness ``n``, age ``late`` and ``doubts``, each better
    if smaller, in this order of sorting. A cell lies behind one that is nowhere worse and somewhere
    better; its layer is one more than the deepest such cell's, all of which come before it.
    """
    start = F.array().cast("array<struct<n:int,late:bigint,doubts:int,layer:int>>")

    def behind(cell: Column):
        def test(x: Column) -> Column:
            same = (x["n"] == cell["n"]) & (x["late"] == cell["late"]) & (x["doubts"] == cell["doubts"])
            return (x["n"] <= cell["n"]) & (x["late"] <= cell["late"]) & (x["doubts"] <= cell["doubts"]) & ~same

        return test

    def step(done: Column, cell: Column) -> Column:
        over = F.transform(F.filter(done, behind(cell)), lambda x: x["layer"])
        layer = (F.coalesce(F.array_max(over), F.lit(0)) + 1).cast("int")
        return F.concat(done, F.array(F.struct(cell["n"].alias("n"), cell["late"].alias("late"), cell["doubts"].alias("doubts"), layer.alias("layer"))))

    return F.aggregate(cells, start, step, lambda done: F.transform(done, lambda x: x["layer"]))


def skyline_cells(
    rows: DataFrame,
    key: str = "item_id",
    row_id: str = "report_row_id",
    missing: str = "missing_fields",
    seen: str = "checked_at",
    fields: Sequence[str] = FIELDS,
    doubts: Column | None = None,
    least_rows: int = 2,
    values: bool = False,
) -> DataFrame:
    """(key, n_rows, cells) of each key with ``least_rows`` rows: its cells, with their Pareto layers.

    A cell stands for all rows of a key that are equally complete (``missing``), equally
    trusted (``doubts``; null: all are) and offer the same of ``fields``: it is the latest
    (``seen``) of them, then that of the smallest ``row_id``, as that row offers all that the
    others do and is nowhere worse. Cells are structs (n, late, doubts, id, offers, layer and, with
    ``values``, the values of the fields); layers are over all cells of the key. ``offers`` has
    bit i for field i.

    Rows become cells before any shuffle, so a key with a third of all rows is as many
    cells as its rows differ in completeness, trust and offers.

    Rows with a null key are left out; a blank key is a group of its own. Repeated rows
    count as rows. A null ``missing`` ranks behind every list, null or unreadable ``seen``
    is earliest. Further columns are ignored; an empty table gives no rows.
    """
    usable = [F.col(f).isNotNull() & (F.btrim(F.col(f), F.lit(SPACE)) != "") for f in fields]
    offers = F.lit(0)
    for i, u in enumerate(usable):
        offers = offers + F.when(u, 1 << i).otherwise(0)
    best = [(-F.coalesce(instant_micros(F.col(seen)), F.lit(EARLIEST))).alias("late"), F.col(row_id).alias("id")]
    if values:
        best.append(F.struct(*[F.when(u, F.col(f)).alias(f) for f, u in zip(fields, usable, strict=True)]).alias("values"))
    cells = (
        rows.where(F.col(key).isNotNull())
        .select(
            F.lower(F.btrim(F.col(key), F.lit(SPACE))).alias("key"),
            missing_count(F.col(missing)).alias("n"),
            (F.lit(0) if doubts is None else F.coalesce(doubts, F.lit(UNKNOWN_COMPLETENESS))).cast("int").alias("doubts"),
            offers.alias("offers"),
            F.struct(*best).alias("best"),
        )
        .groupBy("key", "n", "doubts", "offers")
        .agg(F.count("*").alias("rows"), F.min("best").alias("best"))
    )
    parts = ["n", F.col("best.late").alias("late"), "doubts", F.col("best.id").alias("id"), "offers"]
    parts += [F.col("best.values").alias("values")] if values else []
    groups = cells.groupBy("key").agg(F.sum("rows").alias("n_rows"), F.sort_array(F.collect_list(F.struct(*parts))).alias("cells"))
    kept = ["n", "late", "doubts", "id", "offers", *(["values"] if values else [])]
    layered = F.zip_with("cells", dominance_layers(F.col("cells")), lambda c, layer: F.struct(layer.alias("layer"), *[c[x].alias(x) for x in kept]))
    return groups.where(F.col("n_rows") >= least_rows).select(F.col("key").alias(key), "n_rows", layered.alias("cells"))


def _choice(cells: Column, bit: int | None, policy: str) -> Column:
    """The cell that gives the record (``bit`` null) or a field, by ``policy``.

    Of each layer the lexicographically first cell that offers the field is a candidate
    (more complete, then later, then the smaller row id; no other cell of the layer can
    come before it). 'layers' takes the candidate of the first layer that has one, so that
    nulls are filled from successive layers; 'rank' takes the first of all candidates.
    """
    offering = cells if bit is None else F.filter(cells, lambda c: c["offers"].bitwiseAND(1 << bit) != 0)
    order = ["n", "late", "id", "layer"] if policy == "rank" else ["layer", "n", "late", "id"]
    return F.array_min(F.transform(offering, lambda c: F.struct(*[c[x].alias(x) for x in order], c.alias("cell"))))["cell"]


def survivor_sources(rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "item_id", row_id: str = "report_row_id", **how) -> DataFrame:
    """(key, field_name, row_id): which row gives the record, and each field, by rank."""
    groups = skyline_cells(rows, key=key, row_id=row_id, fields=fields, **how)
    each = [
        F.struct(F.lit(name).alias("field_name"), _choice(F.col("cells"), bit, "rank")["id"].alias(row_id))
        for name, bit in (("record", None), *((f, i) for i, f in enumerate(fields)))
    ]
    return groups.select(key, F.inline(F.filter(F.array(*each), lambda x: x[row_id].isNotNull())))


def survivor_records(
    rows: DataFrame, fields: Sequence[str] = FIELDS, key: str = "item_id", row_id: str = "report_row_id", policy: str = "rank", **how
) -> DataFrame:
    """(key, n_rows, row_id, layer, and of each of ``fields`` its value and layer): the surviving record of each key.

    ``policy`` 'rank' gives the rows of ``survivor_sources``; a field's layer tells how far
    behind the undominated rows of the whole group its row lies. 'layers' fills each field
    from the first layer that offers it. Values travel in the cells: there is no join.
    """
    groups = skyline_cells(rows, key=key, row_id=row_id, fields=fields, values=True, **how)
    chosen = groups.select(
        F.col(key), "n_rows", _choice(F.col("cells"), None, policy).alias("c"),
        *[_choice(F.col("cells"), i, policy).alias(f"c{i}") for i in range(len(fields))],
    )
    filled = [x for i, f in enumerate(fields) for x in (F.col(f"c{i}.values")[f].alias(f), F.col(f"c{i}.layer").alias(f"{f}_layer"))]
    return chosen.select(key, "n_rows", F.col("c.id").alias(row_id), F.col("c.layer").alias("layer"), *filled)
