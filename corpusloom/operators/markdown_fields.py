"""Markdown documents: chunks by heading, rows of tables, fields, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ICD, fold, ground_text, plain_text

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
LINE_END = r"\r\n|[\n\r]"
#: Labels of table rows, and the fields they fill.
TABLE_FIELDS = {
    "aliases": "aliases", "also known as": "aliases", "summary": "summary", "overview": "summary",
    "causes": "causes", "risk factors": "risk_factors", "symptoms": "symptoms", "diagnosis": "diagnosis",
    "diagnostic": "diagnosis", "supportive evidence": "diagnosis", "treatment": "treatment",
    "prevention": "prevention", "prognosis": "prognosis", "when to seek care": "when_to_seek_care",
}
FIELDS = tuple(dict.fromkeys(TABLE_FIELDS.values()))
SCALARS = ("summary", "prognosis")


def chunks(documents: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, chunk_no, heading, level, body): the text cut before each heading.

    What stands before the first heading is chunk 'Document' of level 1; blank chunks are
    left out and not counted.
    """
    lines = F.split(F.col(markdown), LINE_END)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    heads = F.transform(F.filter(numbered, lambda x: x["line"].rlike(HEADING)), lambda x: x["i"])
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), heads))
    cut = documents.where(F.col(markdown).isNotNull()).select(key, lines.alias("lines"), starts.alias("starts"))
    each = cut.select(
        key,
        "lines",
        F.posexplode(F.transform("starts", lambda s, i: F.struct(s.alias("a"), F.try_element_at("starts", i + 2).alias("b")))).alias("n", "s"),
    )
    body = F.regexp_replace(
        F.array_join(F.slice("lines", F.col("s.a") + 1, F.coalesce(F.col("s.b"), F.size("lines")) - F.col("s.a")), "\n"), r"(?U)\A\s+|\s+\z", ""
    )
    first = F.element_at("lines", F.col("s.a") + 1)
    is_head = first.rlike(HEADING)
    rows = each.select(
        key, "n", body.alias("body"),
        F.when(is_head, F.regexp_extract(first, HEADING, 2)).otherwise("Document").alias("heading"),
        F.when(is_head, F.length(F.regexp_extract(first, HEADING, 1))).otherwise(1).alias("level"),
    ).where("body <> ''")
    return rows.withColumn("chunk_no", F.row_number().over(Window.partitionBy(key).orderBy("n"))).select(
        key, "chunk_no", "heading", "level", "body"
    )


def table_cells(line: Column) -> Column:
    """Cells of a pipe row, escaped pipes kept."""
    inner = F.btrim(F.trim(line), F.lit("|"))
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))


def table_fields(documents: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, line_no, field, value): rows of tables whose label names a field, in order."""
    labels = F.create_map(*[F.lit(x) for kv in TABLE_FIELDS.items() for x in kv])
    lines = documents.where(F.col(markdown).isNotNull()).select(
        key, F.posexplode(F.split(F.col(markdown), LINE_END)).alias("line_no", "line")
    )
    pipes = F.length("line") - F.length(F.replace(F.col("line"), F.lit("|"), F.lit("")))
    rows = lines.where(F.col("line").startswith("|") & (pipes >= 3)).select(key, "line_no", table_cells(F.col("line")).alias("cells"))
    rows = rows.where(F.size("cells") >= 2).select(
        key, "line_no", F.try_element_at(labels, fold(plain_text(F.try_element_at("cells", F.lit(1))))).alias("field"),
        F.trim(F.try_element_at("cells", F.lit(2))).alias("value"),
    )
    return rows.where(F.col("field").isNotNull() & ~F.col("value").rlike(r"^[-:]*$"))


def document_name(markdown: Column) -> Column:
    """The plain text of the first heading of level 1; null if there is none."""
    name = plain_text(F.regexp_extract(markdown, r"(?m)^#\s+(.+?)\s*$", 1))
    return F.nullif(name, F.lit(""))


def intro_blocks(documents: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, block_no, kind, value): what stands between the title and the first table.

    A block of codes is left out; a starred list or a compact line gives aliases, all else
    is summary.
    """
    before = F.split(F.regexp_replace(F.col(markdown), r"\r\n?", "\n"), r"\n\|", 2)[0]
    blocks = F.filter(
        F.transform(F.split(before, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: x != ""
    )
    rows = documents.where(F.col(markdown).isNotNull()).select(
        key, document_name(F.col(markdown)).alias("name"), F.posexplode(blocks).alias("block_no", "block")
    )
    plain = plain_text(F.col("block"))
    parts = F.filter(F.transform(F.split("block", r"\s+\*\s+"), plain_text), lambda x: x != "")
    compact = (F.length(plain) <= 120) & (F.size(F.split(plain, " ")) <= 12) & ~plain.rlike(r"[.!?:;]$")
    codes = F.forall(parts, lambda x: x.rlike(ICD))
    kept = rows.where((F.col("block_no") > 0) & (plain != "") & ~codes & F.col("name").isNotNull())
    aliases = F.filter(parts, lambda x: ground_text(x) != ground_text(F.col("name")))
    found = kept.select(
        key, "block_no",
        F.when((F.size(parts) > 1) | compact, F.struct(F.lit("aliases").alias("kind"), aliases.alias("values")))
        .otherwise(F.struct(F.lit("summary").alias("kind"), F.array("block").alias("values"))).alias("v"),
    )
    return found.select(key, "block_no", F.col("v.kind").alias("kind"), F.explode("v.values").alias("value"))


def merged_fields(values: DataFrame, key: str, order: str, field: str = "field", value: str = "value") -> DataFrame:
    """(key, field, n_values, merged): distinct values of each field in order, the first spelling kept.

    Scalar fields are joined by a blank line, lists by a line end.
    """
    grounded = values.withColumn("__g", ground_text(F.col(value))).where("__g <> ''")
    firsts = grounded.groupBy(key, field, "__g").agg(F.min(F.struct(order, value)).alias("f"))
    lists = firsts.groupBy(key, field).agg(F.sort_array(F.collect_list("f")).alias("fs"))
    texts = F.transform("fs", lambda x: F.trim(x[value]))
    return lists.select(
        key, field, F.size("fs").alias("n_values"),
        F.when(F.col(field).isin(*SCALARS), F.array_join(texts, "\n\n")).otherwise(F.array_join(texts, "\n")).alias("merged"),
    )


def grounded(values: DataFrame, sources: DataFrame, key: str, value: str, text: str) -> DataFrame:
    """``values`` with is_grounded: whether every paragraph of the value stands in its own source."""
    both = values.join(sources.select(key, ground_text(F.col(text)).alias("__source")), key)
    paragraphs = F.filter(F.transform(F.split(F.col(value), r"\n{2,}"), ground_text), lambda x: x != "")
    inside = F.forall(paragraphs, lambda x: F.col("__source").contains(x))
    return both.withColumn("is_grounded", inside).drop("__source")


def missing_fields(present: DataFrame, key: str, field: str = "field") -> DataFrame:
    """(key, missing): names of fields that no row of the key has, in the order of FIELDS."""
    have = present.groupBy(key).agg(F.collect_set(field).alias("have"))
    return have.select(key, F.array_join(F.array_except(F.array(*[F.lit(f) for f in FIELDS]), F.col("have")), ",").alias("missing"))

