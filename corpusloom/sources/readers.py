"""Readers: tolerant JSON, checked artifacts, name lists as text and as spreadsheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.functions.text import collapse, fold
from corpusloom.runtime import ship

MOST_BYTES, MOST_UNPACKED = 2_000_000, 10_000_000
#: What a heading of a name list may say.
HEADINGS = ("disease", "diseases", "name", "names", "disease name", "disease_name")
ARTIFACT = "job_id string, item_id string, artifacts map<string, struct<name: string, size: bigint, sha256: string>>"


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file that holds an object; files that don't are left out."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    parsed = files.withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return parsed.where(F.trim("value").startswith("{") & F.col("j").isNotNull()).select("path", "j.*")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of items, of which one row for each artifact: (job_id, item_id, name, size, sha256)."""
    found = json_objects(spark, path, ARTIFACT)
    return found.select("job_id", "item_id", F.explode(F.map_values("artifacts")).alias("a")).select("job_id", "item_id", "a.*")


def checked_artifacts(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """(job_id, item_id, name, content): artifacts below ``root``/job/item whose size and digest are as listed.

    Contents are read once and never shuffled: the list is joined to their names.
    """
    parts = F.split(F.col("path"), "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(
        F.element_at(parts, -3).alias("job_id"), F.element_at(parts, -2).alias("item_id"), F.element_at(parts, -1).alias("name"),
        F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("content"),
    )
    return files.join(listed, ["job_id", "item_id", "name", "size", "sha256"], "left_semi").select("job_id", "item_id", "name", "content")


def latest_folder(spark: SparkSession, root: str) -> DataFrame:
    """(folder, changed_at): the folder below ``root`` with the file changed last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.agg(F.max_by(folder, F.struct("modificationTime", "path")).alias("folder"), F.max("modificationTime").alias("changed_at"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, name): names of text files, one on a line, the first of those equal without case."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r\n|[\n\r]")).alias("line_no", "name"))
    return distinct_in_file(lines)


def distinct_in_file(lines: DataFrame) -> DataFrame:
    clean = lines.withColumn("name", collapse(F.col("name"))).where((F.col("name") != "") & ~F.lower("name").isin(*HEADINGS))
    return clean.groupBy("file", fold(F.col("name")).alias("f")).agg(F.min("line_no").alias("line_no"), F.min_by("name", "line_no").alias("name")).select("file", "line_no", "name")


def column_a(payload: bytes) -> list[str]:
    """Texts of column A of a workbook's first sheet; [] if it is too large or no workbook."""
    if len(payload) > MOST_BYTES:
        return []
    try:
        book = zipfile.ZipFile(io.BytesIO(payload))
    except zipfile.BadZipFile:
        return []
    if sum(i.file_size for i in book.infolist()) > MOST_UNPACKED or any(".." in i.filename or i.filename.startswith("/") for i in book.infolist()):
        return []
    names = book.namelist()

    def texts(element) -> str:
        return "".join(t.text or "" for t in element.iter() if t.tag.endswith("}t") or t.tag == "t")

    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [texts(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if e.tag.rpartition("}")[2] == "si"]
    sheet = next((n for n in sorted(names) if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), None)
    out = []
    for cell in ElementTree.fromstring(book.read(sheet)).iter() if sheet else ():
        if cell.tag.rpartition("}")[2] != "c" or not re.fullmatch(r"A\d+", cell.get("r", "")):
            continue
        value = next((v.text or "" for v in cell if v.tag.rpartition("}")[2] == "v"), "")
        if cell.get("t") == "s":
            value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
        elif cell.get("t") == "inlineStr":
            value = texts(cell)
        out.append(value)
    return out


def workbook_names(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, name): names in column A of workbooks, headings and repeats left out."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator):
        import pandas as pd

        for batch in batches:
            rows = [(p, i, v) for p, c in zip(batch["path"], batch["content"], strict=True) for i, v in enumerate(column_a(bytes(c)))]
            yield pd.DataFrame(rows, columns=["file", "line_no", "name"])

    return distinct_in_file(files.mapInPandas(run, "file string, line_no int, name string"))


class DemoItems(DataSource):
    """A source of a few fixed items, for trying out the engine: format "demo_items"."""

    @classmethod
    def name(cls) -> str:
        return "demo_items"

    def schema(self) -> str:
        return "item_id string, source_url string, title string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DemoReader()


class _DemoReader(DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        for n in (1, 2):
            yield f"demo-{n}", f"https://demo.example/item-{n}", f"Demo item {n}"
