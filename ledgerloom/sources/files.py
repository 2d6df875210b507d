"""File scans and sinks: contracted CSV, workbooks, spreadsheets-safe CSV and JSON."""

from __future__ import annotations

import hashlib
import io
import json
import math
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, datetime
from decimal import Decimal
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.functions.scalars import formula_safe


class ContractError(ValueError):
    """A source that isn't what was agreed."""


def read_export(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV export with every column as text; blanks stay blanks, quoted line breaks are kept, a BOM is dropped.

    Columns are contracted: another header raises an error. A missing last cell is blank, too.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    with_header = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8")
    found = [c.lstrip("﻿") for c in with_header.csv(path).columns]
    if found != list(columns):
        raise ContractError(f"{path}: columns {found}, agreed were {list(columns)}")
    cells = with_header.schema(schema).option("enforceSchema", True).option("escape", '"').csv(path)
    return cells.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_cohorts(spark: SparkSession, paths: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Exports of several cohorts in one table with a column ``cohort`` and ``source_record``, 1 for a file's first row.

    Rows of a file are numbered in file order: by partition and place, with the counts of the partitions before.
    """
    out = None
    for cohort, path in sorted(paths.items()):
        rows = read_export(spark, path, columns).withColumn("__id", F.monotonically_increasing_id())
        part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
        counts = {r["p"]: r["n"] for r in rows.select(part.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
        before, total = {}, 0
        for p in sorted(counts):
            before[p], total = total, total + counts[p]
        offset = F.lit(0)
        for p, n in before.items():
            offset = F.when(part == p, F.lit(n)).otherwise(offset)
        one = rows.withColumn("source_record", offset + place + 1).withColumn("cohort", F.lit(cohort)).drop("__id")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ContractError("no files")
    return out


def checked_source(spark: SparkSession, path: str, rows: int, sha256: str, df: DataFrame) -> DataFrame:
    """``df`` if the file has the agreed bytes and number of rows, else an error."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]
    if digest != sha256 or df.count() != rows:
        raise ContractError(f"{path} is not the agreed file")
    return df


def write_csv(df: DataFrame, path: str, safe: bool = False) -> None:
    """CSV with ISO dates and empty cells for nulls; ``safe`` guards text cells against being read as formulas."""
    if safe:
        df = df.withColumns({c: formula_safe(F.col(c)) for c, kind in df.dtypes if kind == "string"})
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").option("nullValue", "").option("escape", '"').csv(path)


def json_safe(value):
    """A value for JSON: NaN and infinities as null, dates in ISO form, decimals as text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return value


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities as null."""
    real = [c for c, kind in df.dtypes if kind in ("double", "float")]
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in real}
    df.withColumns(finite).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def document_json(value) -> str:
    """A small document as JSON text with sorted keys."""
    return json.dumps(json_safe(value), sort_keys=True, ensure_ascii=False)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def workbook_rows(data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """``(row number, cells)`` of the first sheet of a workbook: shared and inline texts and numbers as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for row in ElementTree.fromstring(book.read(sheet)).iterfind(".//m:row", _NS):
            cells: dict[int, str | None] = {}
            for cell in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", cell.get("r", "A"))[0]
                column = 0
                for ch in letters:
                    column = column * 26 + ord(ch) - 64
                text = cell.find("m:v", _NS)
                if cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                elif text is None or text.text is None:
                    value = None
                else:
                    value = shared[int(text.text)] if cell.get("t") == "s" else text.text
                cells[column] = value
            yield int(row.get("r", "0")), [cells.get(i) for i in range(1, max(cells, default=0) + 1)]


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: rows of workbooks as ``path, row, cells``; one task for each file."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, row int, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], int(self.options.get("header_row", "0")))


class WorkbookReader(DataSourceReader):
    """Reads the workbooks of a comma-separated list of paths; rows up to ``header_row`` are passed over."""

    def __init__(self, path: str, header_row: int = 0) -> None:
        self.paths, self.header_row = path.split(","), header_row

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value.removeprefix("file://"), "rb") as file:
            for row, cells in workbook_rows(file.read()):
                if row > self.header_row:
                    yield partition.value, row, cells


def control_total(rows: DataFrame, label: str, amount: str) -> DataFrame:
    """``reported, visible, difference``: a grand-total row against the sum of all others, in exact decimals."""
    value = F.col(amount).try_cast("decimal(38,2)")
    is_total = F.lower(F.trim(F.col(label))) == "grand total"
    return rows.agg(F.sum(F.when(is_total, value)).alias("reported"), F.sum(F.when(~F.coalesce(is_total, F.lit(False)), value)).alias("visible")).withColumn("difference", F.col("reported") - F.col("visible"))


def file_digest(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a local file, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while chunk := file.read(block):
            digest.update(chunk)
    return digest.hexdigest()
