"""Files for people, written by the driver from a stream of rows: CSV, workbooks, SQLite, Markdown, and bundles."""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import json
import os
import sqlite3
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import formula_safe

#: The most rows of a sheet, and the beginnings of texts that spreadsheets read as formulas.
SHEET_ROWS = 1_048_576


def _cell(value) -> str:
    """A value as text: dates in ISO form, nothing for nulls."""
    if value is None:
        return ""
    return value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else str(value)


def _rows(df: DataFrame) -> Iterator[tuple]:
    """Rows of a table one partition after the other, so the driver never holds the table."""
    return (tuple(r) for r in df.toLocalIterator())


def _replaced(path: str, write) -> None:
    """Write a file beside its target and put it there at once, so readers see the old or the new one."""
    fd, temporary = tempfile.mkstemp(dir=Path(path).resolve().parent)
    os.close(fd)
    try:
        write(temporary)
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_csv_file(df: DataFrame, path: str, safe: bool = False, crlf: bool = False) -> None:
    """One CSV file with a byte order mark, as spreadsheets expect: ISO dates, empty cells for nulls, LF or CRLF.

    ``safe`` guards text cells against being read as formulas.
    """
    if safe:
        df = df.withColumns({c: formula_safe(F.col(c)) for c, kind in df.dtypes if kind == "string"})

    def write(temporary: str) -> None:
        with open(temporary, "w", encoding="utf-8-sig", newline="") as file:
            out = csv.writer(file, lineterminator="\r\n" if crlf else "\n")
            out.writerow(df.columns)
            out.writerows([_cell(v) for v in row] for row in _rows(df))

    _replaced(path, write)


def _column_name(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _sheet(df: DataFrame) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    names = [_column_name(i) for i in range(len(df.columns))]
    for n, row in enumerate(itertools.chain([tuple(df.columns)], _rows(df)), 1):
        if n > SHEET_ROWS:
            raise ValueError(f"a sheet has {SHEET_ROWS} rows at most")
        cells = []
        for name, value in zip(names, row, strict=True):
            if value is None:
                continue
            if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
                cells.append(f'<c r="{name}{n}"><v>{value}</v></c>')
            else:
                text = "".join(c for c in _cell(value) if c >= " " or c in "\t\n")
                cells.append(f'<c r="{name}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        yield f'<row r="{n}">{"".join(cells)}</row>'
    yield "</sheetData></worksheet>"


def in_rupees(df: DataFrame) -> DataFrame:
    """Columns that end in ``_paise`` as rupees, renamed to ``_inr``; all others as they are."""
    return df.select(*[(F.col(c) / 100).alias(c.removesuffix("_paise") + "_inr") if c.endswith("_paise") else F.col(c) for c in df.columns])


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook of plain cells with a sheet for each table, in the tables' order; amounts in paise become rupees.

    Sort and limit tables before: a sheet of more than SHEET_ROWS rows is an error.
    """
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"

    def write(temporary: str) -> None:
        with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as book:
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
            book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
            book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets>{listed}</sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
            for i, df in enumerate(sheets.values(), 1):
                with book.open(f"xl/worksheets/sheet{i}.xml", "w") as part:
                    for text in _sheet(in_rupees(df)):
                        part.write(text.encode())

    _replaced(path, write)


def write_sqlite(tables: dict[str, DataFrame], path: str, indexes: Sequence[tuple[str, Sequence[str]]] = ()) -> None:
    """A SQLite file with the tables and indexes, for tools that want one; dates as ISO text, booleans as 0 and 1."""
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
    value = lambda v: v if v is None or isinstance(v, (int, float, str)) else _cell(v)

    def write(temporary: str) -> None:
        db = sqlite3.connect(temporary)
        try:
            for name, df in tables.items():
                db.execute(f"CREATE TABLE {quoted(name)} ({', '.join(f'{quoted(c)} {kinds.get(kind, 'TEXT')}' for c, kind in df.dtypes)})")
                insert = f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * len(df.columns))})"
                rows = _rows(df)
                while batch := list(itertools.islice(rows, 1000)):
                    db.executemany(insert, [[value(v) for v in row] for row in batch])
            for i, (name, columns) in enumerate(indexes):
                db.execute(f"CREATE INDEX {quoted(f'{name}_{i}')} ON {quoted(name)} ({', '.join(map(quoted, columns))})")
            db.execute("PRAGMA optimize")
            db.commit()
        finally:
            db.close()

    _replaced(path, write)


def read_sqlite(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a SQLite file, opened read-only by one task; ``schema`` names its columns and their types.

    The file must be readable by the executors.
    """
    wanted = spark.createDataFrame([], schema).schema
    columns = ", ".join('"' + c.replace('"', '""') + '"' for c in wanted.names)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for _ in range(batch.num_rows):
                db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                found = db.execute(f'SELECT {columns} FROM "{name}"')
                while rows := found.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) if any(v is not None for v in c) else pa.nulls(len(c)) for c in zip(*rows, strict=True)], wanted.names)
                db.close()

    raw = ", ".join(f"`{f.name}` {'string' if f.dataType.simpleString() in ('date', 'timestamp') else f.dataType.simpleString()}" for f in wanted)
    typed = lambda batches: (_as(b, raw_types) for b in read(batches))
    raw_types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], raw).schema}
    rows = spark.range(0, 1, 1, 1).mapInArrow(typed, raw)
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted])


def _as(batch, kinds: dict[str, str]):
    """A batch in the types that Spark was told."""
    import pyarrow as pa

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([batch.column(n).cast(arrow[k]) for n, k in kinds.items()], list(kinds))


def markdown_table(df: DataFrame, most: int = 50) -> str:
    """The first rows of a sorted, small table as a Markdown table; ``most`` says how many are shown, and a line how
    many there are if it is more."""
    rows = [tuple(r) for r in df.limit(most + 1).collect()]
    clean = lambda v: _cell(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(df.columns)} |", f"|{'|'.join('-' for _ in df.columns)}|", *[f"| {' | '.join(map(clean, r))} |" for r in rows[:most]]]
    return "\n".join(lines + ([f"({most} of {df.count()} rows)"] if len(rows) > most else [])) + "\n"


def write_report(sections: Sequence[tuple[str, DataFrame | str]], path: str) -> None:
    """A Markdown report: a heading and a table or text for each section."""
    parts = [f"## {title}\n\n{body if isinstance(body, str) else markdown_table(body)}" for title, body in sections]
    _replaced(path, lambda temporary: Path(temporary).write_text("\n".join(parts), encoding="utf-8"))


def pack(folder: Path, bundle: Path, largest: int | None = None) -> dict:
    """A gzipped tar file of a folder with ``bundle.json``: hashes of what is in it and names of what was left out for
    being larger than ``largest`` bytes. Files go in by name, without owners and times, so equal folders give equal bytes."""
    said: dict = {"files": {}, "omitted": {}}
    members = []
    for p in sorted(q for q in folder.rglob("*") if q.is_file()):
        name = str(p.relative_to(folder))
        digest = hashlib.sha256(p.read_bytes()).hexdigest() if largest is None or p.stat().st_size <= largest else None
        if digest is None:
            said["omitted"][name] = p.stat().st_size
        else:
            said["files"][name] = digest
            members.append((name, p))

    def write(temporary: str) -> None:
        with tarfile.open(temporary, "w:gz") as tar:
            text = json.dumps(said, sort_keys=True).encode()
            for name, data in [("bundle.json", io.BytesIO(text)), *((n, p.open("rb")) for n, p in members)]:
                info = tarfile.TarInfo(name)
                info.size = len(text) if name == "bundle.json" else (folder / name).stat().st_size
                with data:
                    tar.addfile(info, data)

    _replaced(str(bundle), write)
    return said


def bundle_problem(bundle: Path) -> str | None:
    """What is wrong with a bundle that is read again; None if nothing is. Declared omissions are no fault."""
    with tarfile.open(bundle, "r:gz") as tar:
        members = {m.name: m for m in tar.getmembers()}
        if "bundle.json" not in members:
            return "no bundle.json"
        said = json.loads(tar.extractfile("bundle.json").read())
        for name in sorted(set(members) - {"bundle.json"} - set(said["files"])):
            return f"{name} isn't declared"
        for name, digest in said["files"].items():
            if name not in members:
                return f"{name} is gone"
            if hashlib.sha256(tar.extractfile(name).read()).hexdigest() != digest:
                return f"{name} has changed"
    return None
