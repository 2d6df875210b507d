"""Raw record files, read by many tasks: quoted line breaks are no borders, whatever block they lie in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.delimited import START, block_map, record_ends, tokenize
from ledgerloom.sources.files import ContractError

#: Bytes of a block; one task reads it, and beyond its end as far as its last record goes.
BLOCK = 32 << 20
BOM = b"\xef\xbb\xbf"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; local paths need no scheme."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _bytes(path: str, first: int, size: int) -> bytes:
    system, inside = _opened(path)
    with system.open_input_file(inside) as file:
        return file.read_at(size, first)


def stream_digest(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file of any size, read in blocks."""
    system, inside = _opened(path)
    digest = hashlib.sha256()
    with system.open_input_stream(inside) as file:
        while chunk := file.read(block):
            digest.update(chunk)
    return digest.hexdigest()


def read_records(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``source_record, byte_at, raw_line``: the records of a file, numbered from 0 in file order.

    A first pass gives for each block what it does to the tokenizer's states; these maps (ten numbers for a block) are
    composed on the driver, which tells each block's state at its begin and the number of its first record. A second
    pass cuts the records. A record belongs to the block in which it begins. Records end at line feeds outside quotes;
    a carriage return before one and a byte order mark are dropped, a last record needs no line feed, an empty file has
    none. Bytes that are no UTF-8 become replacement characters. The path must be readable by all executors.
    """
    system, inside = _opened(path)
    size = system.get_file_info(inside).size or 0
    blocks = max(1, -(-size // block))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                after, ends, closes = zip(*block_map(_bytes(path, i * block, min(block, size - i * block))), strict=True)
                yield pa.RecordBatch.from_pydict({"block": [i], "after": pa.array([after], pa.list_(pa.int32())), "ends": [list(ends)], "closes": [list(closes)]})

    rows = spark.range(0, blocks, 1, blocks).mapInArrow(mapped, "block bigint, after array<int>, ends array<bigint>, closes array<boolean>").collect()
    state, number, fresh, plan = START, 0, True, []
    for r in sorted(rows, key=lambda r: r["block"]):
        plan.append((r["block"], state, number if fresh else number + 1, fresh))  # a record that began before isn't this block's
        number, fresh, state = number + r["ends"][state], r["closes"][state], r["after"][state]
    entries = spark.createDataFrame(plan, "block bigint, state int, first bigint, fresh boolean").repartition(blocks, "block")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, state, first, fresh in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                base, data = i * block, _bytes(path, i * block, min(block, size - i * block))
                ends, after = record_ends(data, state)
                stop = len(data)
                begins = [0] if fresh else []
                begins += [e + 1 for e in ends.tolist() if e + 1 < stop]
                ends = ends.tolist() if fresh else ends.tolist()[1:]
                if len(begins) > len(ends) and base + len(data) < size:  # the last record goes on in later blocks
                    while base + len(data) < size:
                        more = _bytes(path, base + len(data), min(1 << 20, size - base - len(data)))
                        found, after = record_ends(more, after)
                        if len(found):
                            ends.append(len(data) + int(found[0]))
                            data += more
                            break
                        data += more
                ends += [len(data)] * (len(begins) - len(ends))
                lines = [data[a:b] for a, b in zip(begins, ends, strict=True)]
                if base == 0 and lines and lines[0].startswith(BOM):
                    lines[0] = lines[0][len(BOM) :]
                text = [(x[:-1] if x.endswith(b"\r") else x).decode("utf-8", "replace") for x in lines]
                numbers = pa.array(range(first, first + len(text)), pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, pa.array([base + a for a in begins], pa.int64()), pa.array(text, pa.string())], ["source_record", "byte_at", "raw_line"])

    return entries.mapInArrow(cut, "source_record bigint, byte_at bigint, raw_line string")


def read_split_export(spark: SparkSession, path: str, columns: Sequence[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)`` of a CSV export of any size: contracted columns as text with ``source_record`` (1 for the
    first after the header), and ``source_record, byte_at, reason, error`` of records with broken quoting or a wrong
    number of columns. A header that isn't the agreed one is an error; empty records are passed over."""
    records = read_records(spark, path, block)
    header = records.where("source_record = 0").select("raw_line").first()
    named = tokenize(spark.createDataFrame([(header["raw_line"] if header else "",)], "line string"), "line", []).first()["fields"]
    if named != list(columns):
        raise ContractError(f"{path}: columns {named}, agreed were {list(columns)}")
    cells = tokenize(records.where("source_record > 0 and raw_line <> ''"), "raw_line", ["source_record", "byte_at"])
    reason = F.when(F.col("error_at").isNotNull(), "quoting").when(F.size("fields") != len(columns), "column_count")
    judged = cells.withColumn("reason", reason)
    rows = judged.where("reason is null").select("source_record", *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return rows, judged.where("reason is not null").select("source_record", (F.col("byte_at") + F.coalesce("error_at", F.lit(0))).alias("byte_at"), "reason", "error")
