"""Problem 5: rows that fail to parse (quote-aware finite-state tokenizer over raw records).

The machine has five states; what a byte does is a map from states to states, and maps compose. A batch of records
is one buffer of special symbols, cut into chunks of equal length wherever the cuts fall. All chunks are run at
once from every state, which gives each chunk's map; composing the maps gives the state at each chunk's start; a
second run from there marks every field's end and every error. A record's end resets the machine, so records may
lie across chunks and chunks across records. Everything is NumPy over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.schemas import extended
from ledgerloom.functions.values import amount_paise, date_of, is_amount, is_date, present

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
OTHER, COMMA, QUOTE, BREAK, END = range(5)

#: NEXT[symbol][state]. END is the end of a record, not a byte.
NEXT = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],  # any other byte
        [START, START, QUOTED, START, BROKEN],  # comma
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],  # quote
        [BROKEN, BROKEN, QUOTED, BROKEN, BROKEN],  # line break
        [START, START, START, START, START],
    ],
    dtype=np.uint8,
)
SYMBOL = np.zeros(256, dtype=np.uint8)
SYMBOL[ord(",")], SYMBOL[ord('"')], SYMBOL[ord("\n")], SYMBOL[ord("\r")] = COMMA, QUOTE, BREAK, BREAK
#: Symbols in a chunk.
CHUNK = 256


def states_before(symbols: np.ndarray, chunk: int = CHUNK, table: np.ndarray = NEXT, start: int = START) -> np.ndarray:
    """The machine's state before each symbol, by composing the chunks' maps (``start`` before the first)."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.uint8)
    rows, maps = _chunk_maps(symbols, chunk, table)
    entry = np.empty(len(rows), dtype=np.uint8)
    state = start
    for i, m in enumerate(maps.tolist()):
        entry[i] = state
        state = m[state]
    out = np.empty(rows.shape, dtype=np.uint8)
    at = entry
    for t in range(chunk):
        out[:, t] = at
        at = table[rows[:, t], at]
    return out.reshape(-1)[:n]


def _chunk_maps(symbols: np.ndarray, chunk: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols in rows of ``chunk`` (the last one filled up) and what each row does to every state."""
    chunks = -(-len(symbols) // chunk)
    rows = np.full(chunks * chunk, OTHER, dtype=np.uint8)
    rows[: len(symbols)] = symbols
    rows = rows.reshape(chunks, chunk)
    maps = np.broadcast_to(np.arange(5, dtype=np.uint8), (chunks, 5)).copy()
    for t in range(chunk):
        maps = table[rows[:, t, None], maps]
    return rows, maps


def tokenized(lines: pa.Array) -> pa.RecordBatch:
    """``fields`` (list of text without its quotes), ``error_at`` and ``error`` for each record.

    ``error_at`` is the byte at which the quoting breaks: the first byte that no state allows, or the record's
    length if a quoted field never ends. ``error`` says which; both are null for a sound record. The fields of a
    broken record are null. A null record is read like an empty one: one empty field.
    """
    lines = pa.array(lines.fill_null(""), pa.large_string()) if lines.type != pa.large_string() or lines.null_count else lines
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
    first = offsets[0] if len(offsets) else 0
    data = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)[first : offsets[-1]] if len(lines) else np.zeros(0, np.uint8)
    offsets = offsets - first
    n = len(lines)

    # Only special bytes, and the first other byte after one or after a record's begin, change a state.
    kind = SYMBOL[data]
    change = kind != OTHER
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets[:-1]] = True
    after = np.ones(len(data), dtype=bool)
    after[1:] = change[:-1]
    place = np.flatnonzero(change | after | begins[:-1])
    # The symbols in order, with an END after each record.
    ends_before = np.searchsorted(offsets[1:], place, side="right")
    symbols = np.empty(len(place) + n, dtype=np.uint8)
    at_symbol = np.arange(len(place)) + ends_before
    symbols[at_symbol] = kind[place]
    at_end = np.searchsorted(place, offsets[1:], side="left") + np.arange(n)
    symbols[at_end] = END
    before = states_before(symbols)

    was = before[at_symbol]
    now = NEXT[kind[place], was]
    final = before[at_end]
    broken = (final == BROKEN) | (final == QUOTED)
    fresh = np.flatnonzero((now == BROKEN) & (was != BROKEN))
    length = np.diff(offsets)
    error_at = np.where(final == QUOTED, length, 0)
    error_at[ends_before[fresh]] = place[fresh] - offsets[:-1][ends_before[fresh]]
    why = np.full(n, "", dtype=object)
    for state, says in ((PLAIN, "quote or line break inside an unquoted field"), (START, "line break in an unquoted field"), (CLOSED, "text after a closing quote")):
        why[ends_before[fresh[was[fresh] == state]]] = says
    why[final == QUOTED] = "quoted field without an end"

    # Bytes that stay: all but the commas between fields, the outer quotes and the first of doubled quotes.
    record_broken = np.repeat(broken, length)
    stay = ~record_broken
    divides = (kind[place] == COMMA) & (was != QUOTED) & (was != BROKEN)
    drop = divides | ((kind[place] == QUOTE) & ((was == START) | (was == QUOTED)))
    stay[place[drop]] = False
    kept = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(stay, out=kept[1:])
    divides &= ~broken[ends_before]
    sound = np.flatnonzero(~broken)
    stops = np.concatenate([place[divides], offsets[1:][sound]])
    owner = np.concatenate([ends_before[divides], sound])
    order = np.lexsort((stops, owner))
    field_ends = kept[stops[order]]
    field_offsets = np.zeros(len(field_ends) + 1, dtype=np.int64)
    field_offsets[1:] = field_ends
    text = pa.LargeStringArray.from_buffers(len(field_ends), pa.py_buffer(field_offsets), pa.py_buffer(np.ascontiguousarray(data[stay])))
    starts = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=starts[1:])
    lists = pa.ListArray.from_arrays(pa.array(starts), text.cast(pa.string()), mask=pa.array(broken) if n else None)
    return pa.RecordBatch.from_arrays(
        [lists, pa.array(error_at, pa.int64(), mask=~broken), pa.array(why, pa.string(), mask=~broken)],
        ["fields", "error_at", "error"],
    )


def tokenize(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """Add ``fields``, ``error_at`` and ``error`` (see :func:`tokenized`) to the columns ``keep``.

    Columns named like the added ones must not be in ``keep``. One pass, no shuffle.
    """
    schema = extended(df.select(*keep).schema, "fields array<string>, error_at bigint, error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = tokenized(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made.columns], [*keep, *made.schema.names])

    return df.select(*keep, F.col(line).alias("__line")).mapInArrow(run, schema)


#: Fields of each kind of file.
EXPENDITURE_FIELDS = ["sno", "work_recommendation_dtl_id", "vendor_id", "vendor_name", "ia_name", "work_status", "state_name", "ida_name", "mp_name", "work_id", "expenditure_date", "fund_disbursed_amt"]
ALLOCATION_FIELDS = ["mp_name", "state_name", "constituency", "house_of_parliament", "house_name", "tenure", "tenure_start_date", "tenure_end_date", "allocated_amt"]
FILES = {"06_expenditure.csv": EXPENDITURE_FIELDS, "01_allocated_limit.csv": ALLOCATION_FIELDS}


def _bad_payment(date: Column, amount: Column) -> Column:
    return ~is_date(date) | ~is_amount(amount)


def _bad_allocation(amount: Column) -> Column:
    return present(amount) & ~is_amount(amount)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Every record of ``export_lines`` with its fields and its ``reason`` (null: sound).

    The first that applies: ``quoting``, ``column_count`` (by the file's kind; a record of an unknown file has
    none), ``value``. Adds ``error_at`` and ``error`` for broken quoting.
    """
    cells = tokenize(lines.select("line_id", "source_file", "cohort", "raw_line", "loaded_at"), "raw_line", ["line_id", "source_file", "cohort", "loaded_at"])
    pay, allot = (F.col("source_file") == name for name in FILES)
    want = F.when(pay, len(EXPENDITURE_FIELDS)).when(allot, len(ALLOCATION_FIELDS))
    field = lambda names, name: F.get("fields", F.lit(names.index(name)))
    value = F.when(pay, _bad_payment(field(EXPENDITURE_FIELDS, "expenditure_date"), field(EXPENDITURE_FIELDS, "fund_disbursed_amt"))).when(allot, _bad_allocation(field(ALLOCATION_FIELDS, "allocated_amt")))
    reason = F.when(F.col("error_at").isNotNull(), "quoting").when(F.size("fields") != want, "column_count").when(value, "value")
    return cells.withColumn("reason", reason)


def rejected_rows(lines: DataFrame, expenditure: DataFrame, allocated: DataFrame) -> DataFrame:
    """``src_table, row_key, reason`` of every row that fails; nulls in dates and amounts count as blank."""
    bad = parsed_lines(lines).where(F.col("reason").isNotNull()).select(F.lit("export_lines").alias("src_table"), F.col("line_id").alias("row_key"), "reason")
    pay = expenditure.where(_bad_payment(F.col("expenditure_date"), F.col("fund_disbursed_amt"))).select(F.lit("expenditure").alias("src_table"), F.col("record_id").alias("row_key"), F.lit("value").alias("reason"))
    allot = allocated.where(_bad_allocation(F.col("allocated_amt"))).select(F.lit("allocated_limit").alias("src_table"), F.col("record_id").alias("row_key"), F.lit("value").alias("reason"))
    return bad.unionByName(pay).unionByName(allot)


def loaded_payments(lines: DataFrame) -> DataFrame:
    """The sound payment records of ``export_lines`` as typed rows, repeated lines included."""
    rows = parsed_lines(lines).where((F.col("source_file") == "06_expenditure.csv") & F.col("reason").isNull())
    cell = {name: F.get("fields", F.lit(i)) for i, name in enumerate(EXPENDITURE_FIELDS)}
    named = [cell[n].alias(n) for n in EXPENDITURE_FIELDS[:-2]]
    return rows.select("line_id", "cohort", *named, date_of(cell["expenditure_date"]).alias("expenditure_date"), amount_paise(cell["fund_disbursed_amt"]).alias("fund_disbursed_paise"), "loaded_at")


def loaded_allocations(lines: DataFrame) -> DataFrame:
    """The sound allocation records of ``export_lines`` as typed rows; a blank or ``NA`` amount is null."""
    rows = parsed_lines(lines).where((F.col("source_file") == "01_allocated_limit.csv") & F.col("reason").isNull())
    cell = {name: F.get("fields", F.lit(i)) for i, name in enumerate(ALLOCATION_FIELDS)}
    named = [cell[n].alias(n) for n in ALLOCATION_FIELDS[:-1]]
    return rows.select("line_id", "cohort", *named, amount_paise(cell["allocated_amt"]).alias("allocated_paise"), "loaded_at")


#: The machine over a raw file: a line feed outside quotes ends a record; broken quoting is judged later, record by record.
FILE_NEXT = NEXT.copy()
FILE_NEXT[BREAK] = [START, START, QUOTED, START, START]
FILE_NEXT[QUOTE, PLAIN], FILE_NEXT[OTHER, CLOSED] = PLAIN, PLAIN
#: In a file a carriage return is a byte like others; one before a line feed is cut off later.
FILE_SYMBOL = SYMBOL.copy()
FILE_SYMBOL[ord("\r")] = OTHER


def _places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block that can change a state, and their symbols."""
    symbols = FILE_SYMBOL[np.frombuffer(data, dtype=np.uint8)]
    change = symbols != OTHER
    keep = change.copy()
    keep[1:] |= change[:-1]
    keep[:1] = True
    at = np.flatnonzero(keep)
    return at, symbols[at]


def record_ends(data: bytes, state: int = START) -> tuple[np.ndarray, int]:
    """Offsets of the line feeds that end records in a block entered in ``state``, and the state at its end."""
    if not data:
        return np.zeros(0, dtype=np.int64), state
    at, symbols = _places(data)
    before = states_before(symbols, table=FILE_NEXT, start=state)
    return at[(symbols == BREAK) & (before != QUOTED)], int(FILE_NEXT[symbols[-1], before[-1]]) if at[-1] == len(data) - 1 else int(FILE_NEXT[OTHER, FILE_NEXT[symbols[-1], before[-1]]])


def block_map(data: bytes) -> list[tuple[int, int, bool]]:
    """For each state in which a block may be entered: the state at its end, the records that end in it, and whether its
    last byte ends one. Blocks can so be read on different machines, and their maps composed."""
    out = []
    for state in range(5):
        ends, after = record_ends(data, state)
        out.append((after, len(ends), bool(len(ends) and ends[-1] == len(data) - 1)))
    return out
