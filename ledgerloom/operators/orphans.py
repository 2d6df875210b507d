"""Problem 2: references to records that do not exist (split-block Bloom filter, then an exact anti join).

The live parents' keys are folded into a Bloom filter that is built by a distributed ``bit_or`` aggregate and
broadcast by its blocks. A reference whose bits are missing has no parent at all: a definite orphan, which never
takes part in a shuffle. Only filter-positive references are joined exactly, with the condition on time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.values import code_key, number_key

#: Words of 64 bits in a block; every key sets one bit in each.
WORDS = 8
#: Bits of filter for each parent row, and the most blocks that are ever broadcast (2**17 x 64 bytes = 8 MiB of bits).
BITS_PER_ROW = 16
MAX_BLOCKS = 1 << 17


@dataclass(frozen=True)
class Reference:
    """One foreign key: ``child`` and ``parent`` tables with columns that are compared by equality.

    ``key`` and ``parent_key`` are columns that give null for "no reference"; rows are told apart by ``row_id``.
    A parent row counts from ``since`` (inclusive) until ``until`` (exclusive; null: for ever).
    """

    child_table: str
    child_field: str
    child: DataFrame
    key: list[Column]
    row_id: Column
    at: Column
    parent_table: str
    parent: DataFrame
    parent_key: list[Column]
    since: Column
    until: Column | None = None


def _joined(space: str, parts: list[Column]) -> Column:
    """One text for a composite key, unambiguous between parts; null if any part is null."""
    pieces = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.concat(F.lit(space + "|"), *pieces)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The single bit that a key has in a word: six of the bits of a second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(F.xxhash64(key, F.lit("word")), 6 * word).bitwiseAND(63).cast("int"))


def block_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter's rows ``(block, w0..w7)``; ``keys`` has one column ``key``, nulls are passed over.

    Its size depends on ``blocks`` alone, never on the data.
    """
    k = F.col("key")
    return (
        keys.where(k.isNotNull())
        .groupBy(_block(k, blocks).alias("block"))
        .agg(*[F.bit_or(_bit(k, i)).alias(f"w{i}") for i in range(WORDS)])
    )


def blocks_for(rows: int) -> int:
    """Blocks for so many parent rows: a power of two, at most :data:`MAX_BLOCKS`.

    Beyond that bound the filter fills up: it then settles fewer references, and the exact join takes the rest.
    """
    need = max(1, rows * BITS_PER_ROW // (64 * WORDS))
    return min(MAX_BLOCKS, 1 << (need - 1).bit_length())


def orphan_references(references: list[Reference]) -> DataFrame:
    """Every reference without a live parent: ``child_table, child_field, record_id, key, at``.

    Live is a record that was loaded by the time ``at`` and not yet deleted then. Null keys are no references. A null ``at`` is before nothing, so such a reference is an orphan;
    a null ``since`` never makes a record live. Repeated child rows count one by one; an empty parent table makes
    every reference an orphan. A key held by a large part of the references isn't gathered: the anti join's hot
    partitions are split by adaptive execution, and parents of a key are first reduced to one row for each time
    of deletion.
    """
    rows = sum(df.count() for df in {id(r.parent): r.parent for r in references}.values())
    blocks = blocks_for(rows)
    children = reduce(
        DataFrame.unionByName,
        [
            r.child.select(
                F.lit(r.child_table).alias("child_table"),
                F.lit(r.child_field).alias("child_field"),
                r.row_id.alias("record_id"),
                _joined(r.parent_table, r.key).alias("key"),
                r.at.alias("at"),
            )
            for r in references
        ],
    ).where(F.col("key").isNotNull())
    distinct: dict[str, Reference] = {r.parent_table: r for r in references}
    parents = reduce(
        DataFrame.unionByName,
        [
            r.parent.select(
                _joined(r.parent_table, r.parent_key).alias("key"),
                r.since.cast("timestamp_ntz").alias("since"),
                (F.lit(None) if r.until is None else r.until).cast("timestamp_ntz").alias("until"),
            )
            for r in distinct.values()
        ],
    ).where(F.col("key").isNotNull())

    k = F.col("key")
    bits = F.broadcast(block_filter(parents.select("key"), blocks))
    here = reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(_bit(k, i)) != 0 for i in range(WORDS)])
    probed = children.withColumn("block", _block(k, blocks)).join(bits, "block", "left").withColumn("maybe", F.coalesce(here, F.lit(False)))
    keep = ["child_table", "child_field", "record_id", "key", "at"]
    definite = probed.where(~F.col("maybe")).select(*keep)

    spans = parents.groupBy(k.alias("p_key"), "until").agg(F.min("since").alias("since"))
    live = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at")))
    dead = probed.where("maybe").select(*keep).join(spans, (k == F.col("p_key")) & live, "left_anti")
    return definite.unionByName(dead)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field and month of arrival (null month: arrival unknown)."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return found.groupBy("child_table", "child_field", month).agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("key").alias("keys"))


def ledger_references(recommended: DataFrame, sanctioned: DataFrame, expenditure: DataFrame, vendors: DataFrame) -> list[Reference]:
    """The three foreign keys of the works ledger."""
    work = lambda: [F.coalesce(F.col("cohort"), F.lit("")), number_key(F.col("work_recommendation_dtl_id"))]
    vendor = lambda: [code_key(F.col("vendor_id"))]
    at = F.col("loaded_at").cast("timestamp_ntz")
    both = {"row_id": F.col("record_id"), "at": at, "since": F.col("loaded_at"), "until": F.col("deleted_at")}
    return [
        Reference("works_sanctioned", "work_recommendation_dtl_id", sanctioned, work(), parent_table="works_recommended", parent=recommended, parent_key=work(), **both),
        Reference("expenditure", "work_recommendation_dtl_id", expenditure, work(), parent_table="works_sanctioned", parent=sanctioned, parent_key=work(), **both),
        Reference("expenditure", "vendor_id", expenditure, vendor(), parent_table="vendor_features", parent=vendors, parent_key=vendor(), **both),
    ]
