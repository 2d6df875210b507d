"""Filters, sorting, search and pages over a table of works."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import both
from ledgerloom.operators.relational import paged, searched

LONGEST_VALUE, LONGEST_SEARCH = 300, 200


class BadRequest(ValueError):
    """A request that names an unknown column or breaks a bound."""


@dataclass(frozen=True)
class Listing:
    """What may be asked of a table: columns for equality, boolean signals, sort keys and searched columns."""

    key: str
    equal: Sequence[str] = ()
    signals: Sequence[str] = ()
    sorts: Sequence[str] = ()
    search: Sequence[str] = ()
    totals: Sequence[str] = ()

    def filtered(self, df: DataFrame, filters: Mapping[str, str], signal: str | None = None, text: str | None = None) -> DataFrame:
        """Rows that meet all filters; a list of values means any of them."""
        tests = []
        for name, value in filters.items():
            if name not in self.equal:
                raise BadRequest(f"no filter {name}")
            values = [value] if isinstance(value, str) else list(value)
            if any(len(v) > LONGEST_VALUE for v in values):
                raise BadRequest(f"{name} is too long")
            tests.append(F.col(name).isin(values))
        if signal is not None:
            if signal not in self.signals:
                raise BadRequest(f"no signal {signal}")
            tests.append(F.coalesce(F.col(signal), F.lit(False)))
        out = df.where(both(tests)) if tests else df
        if text:
            if len(text) > LONGEST_SEARCH:
                raise BadRequest("the search is too long")
            out = searched(out, text, self.search)
        return out

    def page(self, df: DataFrame, sort: str, descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page by an allowed key; the table's key settles ties."""
        if sort not in self.sorts:
            raise BadRequest(f"no sort key {sort}")
        try:
            return paged(df, [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first(), F.col(self.key)], limit, offset)
        except ValueError as e:
            raise BadRequest(str(e)) from e

    def summary(self, df: DataFrame) -> DataFrame:
        """Rows and totals of all filtered rows, whatever the page."""
        return df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in self.totals])


#: Rows of a work's pairs that its detail shows.
MOST_PAIRS = 100


def work_detail(works: DataFrame, reasons: DataFrame, pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(row, reasons, pairs)`` of one work: its columns, its rules by points, and its most similar works.

    ``works`` and ``reasons`` have ``work_key``, ``pairs`` has ``a, b, similarity``. An unknown work has no rows.
    """
    mine = pairs.where((F.col("a") == key) | (F.col("b") == key)).orderBy(F.col("similarity").desc(), "a", "b").limit(MOST_PAIRS)
    return works.where(F.col("work_key") == key), reasons.where(F.col("work_key") == key).orderBy(F.col("points").desc(), "rule"), mine


def pairs_page(pairs: DataFrame, works: DataFrame, key: str, shown: Sequence[str], text: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(page, total)`` of pairs ``a, b, similarity, high`` with the columns ``shown`` of both works; ``text`` must
    stand in a key or a shown column of either. High ones come first, then by similarity and keys."""
    if text and len(text) > LONGEST_SEARCH:
        raise BadRequest("the search is too long")
    side = lambda s: works.select(F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in shown])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    if text:
        both = searched(both, text, ["a", "b", *[f"{c}_{s}" for c in shown for s in "ab"]])
    order = [F.col("high").desc(), F.col("similarity").desc(), F.col("a"), F.col("b")]
    return paged(both, order, limit, offset), both.agg(F.count(F.lit(1)).alias("total"))


def table_page(df: DataFrame, key: str, order: Sequence[Column], text: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(page, total)`` of any table: ``text`` must stand in some column, whatever its type."""
    if text and len(text) > LONGEST_SEARCH:
        raise BadRequest("the search is too long")
    rows = searched(df, text, df.columns) if text else df
    try:
        return paged(rows, [*order, F.col(key)], limit, offset), rows.agg(F.count(F.lit(1)).alias("total"))
    except ValueError as e:
        raise BadRequest(str(e)) from e


def entity_reasons(works: DataFrame, reasons: DataFrame, column: str, value: str) -> DataFrame:
    """``rule, works, points`` over the works of an entity."""
    mine = works.where(F.col(column) == value).select("work_key")
    return reasons.join(mine, "work_key", "left_semi").groupBy("rule").agg(F.count_distinct("work_key").alias("works"), F.sum("points").alias("points"))


def status(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``name, columns, rows`` of some tables; row counts of Parquet tables come from their footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(len(df.columns)).alias("columns"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.union, parts)


WORKS = Listing(
    key="work_key",
    equal=("cohort", "state", "ida", "sanction_fy", "activity", "stage", "profile"),
    signals=("any_repeat", "is_sanctioned", "is_recommended"),
    sorts=("sanction_paise", "paid_paise", "pending_paise", "paid_ratio", "recommendation_date", "work_key"),
    search=("work_key", "description", "ida", "activity"),
    totals=("sanction_paise", "paid_paise", "pending_paise"),
)


def entity_years(works: DataFrame, column: str, value: str) -> DataFrame:
    """An entity's works by fiscal year, with a bucket for works without one."""
    return works.where(F.col(column) == value).groupBy(F.coalesce("sanction_fy", F.lit("Not recorded")).alias("fy")).agg(F.count(F.lit(1)).alias("works"), F.sum("sanction_paise").alias("sanction_paise"), F.sum("paid_paise").alias("paid_paise"))


def vendor_works(works: DataFrame, payments: DataFrame, vendor: str) -> DataFrame:
    """Works that a vendor was paid for."""
    return works.join(payments.where(F.col("vendor") == vendor).select("work_key"), "work_key", "left_semi")


def resolved_names(names: DataFrame, question: str) -> DataFrame:
    """``kind, key, name`` of the entities whose whole normalised name stands in a question: those of the longest name.

    ``names`` has ``kind, key, name, phrase``; an authority may also have what stands before its bracket as a phrase.
    Phrases of less than three characters are no names. The result stays a table: names may be many.
    """
    padded = F.lit(f" {question} ")
    hit = names.where((F.length("phrase") >= 3) & padded.contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    longest = hit.agg(F.max(F.length("phrase"))).first()[0] or 0
    return hit.where(F.length("phrase") == longest).select("kind", "key", "name").distinct()
