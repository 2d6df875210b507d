"""Queries of the data-quality operators of the core: orphan references and rows that fail to parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.delimited import ALLOCATION_FIELDS, EXPENDITURE_FIELDS, loaded_allocations, loaded_payments, parsed_lines, rejected_rows
from ledgerloom.operators.orphans import ledger_references, orphan_references, orphan_report
from ledgerloom.sources.tables import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("works_recommended", "works_sanctioned", "expenditure", "vendor_features")
    return orphan_references(ledger_references(*[table(spark, sf_dir, n) for n in names]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a live record."""
    return _orphans(spark, sf_dir).select("child_table", "child_field", "record_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These references counted per table, field and month of loaded_at."""
    return orphan_report(_orphans(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail to parse, with the reason."""
    return rejected_rows(*[table(spark, sf_dir, n) for n in ("export_lines", "expenditure", "allocated_limit")])


def p5_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with broken quoting: the byte at which it breaks and how."""
    lines = parsed_lines(table(spark, sf_dir, "export_lines"))
    return lines.where(F.col("reason") == "quoting").select("line_id", "source_file", "error_at", "error")


def p5_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound payment lines, typed."""
    return loaded_payments(table(spark, sf_dir, "export_lines"))


def p5_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound allocation lines, typed."""
    return loaded_allocations(table(spark, sf_dir, "export_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p5_found": p5_found,
    "p5_errors": p5_errors,
    "p5_payments": p5_payments,
    "p5_allocations": p5_allocations,
}

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WORK = r"regexp_replace(regexp_replace({0}, '^([0-9]+)\.0+$', '\1'), '^0+([0-9]+)$', '\1')".format(_STRIP.format("{0}work_recommendation_dtl_id"))
_VENDOR = r"upper(regexp_replace({0}vendor_id, '\s+', '', 'g'))"
_GIVEN = "coalesce(" + _STRIP + " NOT IN ('', 'NA'), FALSE)"

_ORPHANS = f"""
SELECT 'works_sanctioned' AS child_table, 'work_recommendation_dtl_id' AS child_field, c.record_id, c.loaded_at, c.cohort || {_WORK.format("c.")} AS k
FROM works_sanctioned c WHERE {_GIVEN.format("c.work_recommendation_dtl_id")} AND NOT EXISTS (
  SELECT 1 FROM works_recommended p WHERE p.cohort = c.cohort AND {_WORK.format("p.")} = {_WORK.format("c.")}
    AND p.loaded_at <= c.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > c.loaded_at))
UNION ALL
SELECT 'expenditure', 'work_recommendation_dtl_id', c.record_id, c.loaded_at, c.cohort || {_WORK.format("c.")}
FROM expenditure c WHERE {_GIVEN.format("c.work_recommendation_dtl_id")} AND NOT EXISTS (
  SELECT 1 FROM works_sanctioned p WHERE p.cohort = c.cohort AND {_WORK.format("p.")} = {_WORK.format("c.")}
    AND p.loaded_at <= c.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > c.loaded_at))
UNION ALL
SELECT 'expenditure', 'vendor_id', c.record_id, c.loaded_at, {_VENDOR.format("c.")}
FROM expenditure c WHERE {_GIVEN.format("c.vendor_id")} AND NOT EXISTS (
  SELECT 1 FROM vendor_features p WHERE {_VENDOR.format("p.")} = {_VENDOR.format("c.")}
    AND p.loaded_at <= c.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > c.loaded_at))"""

_AMOUNT = r"^[0-9]+(\.[0-9]{{1,2}}|\.[0-9]{{2}}(0*|0000[0-9]*|00010*|9999[0-9]*))?$"
_OK_AMOUNT = "coalesce(regexp_matches(" + _STRIP + f", '{_AMOUNT}'), FALSE)"
_OK_DATE = (
    "(coalesce(regexp_matches(" + _STRIP + r", '^[0-9]{{2}}-[A-Za-z]{{3}}-[0-9]{{4}}$'), FALSE) AND try_strptime(" + _STRIP + ", '%d-%b-%Y') IS NOT NULL)"
)
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_BROKEN = f"NOT regexp_full_match(coalesce(raw_line, ''), '{_FIELD}(?:,{_FIELD})*')"
_COUNT = r"""len(regexp_extract_all(regexp_replace(coalesce(raw_line, ''), '"(?:[^"]|"")*"', 'q', 'g'), ',')) + 1"""

_REJECTED = rf"""
WITH l AS (SELECT *, {_BROKEN} AS broken, {_COUNT} AS n FROM export_lines),
v AS (
  SELECT *,
    trim(regexp_extract(raw_line, '(?:^|,)("(?:[^"]|"")*"|[^",]*)$', 1), '"') AS amt,
    trim(regexp_extract(raw_line, '(?:^|,)("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)$', 1), '"') AS dat
  FROM l),
r AS (
  SELECT line_id, CASE
    WHEN broken THEN 'quoting'
    WHEN n <> CASE WHEN source_file = '06_expenditure.csv' THEN 12 ELSE 9 END THEN 'column_count'
    WHEN source_file = '06_expenditure.csv' AND NOT ({_OK_DATE.format("dat")} AND {_OK_AMOUNT.format("amt")}) THEN 'value'
    WHEN source_file = '01_allocated_limit.csv' AND {_GIVEN.format("amt")} AND NOT {_OK_AMOUNT.format("amt")} THEN 'value' END AS reason
  FROM v)
SELECT 'export_lines' AS src_table, line_id AS row_key, reason FROM r WHERE reason IS NOT NULL
UNION ALL
SELECT 'expenditure', record_id, 'value' FROM expenditure WHERE NOT ({_OK_DATE.format("expenditure_date")} AND {_OK_AMOUNT.format("fund_disbursed_amt")})
UNION ALL
SELECT 'allocated_limit', record_id, 'value' FROM allocated_limit WHERE {_GIVEN.format("allocated_amt")} AND NOT {_OK_AMOUNT.format("allocated_amt")}"""

#: A sound line's fields: each with the comma before it, then without quotes. A comma is put before the line, so an empty
#: first field is found like others.
_CELLS = r"""list_transform(regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END)"""


def _loaded(file: str, fields: list[str]) -> str:
    cells = ", ".join(f"c[{i + 1}] AS {name}" for i, name in enumerate(fields))
    return f"f AS (SELECT line_id, cohort, loaded_at, {cells} FROM (SELECT *, {_CELLS} AS c FROM export_lines WHERE NOT ({_BROKEN}) AND source_file = '{file}') WHERE len(c) = {len(fields)})"


_PAISE = "CAST(round(CAST(" + _STRIP + " AS DOUBLE) * 100) AS BIGINT)"

SQL: dict[str, str] = {
    "p5_payments": f"WITH {_loaded('06_expenditure.csv', EXPENDITURE_FIELDS)} SELECT line_id, cohort, {', '.join(EXPENDITURE_FIELDS[:-2])}, CAST(try_strptime({_STRIP.format('expenditure_date')}, '%d-%b-%Y') AS DATE) AS expenditure_date, {_PAISE.format('fund_disbursed_amt')} AS fund_disbursed_paise, loaded_at FROM f WHERE {_OK_DATE.format('expenditure_date')} AND {_OK_AMOUNT.format('fund_disbursed_amt')}",
    "p5_allocations": f"WITH {_loaded('01_allocated_limit.csv', ALLOCATION_FIELDS)} SELECT line_id, cohort, {', '.join(ALLOCATION_FIELDS[:-1])}, CASE WHEN {_OK_AMOUNT.format('allocated_amt')} THEN {_PAISE.format('allocated_amt')} END AS allocated_paise, loaded_at FROM f WHERE {_OK_AMOUNT.format('allocated_amt')} OR NOT ({_GIVEN.format('allocated_amt')})",
    "p2_found": f"SELECT child_table, child_field, record_id FROM ({_ORPHANS})",
    "p2_report": f"SELECT child_table, child_field, strftime(loaded_at, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT k) AS keys FROM ({_ORPHANS}) GROUP BY ALL",
    "p5_found": _REJECTED,
}
