"""Columns for text values as typed: blanks, identifiers, amounts and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English months of three letters.
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"

#: ASCII digits, optionally a point and digits; beyond whole paise at most 0.0001 paise are left over.
AMOUNT = r"^[0-9]+(\.[0-9]{1,2}|\.[0-9]{2}(0*|0000[0-9]*|00010*|9999[0-9]*))?$"
DATE = r"^[0-9]{2}-[A-Za-z]{3}-[0-9]{4}$"


def stripped(c: Column) -> Column:
    """Text without white space around it; null stays null."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """True where an id, amount or date was given: not null, not blank and not ``NA``."""
    return F.coalesce(~stripped(c).isin("", "NA"), F.lit(False))


def number_key(c: Column) -> Column:
    """An id as a whole number in canonical text: blanks, leading zeros and a final ``.0`` mean nothing.

    An id that is no whole number keeps its stripped text; blank and ``NA`` give null.
    """
    s = stripped(c)
    return F.when(present(c), F.regexp_replace(F.regexp_replace(s, r"^([0-9]+)\.0+$", "$1"), r"^0+(?=[0-9]+$)", ""))


def code_key(c: Column) -> Column:
    """An id without any blanks and in upper case; blank and ``NA`` give null."""
    return F.when(present(c), F.upper(F.regexp_replace(c, r"\s+", "")))


def is_amount(c: Column) -> Column:
    """Whether the text is a valid amount (see :data:`AMOUNT`); null counts as not valid."""
    return F.coalesce(stripped(c).rlike(AMOUNT), F.lit(False))


def amount_paise(c: Column) -> Column:
    """Whole paise of a valid amount, rounded half up; null for anything else and beyond 64 bits."""
    exact = stripped(c).try_cast("decimal(38,12)")
    return F.when(is_amount(c), F.round(exact * 100, 0).try_cast("bigint"))


def date_of(c: Column) -> Column:
    """The date of a text dd-Mmm-yyyy (month in any letter case); null where no such day exists."""
    s = stripped(c)
    day = F.substring(s, 1, 2).cast("int")
    at = F.instr(F.lit(MONTHS), F.upper(F.substring(s, 4, 3)))
    year = F.substring(s, 8, 4).cast("int")
    first = F.make_date(year, F.floor((at - 1) / 3).cast("int") + 1, F.lit(1))
    shaped = s.rlike(DATE) & (at > 0) & ((at - 1) % 3 == 0)
    return F.when(shaped, F.when((year > 0) & day.between(1, 31), F.when(day <= F.dayofmonth(F.last_day(first)), F.date_add(first, day - 1))))


def is_date(c: Column) -> Column:
    """Whether the text is a valid date; null counts as not valid."""
    return date_of(c).isNotNull()
