"""Scalar columns: text, names, dates, ratios and money."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words before a name that aren't part of it.
HONORIFICS = ("shri", "sri", "shree", "smt", "shrimati", "dr", "prof", "adv", "honble")
#: Words that tell little about a work.
STOP_WORDS = tuple(
    "a an the of for and at in to with from by near construction installation purchase providing work works supply development village gram panchayat ward no "
    "number district block under proposed new existing".split()
)
#: Words that announce a further part of a work.
PHASE_WORDS = ("phase", "continued", "continue", "continuation", "extension", "part", "repair", "renovation")


_NO_WORD = re.compile(r"[\W_]+")


def either(conditions: list[Column]) -> Column:
    """True if any condition is; no condition gives false."""
    return reduce(Column.__or__, conditions, F.lit(False))


def both(conditions: list[Column]) -> Column:
    """True if all conditions are; no condition gives true."""
    return reduce(Column.__and__, conditions, F.lit(True))


def ascii_norm(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single blanks; JVM-side, for text known to be ASCII."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def folded_text(s: pd.Series) -> pd.Series:
    """Unicode-aware normal form: NFKC, casefold, underscores, marks and punctuation as single blanks; null stays null.

    Spark has no NFKC, so whole Arrow batches go to Python, once for each distinct text of a batch.
    """
    forms = {x: " ".join(_NO_WORD.sub(" ", unicodedata.normalize("NFKC", x).casefold()).split()) for x in set(s.dropna())}
    return pd.Series([forms.get(x) for x in s], dtype=object)


@F.pandas_udf(T.StringType())
def unmarked(s: pd.Series) -> pd.Series:
    """Place names for matching: marks stripped, lower case, ``&`` read as ``and``, single blanks."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        text = "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch))
        return " ".join(text.lower().replace("&", " and ").split())

    return s.map(one)


def name_key(c: Column) -> Column:
    """A name without leading honorifics, blanks and punctuation."""
    words = "|".join(HONORIFICS)
    return F.regexp_replace(F.regexp_replace(ascii_norm(F.regexp_replace(c, "['’.]", "")), rf"^(?:(?:{words}) )+", ""), " ", "")


def words_of(c: Column) -> Column:
    """Distinct words that aren't stop words; empty text gives an empty array."""
    words = F.filter(F.array_distinct(F.split(c, r"\s+")), lambda w: w != "")
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def numbers_of(c: Column) -> Column:
    """Distinct whole numbers that stand alone in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d+)\b"))))


def trigrams_of(c: Column) -> Column:
    """Distinct runs of three characters; shorter texts have none."""
    at = F.when(F.length(c) >= 3, F.sequence(F.lit(1), F.length(c) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; null if both are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared elements over all elements of two sets; null if both are empty."""
    return ratio(2 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as a double; null unless the denominator is positive."""
    return F.when(bottom > 0, top.cast("double") / bottom)


def fiscal_year(d: Column) -> Column:
    """``YYYY-YYYY`` from April to March; null stays null."""
    y = F.year(F.add_months(d, -3))
    return F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"))


def fiscal_quarter(d: Column) -> Column:
    """1 for April to June, up to 4."""
    return F.quarter(F.add_months(d, -3))


def last_days_of_fiscal_year(d: Column) -> Column:
    """Whether a date is one of the last thirty days of a fiscal year."""
    return (F.month(d) == 3) & (F.dayofmonth(d) >= 2)


def month_of(d: Column) -> Column:
    """``YYYY-MM``."""
    return F.date_format(d, "yyyy-MM")


def next_month(month: Column) -> Column:
    """The month after a ``YYYY-MM``."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1), "yyyy-MM")


def material(amount: Column, floor: int, share: float) -> Column:
    """The larger of a fixed amount and a share of a column."""
    return F.greatest(F.lit(float(floor)), share * amount.cast("double"))


def binned(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first bin whose upper edge (inclusive) isn't exceeded; null stays null."""
    out = F.when(value.isNull(), None)
    for upper, label in edges:
        out = out.when(value <= upper, label)
    return out.otherwise(last)


def clipped(value: Column, low: float, high: float) -> Column:
    """The share of the way from ``low`` to ``high``, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def divisible(c: Column, by: int) -> Column:
    """Whether a whole number is a multiple of another; null stays null."""
    return F.pmod(c, F.lit(by)) == 0


def rupees(paise: Column) -> Column:
    """An amount as text: in crore from ten million rupees on, in lakh from a hundred thousand on, else in whole rupees."""
    crore, lakh = 1_000_000_000, 10_000_000

    def of(unit: int) -> Column:
        """Rounded half up to hundredths of a unit, in whole numbers."""
        more = paise + unit // 200
        hundredths = ((more - F.pmod(more, F.lit(unit // 100))) / (unit // 100)).cast("bigint")
        return F.concat(((hundredths - F.pmod(hundredths, F.lit(100))) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(hundredths, F.lit(100)).cast("string"), 2, "0"))

    return (
        F.when(paise >= crore, F.concat(F.lit("INR "), of(crore), F.lit(" crore")))
        .when(paise >= lakh, F.concat(F.lit("INR "), of(lakh), F.lit(" lakh")))
        .when(paise.isNotNull(), F.concat(F.lit("INR "), F.floor(paise / 100).cast("string")))
    )


def without_prefix(c: Column, words: list[str]) -> Column:
    """Text without the first of some words at its beginning and the blanks, hyphens or underscores after it."""
    return F.regexp_replace(c, rf"^({'|'.join(map(re.escape, words))})[-_ ]*", "")


def formula_safe(c: Column) -> Column:
    """A cell that spreadsheet programs won't read as a formula: an apostrophe before ``= + - @``, tab and CR."""
    return F.when(c.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def fingerprint(columns: list[Column]) -> Column:
    """SHA-256 of a row's values as a JSON array, so values can't run into each other; nulls differ from blanks."""
    texts = [F.coalesce(F.to_json(F.array(c.cast("string"))), F.lit("[null]")) for c in columns]
    return F.sha2(F.concat_ws("|", *[F.when(c.isNull(), "[null]").otherwise(t) for c, t in zip(columns, texts, strict=True)]), 256)


def tie_break(seed: str, c: Column) -> Column:
    """A fixed pseudo-random order for equal scores: 16 hexadecimal digits compared as text."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256), 1, 16)


def short_hash(space: str, c: Column) -> Column:
    """24 hexadecimal digits that stand for a key of a name space."""
    return F.substring(F.sha2(F.concat(F.lit(f"{space}|"), c.cast("string")), 256), 1, 24)


def listed_reasons(flags: list[tuple[str, Column]]) -> Column:
    """The names of the true flags in the given order, joined by semicolons; none gives an empty text."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags])), ";")


def residue_cleaned(c: Column) -> tuple[Column, Column]:
    """``(paise, residue)`` of an amount whose decimals carry float noise of at most 0.000001 rupees; else both null."""
    plain = F.regexp_replace(c, r"^\s+|\s+$", "")
    exact = F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain).try_cast("decimal(38,12)")  # a cast would take digits of other scripts, too
    whole = F.round(exact * 100, 0)
    beyond = exact * 100 - whole  # in paise: a quotient of decimals would lose digits
    near = F.abs(beyond) <= 0.0001
    return F.when(near, whole.try_cast("bigint")), F.when(near, beyond.cast("double") / 100)
