from datetime import date

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions import values as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_amounts(spark):
    cases = {"0": 0, "": None, "NA": None, "1.05": 105, "99996500.01": 9999650001, "102221195.92999999": 10222119593, "1.001": None, " 7 ": 700, "7.": None, ".5": None, "-1": None, "1.000001": 100, "1.00000100": 100, "1.00009": None, "1.00001": None, None: None}
    assert {k: one(spark, V.amount_paise, k) for k in cases} == cases


def test_dates(spark):
    cases = {"01-Jan-2024": date(2024, 1, 1), "29-FEB-2024": date(2024, 2, 29), "29-feb-2023": None, "31-Apr-2024": None, "1-Jan-2024": None, "01-Foo-2024": None, "01-anF-2024": None, "00-Jan-2024": None, " 05-Dec-1999 ": date(1999, 12, 5), "": None, None: None, "01-Jan-0000": None}
    assert {k: one(spark, V.date_of, k) for k in cases} == cases


def test_keys(spark):
    assert [one(spark, V.number_key, x) for x in (" 0012.0 ", "12", "000", "NA", " ", None, "X1")] == ["12", "12", "0", None, None, None, "X1"]
    assert [one(spark, V.code_key, x) for x in (" v 01 ", "NA", "", None)] == ["V01", None, None, None]


def test_fiscal_dates(spark):
    assert [one(spark, S.fiscal_year, d, "date") for d in (date(2026, 3, 31), date(2026, 4, 1), None)] == ["2025-2026", "2026-2027", None]
    assert [one(spark, S.fiscal_quarter, date(2024, m, 1), "date") for m in (4, 7, 12, 1)] == [1, 2, 3, 4]
    assert one(spark, lambda c: F.add_months(c, 3), date(2025, 11, 30), "date") == date(2026, 2, 28)


def test_texts(spark):
    assert one(spark, S.ascii_norm, "  ROAD,  School! ") == "road school"
    assert [one(spark, S.name_key, x) for x in ("Dr. Name A-B", "Shrikant Name")] == ["nameab", "shrikantname"]
    assert [one(spark, S.folded_text, x) for x in ("ＲＯＡＤ_Straße!", None)] == ["road strasse", None]
    assert one(spark, S.unmarked, "Jammū &  Kaśmīr") == "jammu and kasmir"
    assert one(spark, S.numbers_of, "12 a 7 b12 12") == ["12", "7"]
    assert one(spark, S.trigrams_of, "ab") == [] and one(spark, S.trigrams_of, "abcd") == ["abc", "bcd"]
    assert one(spark, S.formula_safe, "=1") == "'=1" and one(spark, S.formula_safe, "1") == "1"


def test_ratio_and_residue(spark):
    rows = spark.createDataFrame([(0, 2), (1, 0), (None, 1)], "a int, b int").select(S.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in rows] == [0.0, None, None]
    paise, delta = S.residue_cleaned(F.col("x"))
    got = spark.createDataFrame([("102221195.92999999",), ("1.001",)], "x string").select(paise.alias("p"), F.round(delta, 8).alias("d")).collect()
    assert (got[0]["p"], got[0]["d"], got[1]["p"]) == (10222119593, -1e-08, None)


def test_fingerprint_keeps_values_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), ("a", "[null]")], "x string, y string")
    assert df.select(S.fingerprint([F.col("x"), F.col("y")]).alias("f")).distinct().count() == 5
