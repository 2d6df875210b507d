import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import relational as R


def test_joins_check_their_keys(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(R.CardinalityError):
        R.joined_many_to_one(left, right, ["k"])
    assert R.joined_one_to_one(left, right.limit(1), ["k"]).count() == 2
    assert {r["k"]: r["match"] for r in R.matched(left, right.limit(1), ["k"]).collect()} == {1: "Matched", 2: "Unmatched"}


def test_every_row_gets_a_key_of_its_own(spark):
    rows = [("a", 2.0), ("a", 1.0), ("b", 1.0), ("a", 2.0), (None, 3.0), (None, 1.0)]
    got = {r["k"]: r["v"] for r in R.own_keys(spark.createDataFrame(rows, "k string, v double"), "k", [F.col("v")]).collect()}
    assert got == {"a": 1.0, "a\x1f2": 2.0, "a\x1f3": 2.0, "b": 1.0, "\x1f1": 1.0, "\x1f2": 3.0}


def test_merge_prefers_the_first_side_and_keeps_blanks(spark):
    a = spark.createDataFrame([(1, ""), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    got = {r["k"]: (r["v"], r["in_first"], r["in_second"]) for r in R.merged_outer(a, b, ["k"]).collect()}
    assert got == {1: ("", True, True), 2: ("y", True, True), 3: ("z", False, True)}


def test_strictly_prior_windows(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 10), ("a", "2024-01-01", 20), ("a", "2024-01-02", 30), ("a", "2024-06-01", 40), ("a", "2024-06-01", None)], "k string, d string, x int").withColumn("d", F.col("d").cast("date"))
    w, near = R.prior_window("k", "d"), R.prior_window("k", "d", 90)
    got = rows.select("d", "x", F.count(F.lit(1)).over(w).alias("n"), R.prior_sum_if_known("x", w).alias("s"), F.count(F.lit(1)).over(near).alias("m")).orderBy("d", "x").collect()
    assert sorted((r["n"], r["s"], r["m"]) for r in got) == [(0, 0, 0), (0, 0, 0), (2, 30, 2), (3, 60, 0), (3, 60, 0)]
    by_day = R.prior_by_day(rows, "k", "d", "x").collect()
    assert sorted((r["earlier"], r["earlier_known"], r["earlier_if_known"]) for r in by_day) == [(0, 0, 0), (0, 0, 0), (2, 30, 30), (3, 60, 60), (3, 60, 60)]
    assert sorted(r["earlier"] for r in R.prior_by_day(rows, "k", "d", "x", 90).collect()) == [0, 0, 0, 0, 2]
    unknown = rows.withColumn("x", F.when(F.col("x") != 10, F.col("x"))).select("d", R.prior_sum_if_known("x", w).alias("s")).where("d > '2024-01-01'").collect()
    assert {r["s"] for r in unknown} == {None}


def test_ranks_over_all_rows(spark):
    rng = random.Random(4)
    values = [rng.choice([None, 1.0, 2.0, 2.0, 5.0, rng.random()]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    known = sorted(v for v in values if v is not None)
    avg = {v: (known.index(v) + 1 + len(known) - known[::-1].index(v)) / 2 * 100 / len(known) for v in known}
    got = {r["id"]: r["p"] for r in R.percent_rank_avg(df, "v", "p").collect()}
    assert all((got[i] is None) if v is None else abs(got[i] - avg[v]) < 1e-9 for i, v in enumerate(values))
    placed = [(r["place"], r["v"]) for r in R.ranked(df.dropna(), [F.col("v").desc(), F.col("id")], "place").orderBy("place").collect()]
    assert [p for p, _ in placed] == list(range(1, len(known) + 1)) and [v for _, v in placed] == known[::-1]


def test_search_page_gaps_and_quarantine(spark):
    df = spark.createDataFrame([(1, "50% done", None), (2, "500", "x_y"), (3, None, "XaY")], "k int, a string, b string")
    assert [r["k"] for r in R.searched(df, "0%", ["a", "b"]).collect()] == [1]
    assert [r["k"] for r in R.searched(df, "x_", ["a", "b"]).collect()] == [2]
    assert [r["k"] for r in R.paged(df, [F.col("k").desc()], 1, 1).collect()] == [2]
    with pytest.raises(ValueError):
        R.paged(df, [F.col("k")], 101)
    months = spark.createDataFrame([("2024-11",), ("2024-12",), ("2025-02",)], "m string")
    assert [(r["m"], r["following"]) for r in R.month_gaps(months, "m").collect()] == [("2024-12", "2025-02")]
    sound, rejected = R.quarantined(df, ["a", "b"])
    assert [r["k"] for r in sound.collect()] == [2] and {r["k"]: r["missing_fields"] for r in rejected.collect()} == {1: "b", 3: "a"}


def test_conflicts_latest_and_concentration(spark):
    a, b = spark.createDataFrame([(1, "x", None), (2, "q", "z")], "k int, v string, w string"), spark.createDataFrame([(1, "y", None), (3, "q", "z")], "k int, v string, w string")
    assert [(r["field"], r["first_value"], r["second_value"]) for r in R.conflicts(a, b, "k", ["v", "w"]).collect()] == [("v", "x", "y")]
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, None)], "k string, n int, v string")
    assert {r["k"]: r["v"] for r in R.latest(log, ["k"], ["n"]).collect()} == {"a": "new", "b": None}
    pay = spark.createDataFrame([("g", "a", 3), ("g", "b", 1), ("g", None, 9), ("h", "a", 0)], "g string, m string, x int")
    got = {r["g"]: (r["hhi"], r["top_share"]) for r in R.concentration(pay, ["g"], "m", "x").collect()}
    assert got == {"g": (0.625, 0.75), "h": (None, None)}


def test_dictionary(spark):
    df = R.documented(spark.range(1), "twice", F.col("id") * 2, "the id, doubled", "id")
    got = {r["field"]: (r["type"], r["meaning"]) for r in R.dictionary({"t": df}).collect()}
    assert got == {"id": ("bigint", None), "twice": ("bigint", "the id, doubled")}
