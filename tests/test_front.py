import pytest
from pyspark.sql import functions as F

from ledgerloom.query import listing as L
from ledgerloom.query import questions as Q

STATES = ["UTTAR TOR", "TOR", "ANDAMAN & ISLES"]


def intent(q):
    return Q.understood(q, STATES)


@pytest.mark.parametrize(
    "question,measure,group,descending,limit",
    [
        ("top states by pending payments", "pending_paise", "state", True, 10),
        ("bottom 5 states by settled-to-sanction ratio", "paid_share", "state", False, 5),
        ("Worst three states by utilisation", "paid_share", "state", False, 3),
        ("best states by utilisation", "paid_share", "state", True, 10),
        ("Which districts in Uttar Tor have the most delays?", "open_long", "ida", True, 10),
        ("top states with no payment after three months in 2024-25", "unpaid", "state", True, 10),
        ("Top 99 vendors by payments", "paid_paise", "vendor", True, 50),
        ("states in Uttar Tor by payments", "paid_paise", "ida", True, 10),
        ("payments by month in Tor", "paid_paise", "month", True, 10),
    ],
)
def test_rankings(question, measure, group, descending, limit):
    i = intent(question)
    assert (i.measure, i.group, i.descending, i.limit) == (measure, group, descending, limit)


def test_filters_and_single_numbers():
    i = intent("How many works were sanctioned in 2024-25 in Andaman and Isles, upper house?")
    assert i.group is None and i.filters == {"cohort": ["rs_sitting", "rs_retired"], "sanction_fy": ["2024-2025"]}
    assert intent("total sanctioned amount").group is None
    assert intent("works in Andaman & Isles in FY 2024 25").filters == {"state": ["ANDAMAN & ISLES"], "sanction_fy": ["2024-2025"]}
    assert intent("average works in Tor").notes


@pytest.mark.parametrize("question", ["", "  ", "x" * 301, "Which states are corrupt?", "predict payments", "colour of the sky", "vendors by payments in Tor", "payments in 2024-29", "works by month"])
def test_refusals(question):
    assert isinstance(intent(question), Q.Refusal)


def works(spark):
    rows = [(f"c:{i}", "c", "TOR" if i % 3 else "UTTAR TOR", "A (X)", f"hall {i}%", 100 + i, i, 5, 1, i % 2 == 0, True, True, "2024-2025", None, None) for i in range(60)]
    return spark.createDataFrame(rows, "work_key string, cohort string, state string, ida string, description string, sanction_paise bigint, paid_paise bigint, pending_paise bigint, success_rows bigint, any_repeat boolean, is_sanctioned boolean, is_recommended boolean, sanction_fy string, recommendation_date date, sanction_date date").withColumns({"activity": F.lit("a"), "paid_ratio": F.col("paid_paise") / F.col("sanction_paise"), "profile": F.lit("p"), "stage": F.lit("s")})


def test_answers(spark):
    w = works(spark)
    pay = spark.createDataFrame([("c:1", "V1", True, 5, "2024-01-05"), ("c:2", "V2", False, 7, "2024-02-05")], "work_key string, vendor string, is_success boolean, paise bigint, d string").withColumn("paid_on", F.to_date("d")).withColumn("state", F.lit("TOR"))
    a = Q.asked("states by payments", w, pay)
    assert [(r["name"], r["value"]) for r in a.rows.collect()] == [("TOR", sum(i for i in range(60) if i % 3)), ("UTTAR TOR", sum(range(0, 60, 3)))]
    assert "DROP" not in Q.asked("works in Tor'; DROP TABLE x; --", w, pay).sql
    assert Q.asked("how many works in Tor", w, pay).rows.first()["works"] == 40
    assert [r["name"] for r in Q.asked("top vendors by pending payments", w, pay).rows.collect()] == ["V2", "V1"]
    assert [r["name"] for r in Q.asked("payments by month", w, pay).rows.collect()] == ["2024-01", "2024-02"]
    assert isinstance(Q.asked("who is guilty", w, pay), Q.Refusal)
    assert Q.asked("top districts by repeated payments in Tor", w.withColumn("any_repeat", F.lit(False)), pay).summary() == "None found"
    assert Q.asked("works in Tor", w, pay).summary() == "40 over 40 works"
    assert isinstance(Q.asked("states by cost outliers", w, pay), Q.Refusal)  # these works have no such column
    names = spark.createDataFrame([("ida", "A (X)", "A (X)", "alpha"), ("ida", "B", "B", "beta"), ("profile", "p", "Beta", "beta")], "kind string, key string, name string, phrase string")
    assert Q.asked("works of alpha", w, pay, names=names).params == {"ida_0": "A (X)"}
    assert Q.asked("tell me about alpha", w, pay, names=names).rows.first()["works"] == 60
    assert Q.asked("works of beta", w, pay, names=names).names.count() == 2
    assert isinstance(Q.asked("colour of the sky", w, pay, names=names), Q.Refusal)


def test_each_measure_is_reached():
    for question, measure in {
        "states by average sanction amount": "mean_sanction", "average priority score by state": "mean_score", "completion": None, "share of completed works by state": "completed_share", "high priority works by state": "high_score",
        "which states have finished works": "completed", "states with works awaiting sanction": "not_sanctioned", "completed works without payment by state": "completed_unpaid", "cost overruns by state": "over_completed",
        "march rush by district": "march", "states by works paid over sanction": "over_paid", "sanction delays by state": "slow_sanction", "states by duplicate payments": "repeats", "similar works by district": "alike",
        "cost outliers by activity": "dear", "sanctioned works by year": "sanctioned", "works by priority band": "works", "money sanctioned by house": "sanction_paise", "how much was spent": "paid_paise",
    }.items():
        got = intent(question)
        assert (got.measure if isinstance(got, Q.Intent) else None) == measure, question


def test_listing(spark):
    w = works(spark)
    hits = L.WORKS.filtered(w, {"state": "TOR"}, "any_repeat", "1%")
    assert {r["work_key"] for r in hits.collect()} == set()
    hits = L.WORKS.filtered(w, {"state": ["TOR", "UTTAR TOR"]}, None, "1%")
    assert L.WORKS.summary(hits).first()["rows"] == 6
    assert [r["work_key"] for r in L.WORKS.page(w, "sanction_paise", True, 2, 1).collect()] == ["c:58", "c:57"]
    for bad in (lambda: L.WORKS.filtered(w, {"nope": "1"}), lambda: L.WORKS.filtered(w, {}, "nope"), lambda: L.WORKS.page(w, "nope"), lambda: L.WORKS.page(w, "work_key", True, 0), lambda: L.WORKS.filtered(w, {"state": "x" * 301}), lambda: L.WORKS.filtered(w, {}, None, "x" * 201)):
        with pytest.raises(L.BadRequest):
            bad()
    names = spark.createDataFrame([("ida", "k1", "Jaun", "jaun"), ("ida", "k2", "Jaun Pur", "jaun pur"), ("ida", "k3", "X", "x")], "kind string, key string, name string, phrase string")
    assert [tuple(r) for r in L.resolved_names(names, "tell me about jaun pur please").collect()] == [("ida", "k2", "Jaun Pur")]
    assert L.resolved_names(names, "nothing here x").count() == 0
