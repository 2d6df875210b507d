import random
from datetime import datetime, timedelta

from ledgerloom.operators.orphans import MAX_BLOCKS, block_filter, blocks_for, ledger_references, orphan_references, orphan_report

WORK = "record_id bigint, cohort string, work_recommendation_dtl_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string, block int"
PAY = "record_id bigint, cohort string, work_recommendation_dtl_id string, vendor_id string, loaded_at timestamp_ntz, block int"
VENDOR = "vendor_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def tables(spark, rec, san, pay, vendors):
    work = lambda rows: spark.createDataFrame([(i, c, k, day(a), day(d), "clash", 1) for i, (c, k, a, d) in enumerate(rows)], WORK)
    return [
        work(rec),
        work(san),
        spark.createDataFrame([(i, c, k, v, day(a), 0) for i, (c, k, v, a) in enumerate(pay)], PAY),
        spark.createDataFrame([(v, day(a), day(d)) for v, a, d in vendors], VENDOR),
    ]


def found(spark, *args):
    return sorted((r["child_table"], r["child_field"], r["record_id"]) for r in orphan_references(ledger_references(*tables(spark, *args))).collect())


def test_cases(spark):
    rec = [("a", "1", 0, None), ("a", "2", 5, None), ("a", "3", 0, 4), ("b", "1", 0, None), (None, "9", 0, None)]
    san = [("a", " 001.0", 1, None), ("a", "2", 1, None), ("a", "3", 4, None), ("a", "3", 3, None), ("a", "7", 1, None), ("a", None, 1, None), ("a", "NA ", 1, None), ("a", "1", None, None), ("b", "1", 0, None)]
    out = found(spark, rec, san, [("a", "1", " v 1", 2), ("a", "99", "V2", 2), ("a", "99", "V2", 2), ("b", "", "", 2)], [("V1", 0, None), ("V2", 0, 2)])
    assert [x[2] for x in out if x[0] == "works_sanctioned"] == [1, 2, 4, 7]
    assert [x[2] for x in out if x[:2] == ("expenditure", "work_recommendation_dtl_id")] == [1, 2]
    assert [x[2] for x in out if x[:2] == ("expenditure", "vendor_id")] == [1, 2]


def test_empty_parents_and_children(spark):
    assert found(spark, [], [], [], []) == []
    assert len(found(spark, [], [("a", "1", 1, None)], [("a", "1", "v", 0)], [])) == 3


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(2)
    key = lambda: "7" if rng.random() < 0.4 else str(rng.randrange(60))
    rec = [(rng.choice("ab"), key(), rng.randrange(30), rng.choice([None, rng.randrange(60)])) for _ in range(150)]
    san = [(rng.choice("ab"), key(), rng.randrange(60), None) for _ in range(400)]
    live = lambda c, k, at: any(rc == c and rk == k and ra <= at and (rd is None or rd > at) for rc, rk, ra, rd in rec)
    want = [i for i, (c, k, a, _) in enumerate(san) if not live(c, k, a)]
    out = found(spark, rec, san, [], [])
    assert [x[2] for x in out] == want


def test_filter_never_loses_a_key_and_its_size_is_bounded(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) as key")
    assert block_filter(keys, 64).count() <= 64
    assert blocks_for(0) == 1 and blocks_for(10**12) == MAX_BLOCKS


def test_report(spark):
    refs = orphan_references(ledger_references(*tables(spark, [], [("a", "1", 1, None), ("a", "1", 1, None), ("a", "2", 40, None)], [], [])))
    assert sorted((r["month"], r["orphans"], r["keys"]) for r in orphan_report(refs).collect()) == [("2024-01", 2, 1), ("2024-02", 1, 1)]
