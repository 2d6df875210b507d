"""Order statistics, earlier years and leave-one-out against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from ledgerloom.operators import peers as P


def frame(spark, rows):
    return spark.createDataFrame(rows, "work_key string, state string, activity string, sanction_fy string, paise bigint")


def test_earlier_years_alone_make_the_benchmark(spark):
    rows = [(f"a{i}", "S", "road", "2024-2025", 10_000) for i in range(20)] + [("last", "S", "road", "2025-2026", 40_000_000_00), ("far", "T", "road", "2025-2026", 10_000), ("null", "S", "road", "2025-2026", None), ("no year", "S", "road", None, 5), ("no kind", "S", None, "2025-2026", 5)]
    got = {r["work_key"]: r for r in P.cost_benchmark(frame(spark, rows), "work_key").collect()}
    assert len(got) == len(rows)
    assert (got["last"]["peers"], round(got["last"]["median_inr"], 6), got["last"]["level"], got["last"]["outlier"]) == (20, 100, "state and activity", True)
    assert (got["far"]["peers"], got["far"]["level"], got["far"]["outlier"]) == (20, "activity", False)
    assert got["a3"]["log_z"] is None and got["a3"]["level"] == "none" and got["null"]["log_z"] is None and not got["no year"]["outlier"]
    short = [r for r in rows if r[0] != "a0"]
    assert {r["level"] for r in P.cost_benchmark(frame(spark, short), "work_key").collect()} == {"none"}
    assert P.cost_benchmark(frame(spark, []), "work_key").count() == 0


def test_leave_one_out_literal(spark):
    rows = [(f"a{i}", "S", "road", "x", 100) for i in range(11)] + [("last", "S", "road", "x", 10_000)]
    got = {r["work_key"]: r for r in P.peer_scores(frame(spark, rows), "work_key", [["state", "activity"], []], "paise").collect()}
    last = got["last"]
    assert (last["level"], last["others"], last["median"], last["method"], last["scale"]) == (0, 11, 100.0, "tenth of the median", 10.0)
    assert last["z"] > 3.5 and last["ratio"] == 100


def test_leave_one_out_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"w{i}", rng.choice(["S", "T", None]), rng.choice(["a", "b", "c"]), "x", rng.choice([None, 0, 5, 7, *range(20, 60)])) for i in range(120)]
    got = {r["work_key"]: r for r in P.peer_scores(frame(spark, rows), "work_key", [["state", "activity"], ["activity"], []], "paise").collect()}
    for key, state, activity, _, paise in rows:
        if not paise:
            assert key not in got
            continue
        for level, fits in enumerate((lambda r: r[1:3] == (state, activity), lambda r: r[2] == activity, lambda r: True)):
            others = [r[4] for r in rows if r[4] and r[0] != key and fits(r)]
            if len(others) >= 10 or level == 2:
                break
        median = statistics.median(others)
        mad = statistics.median(abs(v - median) for v in others)
        assert (got[key]["level"], got[key]["others"], got[key]["median"]) == (level, len(others), median)
        if mad:
            assert abs(got[key]["scale"] - 1.4826 * mad) < 1e-9


def test_order_values(spark):
    rng = random.Random(5)
    values = [(g, rng.randrange(30)) for g in ("a", "b", None) for _ in range(rng.randrange(1, 50))]
    counts = spark.createDataFrame(values, "g string, v int").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    found = {r["g"]: r for r in P.order_values(counts, ["g"], "v", "c", {"first": F.lit(0), "last": F.col("n") - 1, "beyond": F.col("n")}).collect()}
    for g in ("a", "b", None):
        mine = sorted(v for k, v in values if k == g)
        assert (found[g]["n"], found[g]["first"], found[g]["last"], found[g]["beyond"]) == (len(mine), mine[0], mine[-1], None)
