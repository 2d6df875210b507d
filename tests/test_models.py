import math
import random
import re
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import PHASE_WORDS, STOP_WORDS
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import models as M
from ledgerloom.operators.similar_works import all_similar, best_matches, scored_pair, similar_pairs
from ledgerloom.plans.analysis import q_unsupervised
from ledgerloom.plans.ledger import leave_one_out
from ledgerloom.streaming import events as S


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(400, 30.0, 30.0), (401, None, float("nan"))]
    got = {r["k"]: r["score"] for r in M.isolation_scores(spark.createDataFrame(rows, "k int, a double, b double"), "k", ["a", "b"]).collect()}
    assert max(got, key=got.get) == 400 and len(got) == 402
    flat = M.isolation_scores(spark.createDataFrame([(i, 1.0) for i in range(20)], "k int, a double"), "k", ["a"]).collect()
    assert {round(r["score"], 6) for r in flat} == {0.5}
    assert M.isolation_scores(spark.createDataFrame([], "k int, a double"), "k", ["a"]).count() == 0


def test_isolation_forest_splits_neighbouring_and_endless_numbers(spark):
    near = float(np.nextafter(1.0, 2.0))
    for low, high in ((1.0, near), (-math.inf, math.inf), (1.0, math.inf), (-math.inf, 1.0), (-1e308, 1e308)):
        forest = M.Forest(np.array([[low]] * 200 + [[high]] * 100), 3)
        assert np.isfinite(forest.scores(np.array([[low], [high]]))).all()
        assert all(low < s <= high for s in forest.split[forest.feature >= 0])
    rows = [(i, near if i % 3 else 1.0) for i in range(300)]
    assert M.isolation_scores(spark.createDataFrame(rows, "k int, a double"), "k", ["a"]).count() == 300


def test_lowest_rows_by_hash(spark):
    spread = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    assert M._lowest(spread, "h", 40) == spread.orderBy("h").limit(40).collect()
    assert len(M._lowest(spread.withColumn("h", F.lit(7).cast("bigint")), "h", 40)) == 40  # equal hashes leave too few below the bound
    assert len(M._lowest(spread.limit(30), "h", 40)) == 30


def test_unsupervised_of_works_with_neighbouring_ratios(spark, tmp_path):
    near = float(np.nextafter(0.7, 1.0))
    rows = [(f"w{i}", 5_000_000, 5_000_000, near if i % 3 else 0.7, date(2024, 1, 1), date(2024, 2, 1)) for i in range(300)]
    rows += [(f"x{i}", 5_000_000, 5_000_000, 4.0, date(2024, 1, 1), date(2024, 2, 1)) for i in range(3)]
    schema = "work_id string, recommended_amount_paise bigint, sanction_amount_paise bigint, cost_peer_ratio double, recommendation_date date, sanction_date date"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "work_features.parquet"))
    got = {(r["model"], r["budget"]): (r["taken"], r["recovered"]) for r in q_unsupervised(spark, str(tmp_path)).collect()}
    assert {b: got["isolation", b] for b in (0.05, 0.1, 0.2, 0.3)} == {0.05: (16, 3), 0.1: (31, 3), 0.2: (61, 3), 0.3: (91, 3)}


def test_unsupervised_counts_rows_that_repeat_an_id(spark, tmp_path):
    rows = [(f"w{i % 100}" if i % 50 else None, 5_000_000, 5_000_000, 0.7 + i % 5 / 100, date(2024, 1, 1), date(2024, 2, 1)) for i in range(300)]
    rows += [("w1", 5_000_000, 5_000_000, 4.0, date(2024, 1, 1), date(2024, 2, 1)), ("x", 500, 5_000_000, 4.0, date(2024, 1, 1), date(2024, 9, 1))] * 2
    schema = "work_id string, recommended_amount_paise bigint, sanction_amount_paise bigint, cost_peer_ratio double, recommendation_date date, sanction_date date"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "work_features.parquet"))
    got = {(r["model"], r["budget"]): (r["taken"], r["recovered"]) for r in q_unsupervised(spark, str(tmp_path)).collect()}
    assert {b: got["isolation", b] for b in (0.05, 0.1, 0.2, 0.3)} == {0.05: (16, 4), 0.1: (31, 4), 0.2: (61, 4), 0.3: (92, 4)}
    assert [v for (m, _), v in got.items() if m == "density"] == [(2, 2)]  # the rows of x are far from all others


def test_density_clusters_equal_a_plain_dbscan(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, size=(80, 2)) for c in ((0, 0), (6, 6))] + [rng.uniform(-4, 10, size=(30, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k int, a double, b double")
    got = {r["k"]: r["cluster"] for r in M.density_clusters(df, "k", ["a", "b"], 0.4, 12).collect()}
    z = np.round((x - x.mean(0)) / x.std(0), 1)
    near = ((z[:, None] - z[None]) ** 2).sum(-1) <= 0.16 + 1e-9
    core = near.sum(1) >= 12
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        new = np.array([min(label[near[i] & core], default=-1) if core[i] else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        for j in range(i):
            if core[i] and core[j]:
                assert (label[i] == label[j]) == (got[i] == got[j])
        assert (got[i] == -1) == (not (near[i] & core).any())


def test_leave_one_out(spark):
    df = spark.createDataFrame([(str(i), "g", v) for i, v in enumerate([100] * 11 + [10000])], "k string, g string, v bigint")
    got = {r["k"]: (r["peers"], r["median_others"]) for r in leave_one_out(df, "k", "g", "v", 10).collect()}
    assert got["11"] == (11, 100.0) and len(got) == 12
    values = [3, 9, 1, 7, 7, 2, 8, 4, 6, 5, 0, 11, 12]
    df = spark.createDataFrame([(str(i), "g", v) for i, v in enumerate(values)], "k string, g string, v bigint")
    for r in leave_one_out(df, "k", "g", "v", 10).collect():
        assert r["median_others"] == np.median([v for i, v in enumerate(values) if i != int(r["k"])])


def test_confusion_cut_and_bootstrap(spark):
    df = spark.createDataFrame([(4, True), (3, False), (2, True), (1, False), (0, None)], "s int, t boolean")
    assert tuple(E.confusion(df, F.col("s") >= 3, F.col("t")).first()) == (1, 1, 1, 2)
    days = spark.createDataFrame([(datetime(2024, 1, d).date(),) for d in (1, 1, 2, 3, 3, 3, 4, 5, 6, 7)], "d date")
    assert E.cut_date(days, "d", 0.7).day == 4 and E.cut_date(days.limit(0), "d", 0.7) is None
    arms = spark.createDataFrame([(f"c{i}", 0, 1) for i in range(50)], "c string, a int, b int")
    r = E.paired_bootstrap(arms, "c", "a", "b", 100).first()
    assert (r["mean"], r["low"], r["high"], r["rounds"]) == (1.0, 1.0, 1.0, 100)
    assert E.paired_bootstrap(arms.limit(0), "c", "a", "b", 10).first()["mean"] is None


def month_rows(spark, n, skip=None):
    months = [f"{2022 + i // 12}-{i % 12 + 1:02}" for i in range(n)]
    return spark.createDataFrame([(m, 100 + 7 * i) for i, m in enumerate(months) if i != skip], "m string, x bigint"), months


def test_forecast_uses_the_past_alone(spark):
    df, months = month_rows(spark, 20)
    folds = E.forecast_folds(df, "m", "x", "2023-08").collect()
    assert len(folds) == 13 and sum(r["split"] == "test" for r in folds) == 3
    assert all(r["last"] == r["actual"] - 7 for r in folds)
    changed = df.withColumn("x", F.when(F.col("m") == "2023-08", 10**9).otherwise(F.col("x")))
    assert sorted(map(tuple, E.forecast_folds(changed, "m", "x", "2023-08").collect())) == sorted(map(tuple, folds))
    assert {r["method"]: r["chosen"] for r in E.chosen_forecast(E.forecast_folds(df, "m", "x", "2023-08")).collect()} == {"last": True, "mean3": False}
    assert E.forecast_folds(month_rows(spark, 20, skip=12)[0], "m", "x", "2023-08").count() == 0
    assert E.forecast_folds(month_rows(spark, 14)[0], "m", "x", "2023-03").count() == 0


def test_crowded_block_keeps_an_exact_pair(spark):
    rows = [(f"w{i:03}", "ida", "act", "community hall beside pond with boundary", 1000 + i) for i in range(1, 201)]
    rows[199] = ("w200", "ida", "act", rows[0][3], 1001)
    got = {(r["a"], r["b"]): r for r in similar_pairs(spark.createDataFrame(rows, "k string, i string, t string, d string, x bigint"), "k", ["i", "t"], "d", "x").collect()}
    assert got["w001", "w200"]["high"] and got["w001", "w200"]["similarity"] == 1.0
    assert all(a < b for a, b in got)


def test_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i), i % 3, "click", 1.0, "{}") for i in range(60)]
    rows += [rows[5]]
    spark.createDataFrame(rows, S.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/events.parquet"))
    (tmp_path / "flat").mkdir()
    part = next((tmp_path / "in/events.parquet").glob("part*"))
    (tmp_path / "flat/events.parquet").write_bytes(part.read_bytes())
    stream = S.event_stream(spark, str(tmp_path / "flat"))
    got = {r["start"].isoformat(): r["n"] for r in S.run_to_parquet(S.window_counts(stream), "t").collect()}
    assert got == {"2024-01-01T00:00:00": 25, "2024-01-02T00:00:00": 24}
    assert S.run_to_parquet(S.deduplicated(stream, ["event_id"]), "d").count() == 60
    q = S.ledger_upserts(stream, str(tmp_path / "led"), ["user_id"], ["ts"], str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    view = lambda name: {r["user_id"]: r["event_id"] for r in S.ledger_view(spark, str(tmp_path / name), ["user_id"], ["ts"]).collect()}
    assert view("led") == {0: 57, 1: 58, 2: 59}
    S.ledger_compacted(spark, str(tmp_path / "led"), ["user_id"], ["ts"], str(tmp_path / "small"))
    assert view("small") == view("led") and len(list((tmp_path / "small").iterdir())) == 1


def test_block_matches_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(160):
        # Alike in frequent words only, with rare ones of their own: the bounded search has none of these anchors in common.
        base = words[:14] if i % 2 else words[10:26]
        text = " ".join(w for w in base if rng.random() > 0.03) + rng.choice(["", " part", " 7", f" odd{i}"])
        rows.append((f"k{i:03d}", rng.choice("ab"), text if i % 40 else None, rng.choice([100, 200, None])))
    rows += [(f"s{i:03d}", "a", "the same text of all these works", 300) for i in range(12)]
    df = spark.createDataFrame(rows, "work string, block string, text string, amount bigint")
    sets = {k: set((t or "").split()) - set(STOP_WORDS) for k, _, t, _ in rows}
    count = Counter(w for s in sets.values() for w in s)
    weight = {w: math.log1p(len(rows) / (1 + n)) for w, n in count.items()}
    cue = re.compile(rf"\b(?:{'|'.join(PHASE_WORDS)})\b")
    numbers = lambda t: set(re.findall(r"\b(\d+)\b", t))
    pairs, best = {}, {}
    for k, block, text, amount in rows:
        for o, other, there, much in rows:
            if k == o or block != other or not text or not there:
                continue
            x, y = sets[k], sets[o]
            similar = 1.0 if text == there else sum(weight[w] for w in x & y) / sum(weight[w] for w in x | y)
            if similar < 0.88:
                continue
            pairs[min(k, o), max(k, o)] = round(similar, 6)
            same = amount is not None and amount == much
            high = same and similar >= 0.96 and (not numbers(text) or not numbers(there) or numbers(text) == numbers(there)) and min(len(x), len(y)) >= 4 and not cue.search(text) and not cue.search(there)
            best[k] = min(best.get(k, (True, 0, True, "~")), (not high, -round(similar, 6), not same, o))
    how = ("work", ["block"], "text", "amount")
    members, links = all_similar(df, *how)
    of: dict = {}
    for r in members.collect():
        of.setdefault(r["class"], []).append(r["id"])
    found = {(min(a, b), max(a, b)): 1.0 for c in of.values() for a in c for b in c if a != b}
    for r in links.collect():
        found |= {(min(a, b), max(a, b)): r["similarity"] for a in of[r["class_a"]] for b in of[r["class_b"]]}
    assert found == pairs and len(pairs) > 200
    got = {r["id"]: (not r["high"], -r["similarity"], not r["same_amount"], r["best"]) for r in best_matches(df, *how).collect()}
    assert got == best
    bounded = {(r["a"], r["b"]) for r in similar_pairs(df, *how).collect()}
    assert bounded < set(pairs)


def test_registered_draws(spark):
    from ledgerloom.plans import analysis

    assert analysis.q_bootstrap(spark, "/root/testdata/sf0.001").first()["rounds"] == 1000
    assert analysis.q_budget_seeds(spark, "/root/testdata/sf0.001").select("seed").distinct().count() == 20


def test_one_pair_alone(spark):
    road = "cement road from temple to school 12"
    rows = [("same", road, 5, road, 5), ("phase", f"{road} phase", 5, road, 5), ("number", road, 5, road.replace("12", "13"), 5), ("no number", road, 5, road.removesuffix(" 12"), 5),
            ("amount", road, 5, road, 6), ("null amount", road, None, road, None), ("generic", "cement road", 5, "cement road", 5), ("empty", "", 5, None, 5)]
    df = spark.createDataFrame(rows, "case string, text_a string, amount_a bigint, text_b string, amount_b bigint")
    got = {r["case"]: r for r in scored_pair(df).collect()}
    assert {k for k, r in got.items() if r["high"]} == {"same"}
    assert got["number"]["number_conflict"] and not got["no number"]["number_conflict"] and got["generic"]["generic"] and got["phase"]["phase"]
    assert got["empty"]["similarity"] == 0.0 and len(got) == len(rows)


def test_queues(spark):
    rows = [("a", 9, "x", True), ("b", 5, "x", False), ("c", 5, "y", True), ("d", 5, "y", False), ("e", 0, "z", False), ("f", 0, "z", True)]
    df = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "key string, score int, grp string, truth boolean, place int")
    got = {r["budget"]: r for r in E.queue_edges(df, "score", [0.3, 0.9]).collect()}
    assert tuple(got[0.3])[1:] == (2, 0, 5, 3, 1, 4) and tuple(got[0.9])[1:] == (6, 2, 0, 2, 2, 4)
    assert E.queue_edges(df.limit(0), "score", [0.1]).count() == 0
    assert {(r["grp"], r["selected"], r["share"]) for r in E.queue_mix(df, "place", 3, "grp").collect()} == {("x", 2, 2 / 3), ("y", 1, 1 / 3)}
    assert {tuple(r) for r in E.queue_coverage(df, "place", 3, ["truth"]).collect()} == {("truth", 2, 3)}
    scores = df.select("key", "score")
    assert E.labelled(scores, df.select("key", "truth").where("key < 'c'"), "key", "truth").where("truth").count() == 1
    with pytest.raises(ValueError):
        E.labelled(df, df, "key", "truth")
    with pytest.raises(ValueError):
        E.labelled(scores.union(scores), df, "key", "truth")
    assert [(r["taken"], r["recovered"]) for r in E.recovery_at(df, "key", "score", "truth", [0.1, 1.0]).orderBy("budget").collect()] == [(1, 1), (6, 3)]


def test_rank_correlations(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, float("nan"), *range(6)]), rng.randrange(8), 1) for _ in range(60)]
    df = spark.createDataFrame([(None if a is None else float(a), float(b), float(c)) for a, b, c in rows], "a double, b double, c double")
    got = {(r["x"], r["y"]): r for r in E.rank_correlations(df, ["a", "b", "c"]).collect()}
    whole = [(a, b) for a, b, _ in rows if a is not None and a == a]
    rank = lambda v, all_: sum(x < v for x in all_) + (sum(x == v for x in all_) + 1) / 2
    ra, rb = ([rank(v, [w[i] for w in whole]) for v in (w[i] for w in whole)] for i in (0, 1))
    assert got["a", "b"]["rows"] == len(whole) and abs(got["a", "b"]["rho"] - np.corrcoef(ra, rb)[0, 1]) < 1e-6
    assert got["a", "c"]["rho"] is None
