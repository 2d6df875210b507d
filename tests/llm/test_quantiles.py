import math
import random

import numpy as np
import pytest

from ledgerloom.llm.quantiles import Sketch, capacity, daily_sketches, from_days, merge_sketches, read_quantiles, relative_error, sketch_values

SHARES = [0.1, 0.5, 0.9, 0.99]


@pytest.mark.parametrize("high", [False, True])
def test_error_stays_within_the_bound_whatever_the_merges(high):
    rng = np.random.default_rng(1)
    n = 200_000
    values = rng.permutation(n).astype(float)
    whole = Sketch(high)
    for part in np.array_split(values, 23):
        piece = Sketch(high)
        for batch in np.array_split(part, 7):
            piece.add(batch)
        whole.merge(piece.n, piece.levels, piece.done)
    assert whole.n == n == sum(len(v) << h for h, v in enumerate(whole.levels))
    assert sum(map(len, whole.levels)) < 12_000
    for q, x in zip([0.001, 0.01, *SHARES, 0.999], whole.quantiles([0.001, 0.01, *SHARES, 0.999]), strict=True):
        assert abs((x + 1) / n - q) <= relative_error() * ((1 - q) if high else q) + 1 / n


def test_errors_of_many_partitions_do_not_add_up():
    """Coins of partitions fall apart, so the mean error of many merged ones is near zero."""
    errors = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        n = 100_000
        whole = Sketch(False)
        for part in np.array_split(rng.permutation(n).astype(float), 200):
            piece = Sketch(False).add(part)
            whole.merge(piece.n, piece.levels, piece.done)
        errors.append((whole.quantiles([0.1])[0] + 1) / n - 0.1)
    assert abs(np.mean(errors)) < 0.0015 and max(map(abs, errors)) < relative_error() * 0.1 + 1e-5 and len({e > 0 for e in errors}) == 2


def test_small_sketches_are_exact_and_empty_ones_say_nothing():
    assert Sketch(True).quantiles([0.5]) == [None]
    s = Sketch(False).add(np.array([3.0, 1.0, 2.0, 2.0]))
    assert s.quantiles([0.0, 0.25, 0.5, 1.0]) == [1.0, 1.0, 2.0, 3.0]
    assert len(Sketch(True).add(np.arange(capacity()[0] - 1.0)).levels) == 1


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "g string, day timestamp_ntz, v double, n int, high int")


def test_groups_days_and_odd_values(spark):
    from datetime import datetime

    rng = random.Random(2)
    days = [datetime(2024, 1, d, 5) for d in range(1, 20)] + [None]
    data = [(rng.choice(["a", "a", "a", None]), rng.choice(days), rng.choice([None, float("nan"), rng.lognormvariate(0, 2), 7.0]), 1, 1) for _ in range(6000)]
    data += [("empty", days[0], None, 1, 1), ("b", days[0], float("inf"), 1, 1)]
    df = rows_of(spark, data)
    direct = read_quantiles(merge_sketches(sketch_values(df, ["g"], "v"), ["g"]), ["g"], SHARES).collect()
    daily = from_days(daily_sketches(df, ["v"], ["g"], "day"), ["g"], SHARES).collect()
    for got in (direct, daily):
        assert {r["g"] for r in got} == {"a", "b", None} and len(got) == 12
        for r in got:
            values = sorted(v for g, _, v, *_ in data if g == r["g"] and v is not None and not math.isnan(v))
            assert r["n"] == len(values)
            low, high = sum(v < r["estimate"] for v in values) / len(values), sum(v <= r["estimate"] for v in values) / len(values)
            assert low - r["rank_error"] - 1 / len(values) <= r["share"] <= high + r["rank_error"] + 1 / len(values)


def test_empty_table(spark):
    assert read_quantiles(merge_sketches(sketch_values(rows_of(spark, []), ["g"], "v"), ["g"]), ["g"], SHARES).count() == 0
