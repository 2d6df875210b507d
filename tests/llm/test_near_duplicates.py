import random

import numpy as np
import pytest

from ledgerloom.llm import near_duplicates
from ledgerloom.llm.near_duplicates import LARGEST, MAX_DEPTH, STEPS, depths, least_similarity, linked_units, near_duplicate_groups, near_duplicate_pairs, paths, recall_at, shortened

SCHEMA = "id string, text string, amount bigint, uid int, words string"


def made(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)


def brute(rows):
    sets = [(i, set(t.split()), a) for i, t, a in rows if t and t.split() and a is not None and a >= 0]
    return {
        (x, y) if x < y else (y, x)
        for n, (x, s, a) in enumerate(sets)
        for y, t, b in sets[:n]
        if x != y and 10 * len(s & t) >= 7 * len(s | t) and 50 * abs(a - b) <= max(a, b)
    }


def pairs(spark, rows):
    got = [(r["a"], r["b"]) for r in near_duplicate_pairs(made(spark, rows), "id", "text", "amount").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        base = rng.sample(words, rng.randrange(3, 25))
        amount = rng.choice([0, 1, 49, 50, 100, 5000, 10**9, 10**15])
        for j in range(4):
            text = [w for w in base if rng.random() > 0.1] + rng.sample(words, rng.randrange(3))
            rows.append((f"k{i}-{j}", " ".join(rng.sample(text, len(text))), round(amount * rng.choice([1, 1, 0.99, 0.98, 1.02, 0.97]))))
    assert pairs(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [("a", None, 1), ("b", "", 1), ("c", "   ", 1), ("d", "one two", None), ("e", "one two", -5), ("f", "one two", -5), ("g", "one  two one", 0), ("h", "two one", 0), ("i", long, 7), ("j", long + " more", 7), ("é", "one two", 0)]
    assert pairs(spark, rows) == {("g", "h"), ("g", "é"), ("h", "é"), ("i", "j")}
    assert pairs(spark, []) == set()


def test_full_cells_are_divided_without_loss(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(14)]
    rows = [(f"k{i:03}", " ".join([*common, *[f"r{rng.randrange(8)}" for _ in range(4)]]), 1000 + i % 7) for i in range(150)]
    whole = pairs(spark, rows)
    monkeypatch.setattr(near_duplicates, "CELL", 20)
    assert pairs(spark, rows) == whole == brute(rows)


def test_hot_text(spark):
    rows = [(f"k{i:04}", "the same words again and again here", 1000 + 10_000 * i) for i in range(400)] + [("z1", "quite another text of words", 5), ("z2", "quite another text of words", 5)]
    assert pairs(spark, rows) == brute(rows)


def test_groups(spark):
    rows = [("a", "a b c d e f g h i j", 100), ("b", "a b c d e f g h i", 101), ("c", "a b c d e f g h", 102), ("d", "a b c d e f g h", 102), ("e", "z y", 1)]
    got = {r["key"]: (r["group_id"], r["copies"], r["links"]) for r in near_duplicate_groups(made(spark, rows), "id", "text", "amount").collect()}
    assert got["a"][0] == got["b"][0] == got["c"][0] == got["d"][0] != got["e"][0]
    assert [got[k][1:] for k in "abcde"] == [(1, 2), (1, 2), (2, 2), (2, 2), (1, 0)]


def test_prefix_is_shortened_until_the_target():
    assert least_similarity(4, 4) == 1.0 and least_similarity(10, 7) == 0.7 and least_similarity(10, 6) is None
    need = depths(17, 0.999)
    shortest = shortened(0.7, 17, 0.999)
    for a in range(1, LARGEST + 1):
        for b in range(1, LARGEST + 1):
            if (s := least_similarity(a, b)) is not None:
                assert need[a, b] >= shortest and recall_at(s, int(need[a, b]), 17) >= 0.999, (a, b)
                assert need[a, b] == MAX_DEPTH or LARGEST in (a, b) or recall_at(s, int(need[a, b]) + 1, 17) < 0.999
    assert set(need[LARGEST]) >= {shortest}


def test_paths_are_sorted_tries():
    rng = np.random.default_rng(2)
    made = rng.integers(0, 3, size=(50, 4, MAX_DEPTH)).astype(np.uint64)
    packed = paths(made)
    for t in range(4):
        want = sorted(range(50), key=lambda u: (tuple(made[u, t]), u))
        assert [tuple(made[u, t]) for u in np.argsort(packed[:, t], kind="stable")] == [tuple(made[u, t]) for u in want]
    assert (packed >> np.uint64(sum(STEPS)) == np.arange(4, dtype=np.uint64)).all()


def test_too_few_trees(spark):
    with pytest.raises(ValueError):
        linked_units(made(spark, []), "id", "text", "amount", trees=2)


def test_bands_of_full_prefixes(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"k{i:03}", "one two three four five six seven eight " + rng.choice(["nine", "ten", "nine ten"]), rng.choice([0, 0, 1, 40, 41, 42, 5000, 5001, 5099, 5100, 5203, 5204])) for i in range(120)]
    monkeypatch.setattr(near_duplicates, "CELL", 6)
    assert pairs(spark, rows) == brute(rows)
