import itertools
import random

import pytest

from ledgerloom.llm import names
from ledgerloom.llm.names import STRONG, canonical, code, compared, jaro_winkler, link_names, nickname_of, parsed, person_pairs, token_match


def test_jaro_winkler_known_values():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler("", "") == 0.0 and jaro_winkler("a", "a") == 1.0


def test_parsing():
    assert parsed("SHRI. Kumar, Rā0 urf Tippu B. (MP)") == (("rao",), ("b",), ("kumar",), ("tippu",))
    assert canonical("Smt.  Abc  DEF") == canonical("def, abc") and canonical(" . ") == ""


@pytest.mark.parametrize(
    "a,b",
    [("Dhakrutosh Dhatherit", "DHATHERIT DHKARUTOSH"), ("Bhichojan Ghidhemi Bhiyilva", "BHICHOJANGHIDHEMI BHIYILVA"), ("Vedhajan Drideova", "Dride ova Vedhajan"), ("Ghochemi Lal Pavaroth", "Ghochemi Pavaroth"), ("Dronevik Bethendal", "dronevik alias rinko bethendal")],
)
def test_strong(a, b):
    assert compared(a, b)[0] == STRONG and compared(b, a)[0] == STRONG


@pytest.mark.parametrize("a,b", [("Lebhaleen Khutrikar", "Lebhoresh Khutrikar"), ("Tresevik Bayashek", "Hughodar Zoyithi Bayashek"), ("A. Khutrikar", "Lebhoresh Khutrikar"), ("", "Abc Def")])
def test_apart(a, b):
    assert compared(a, b)[0] == 0 and compared(b, a)[0] == 0


def test_weak_and_nicknames():
    assert 0 < compared("L. Khutrikar", "Lebhoresh Khutrikar")[0] < STRONG
    assert nickname_of("preji", "preteresh") and nickname_of("leen", "rahaleen") and not nickname_of("zoji", "preteresh")
    assert token_match("gohivand", "gohivaaand") == 1 and code("bhikkha") == code("bika")


def test_names_passed_over_are_those_that_compare_to_nothing():
    rng = random.Random(5)
    parts = ["bha", "dri", "kum", "esh", "tro", "nav", "zo", "lee", "pu", "rit", "gho", "ji", "sha", "mul"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(2, 4)))
    words = [word() for _ in range(40)]

    def typed():
        n = rng.choices(words, k=rng.randint(1, 3)) + rng.choices(["", "kumar", "devi", "k.", "d", "b.", "kukka", "urf tippu", "shri"], k=2)
        rng.shuffle(n)
        text = " ".join(n)
        at = rng.randrange(1, len(text))
        return rng.choice([text, text, text[:at] + text[at + 1 :], text[:at] + " " + text[at:], text.replace(" ", "", 1), text[:at] + "h" + text[at:]])

    pairs = [(typed(), typed()) for _ in range(6000)]
    pairs += [(a, " ".join([a.split()[0], rng.choice(words)])) for a, _ in pairs[:3000] if a.split()]
    passed = [p for p in pairs if names._hopeless(*p)]
    assert all(names._compared(*p)[0] == 0 for p in passed)
    nothing = sum(names._compared(*p)[0] == 0 for p in pairs)
    assert len(pairs) > nothing > len(passed) > 0.6 * nothing
    plain = lambda a, b: sum(abs(a.count(c) - b.count(c)) for c in set(a + b))
    assert all(names._spread(a, b) == plain(a, b) for a, b in [*pairs, *itertools.product(words, words), ("", "aa"), ("a" * 40, "a" * 35), ("a-", "-b")])


SCHEMA = "id bigint, name string, place string, seat string, node int, detail string"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    return {(r["a"], r["b"]) for r in person_pairs(link_names(df, "id", "name", ["place", "seat"])).collect()}


def test_linking(spark):
    rows = [
        (1, "Shri Vedhajan Drideova", "north", "x"), (1, "VEDHAJAN DRIDEOVA", "North ", None), (2, "Drideova, Vedhajn", "north", None), (3, "V. Drideova", "north", "x"),
        (4, "Vedhajan Drideova", "south", "y"), (5, "Lebhaleen Khutrikar", "north", None), (6, "Lebhoresh Khutrikar", "north", None), (7, "L. Khutrikar", "north", None),
        (8, "Pochurit Zisulva", None, None), (9, "Pochurit Zisulva", "west", "z"), (10, None, "west", "z"), (None, "Pochurit Zisulva", "west", "z"), (11, " ", "west", "z"),
    ]
    assert linked(spark, rows) == {(1, 2), (1, 3), (2, 3), (8, 9)}


def test_empty_and_hot(spark):
    assert linked(spark, []) == set()
    rows = [(i, f"Shri Nadejan Nukhananti{'.' * (i % 3)}", "north", "x") for i in range(60)] + [(100, "Zodhukar Mehta", "north", "x")]
    assert len(linked(spark, rows)) == 60 * 59 // 2


def test_full_blocks_compare_all_pairs(spark, monkeypatch):
    from ledgerloom.llm import names

    given = ["Litrumbra", "Tobhakir", "Sanomet", "Pelavuti", "Zidokam", "Chorimel", "Wumbhati"]
    rows = [(i, f"{g} Ghusevik", "north", f"s{i}") for i, g in enumerate(given)]
    rows += [(20, "Kukka Ghusevik", "north", "s0"), (21, "Rahaleen Ghusevik", "south", "s21"), (22, "Leen Ghusevik", None, "s21"), (23, "Pobhakir Ghusevic", "north", "s1")]
    monkeypatch.setattr(names, "HOT", 1)
    assert linked(spark, rows) == {(0, 20), (21, 22), (1, 23)}
    monkeypatch.setattr(names, "HOT", 3)
    assert linked(spark, rows) == {(0, 20), (21, 22), (1, 23)}


def test_initials_without_a_place(spark):
    rows = [(1, "Vedhajan Drideova", "north", "x"), (2, "V. D.", None, None), (3, "T. S.", "south", "y"), (4, "Tolimar Sanomet", None, "y"), (5, "Pochurit Kumar Zisulva", "west", "z"), (6, "Z. P.", "west", None)]
    assert linked(spark, rows) == {(1, 2), (3, 4), (5, 6)}
