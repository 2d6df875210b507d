import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, packing, splitting, tokens

PATH = tokens.vocabulary_path()
RNG = random.Random(3)
HINDI = "शेष राशि नोडल खाते में जमा की गई। क्या पंचायत ने भूमि का प्रमाण पत्र दिया है? "
ENGLISH = 'The work at "Rampur" is done. Payment is due!\nSee the note.\r\n\r\nNext part: 1) drains, 2) roads. '


def text_of(n):
    return "".join(RNG.choice([HINDI, ENGLISH, "x" * 40, "😀", "\n\n", " "]) for _ in range(n))


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, source, 5, 1) for i, t in enumerate(rows)], "doc_id bigint, text string, source string, tokens int, limit_id int")


@pytest.mark.parametrize("most,overlap", [(512, 64), (32, 8), (16, 0), (9, 5)])
def test_pieces_cover_overlap_and_stay_below_the_limit(most, overlap):
    for n in (1, 5, 40, 200):
        t = text_of(n)
        at = tokens.places(t, PATH)
        made = splitting.pieces(t, most, overlap, PATH, at)
        total = tokens.token_count(t, PATH)
        assert made[0][0] == 0 and made[-1][1] == len(t)
        if total <= most:
            assert len(made) == 1
            continue
        for i, (a, b, size, shared, kind) in enumerate(made):
            assert a < b and size <= most and (i == 0 or (overlap if most > 20 else 1 if overlap else 0) <= shared <= overlap + splitting.SLACK)
            if most > 20:
                assert tokens.token_count(t[a:b], PATH) <= most
            if i:
                before = made[i - 1]
                assert a <= before[1] and (overlap == 0) == (a == before[1])
        assert sum(size - shared for _, _, size, shared, _ in made) == total


def test_cuts_prefer_strong_boundaries():
    t = "one two three four five six.\n\nseven eight nine ten eleven twelve"
    made = splitting.pieces(t, 12, 0, PATH)
    assert tokens.KINDS[made[0][4]] == "paragraph" and t[: made[0][1]].strip().endswith("six.")
    kinds = {tokens.KINDS[k] for k in tokens.places("a b. c\nd\n\ne", PATH).kind}
    assert kinds == {"none", "word", "sentence", "line", "paragraph"}
    assert "sentence" in {tokens.KINDS[k] for k in tokens.places("जमा की गई। क्या", PATH).kind}


def test_split_texts(spark):
    long = text_of(400)
    rows = [None, "", "short", long, long, "z" * 5000, " " * 3000]
    got = splitting.split_texts(docs(spark, rows), "doc_id", "text", [(1, 256, 32), (2, 64, 8)]).collect()
    assert {r["doc_id"] for r in got} <= {3, 4, 5, 6} and {3, 4, 5} <= {r["doc_id"] for r in got}
    for r in got:
        assert r["text"] == rows[r["doc_id"]][r["char_start"] : r["char_end"]] and 0 <= r["piece_no"] < r["pieces"]
        assert r["tokens"] <= (256 if r["limit_id"] == 1 else 64)
    with pytest.raises(ValueError):
        splitting.pieces(long, 32, 30, PATH)
    assert splitting.split_texts(docs(spark, []), "doc_id", "text", [(1, 256, 32)]).count() == 0


def test_long_texts_are_tokenized_in_parts_alike(monkeypatch):
    t = ENGLISH * 300
    whole = tokens.token_ids(t, PATH)
    monkeypatch.setattr(tokens, "PART", 1000)
    assert (tokens.token_ids(t, PATH) == whole).all()


def test_special_strings_are_ordinary_text():
    assert tokens.token_count("<|endoftext|>", PATH) > 1


def test_pack_respects_all_limits():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 3000)
    loss = (size * rng.random(3000)).astype(int)
    limit = packing.Limit(1, 100, 7, 60)
    loss = np.minimum(loss, 60)
    where, slot = packing.pack(size, loss, limit)
    assert (where >= 0).all() and len({*zip(where.tolist(), slot.tolist(), strict=True)}) == 3000
    for of, most in ((size, 100), (loss, 60), (np.ones(3000, int), 7)):
        assert np.bincount(where, of).max() <= most
    roomy = packing.pack(size, np.zeros(3000, int), packing.Limit.of(1, 100))[0]
    assert size.sum() / (100 * (roomy.max() + 1)) > 0.98
    with pytest.raises(ValueError):
        packing.pack(np.array([101]), np.array([0]), limit)
    assert len(packing.pack(np.array([], int), np.array([], int), limit)[0]) == 0


def test_containers(spark):
    rows = [None, "", *[text_of(RNG.randrange(1, 12)) for _ in range(200)], text_of(300), "same", "same"]
    limits = [packing.Limit.of(1, 512), packing.Limit(2, 128, 4, 100)]
    items = packing.text_items(docs(spark, rows), "doc_id", "text", limits)
    got = packing.packed(items, "doc_id", limits, shard_tokens=20_000)
    by: dict = {}
    cover: dict = {}
    for r in got.collect():
        by.setdefault((r["limit_id"], r["container_id"]), []).append(r)
        cover.setdefault((r["limit_id"], r["doc_id"]), []).append((r["char_start"], r["char_end"], r["tokens"]))
    for (limit, _), inside in by.items():
        x = limits[limit - 1]
        assert sum(r["tokens"] for r in inside) <= x.max_tokens and sum(r["loss_tokens"] for r in inside) <= x.max_loss and len(inside) <= x.max_segments
        assert sorted(r["slot"] for r in inside) == list(range(len(inside)))
    for (limit, doc), parts in cover.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == len(rows[doc]) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        whole = tokens.token_count(rows[doc], PATH)
        assert sum(p[2] for p in parts) == whole and (len(parts) == 1 or whole > limits[limit - 1].max_tokens or limit == 2)
    assert len(cover) == 2 * sum(bool(t) for t in rows)
    shown = packing.with_text(got, docs(spark, rows).select("doc_id", "text"), "doc_id", "text").collect()
    assert all(r["text"] == rows[r["doc_id"]][r["char_start"] : r["char_end"]] for r in shown)
    report = {r["limit_id"]: r for r in packing.fill_report(got, limits).collect()}
    assert report[1]["used_share"] > 0.9 and report[1]["most_tokens"] <= 512
    assert packing.packed(packing.text_items(docs(spark, []), "doc_id", "text", limits), "doc_id", limits).count() == 0


def test_split_counts_are_exact():
    counts = np.array([100, 7, 0, 33])
    leaves = mixing.split_counts(counts, 9, 1)
    assert leaves.shape == (9, 4) and (leaves.sum(0) == counts).all() and np.ptp(leaves.sum(1)) <= 8 and (leaves >= 0).all()
    for first in range(9):
        for last in range(first + 1, 10):
            assert (mixing.split_counts(counts, 9, 1, first, last) == leaves[first:last]).all()
        assert (mixing.before_leaf(counts, 9, 1, first) == leaves[:first].sum(0)).all()


def test_part_of_finds_close_sums():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(1, 500) for _ in range(rng.randrange(1, 90))]
        room = rng.randrange(0, sum(sizes))
        taken = mixing.part_of(sizes, room)
        total = sum(sizes[i] for i in taken)
        assert len(set(taken)) == len(taken) and total <= 2 * room
        if len(sizes) > 40 and room > 5000:
            assert abs(room - total) <= 3
    assert mixing.part_of([900, 800], 700) == [1] and mixing.part_of([900, 800], 300) == [] and mixing.part_of([3, 5], 6) == [1]


def mixed_tables(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        name = rng.choice(["big", " BIG", "mid-size", "Mid Size", "small", "none", None])
        if name == "small" and rng.random() < 0.7:
            name = "big"
        rows.append((i, rng.choice([None, "", "repeated text"]) if rng.random() < 0.05 else f"text number {i} " + "word " * rng.randrange(1, 60), name, 9))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid_size", 0.3, 2), ("small", 0.15, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int"), targets, rows


@pytest.mark.parametrize("total", [None, 50_000])
def test_mixture(spark, total):
    documents, targets, rows = mixed_tables(spark)
    got, shares = mixing.mixture(documents, targets, total_tokens=total)
    got, shares = got.collect(), {r["source"]: r for r in shares.collect()}
    text = {i: t for i, t, *_ in rows}
    used: dict = {}
    for r in got:
        used.setdefault((r["source"], text[r["doc_id"]]), []).append(r["copy_no"])
        assert r["tokens"] == tokens.token_count(text[r["doc_id"]], PATH)
    most = {"big": 1, "mid_size": 2, "small": 3}
    assert all(len(c) <= most[s] and len(set(c)) == len(c) for (s, _), c in used.items())
    assert {s for s, _ in used} == set(most) and shares["absent"]["mixed_tokens"] == 0
    assert sorted(r["position"] for r in got if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in got)))
    if total is None:
        assert all(abs(r["reached_share"] - r["goal_share"]) < 0.01 for r in shares.values())
    else:
        assert shares["small"]["mixed_tokens"] == 3 * shares["small"]["source_tokens"]


def test_a_tiny_source_does_not_bound_the_mixture(spark, monkeypatch):
    from ledgerloom.llm import queries

    documents, targets, rows = mixed_tables(spark)
    small = [i for i, t, s, _ in rows if s == "small" and t]
    tiny = documents.where(~F.col("doc_id").isin(small[1:]))
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 1024)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 512)
    monkeypatch.setattr(mixing, "LEAVES", 3)
    monkeypatch.setattr(queries, "table", lambda s, d, name: {"documents": tiny, "source_targets": targets}[name])
    got = queries.p7_mixture(spark, "").groupBy("shard").count().count()
    shares = {r["source"]: r for r in queries.p7_shares(spark, "").collect()}
    everything = sum(r["source_tokens"] for r in shares.values())
    exact = sum(r["mixed_tokens"] for r in queries.p7_exact_shares(spark, "").collect())
    assert shares["small"]["mixed_tokens"] == 3 * shares["small"]["source_tokens"] and shares["small"]["reached_share"] < shares["small"]["goal_share"]
    assert sum(r["mixed_tokens"] for r in shares.values()) > 0.7 * everything > 10 * exact and got > 1


def test_mixture_of_nothing(spark):
    documents, targets, _ = mixed_tables(spark)
    assert mixing.mixture(documents.limit(0), targets)[0].count() == 0
    rows, shares = mixing.mixture(documents, targets.limit(0))
    assert rows.count() == 0 and shares.count() == 0


def test_tight_limits_bind_on_whole_documents(spark):
    from ledgerloom.llm import queries

    found = queries.p6_tight(spark, "/root/testdata/sf0.001").groupBy("limit_id", "container_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l")).collect()
    most = {limit: tokens for limit, tokens, _ in queries._limits(spark, "/root/testdata/sf0.001", "container")}
    for limit, size in most.items():
        mine = [r for r in found if r["limit_id"] == limit]
        assert all(r["t"] <= size and r["n"] <= size // 512 and r["l"] <= size * 7 // 8 for r in mine)
        assert sum(r["n"] == size // 512 for r in mine) > 2 and sum(r["l"] > size * 7 // 8 - 8 for r in mine) > 2


def test_places_of_tiny_texts():
    for text in ("", " ", "\n", "\n\n", "é ", " é", "a", " a", "a.\n\n", "।  क"):
        at = tokens.places(text, PATH)
        assert at.byte[-1] == len(text.encode()) and at.char[-1] == len(text) and len(at.kind) == len(at.byte) == len(at.whole)
    at = tokens.places("One two. Three\nfour\n\nfive", PATH)
    kinds = {int(c): int(k) for c, k in zip(at.char, at.kind, strict=True)}
    assert [kinds[i] for i in (3, 8, 14, 19)] == [tokens.WORD, tokens.SENTENCE, tokens.LINE, tokens.PARAGRAPH] and kinds[0] == tokens.NONE
