"""Similar descriptions within an authority and activity: rare words as anchors, bounded recency, weighted overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import PHASE_WORDS, numbers_of, words_of
from ledgerloom.operators.relational import ranked
from ledgerloom.session import staged

#: An anchor looks back at so many earlier works that share it; of all these the latest CANDIDATES are compared.
LOOK_BACK, CANDIDATES, ANCHORS, KEPT = 150, 60, 3, 3
LEAST, HIGH = 0.88, 0.96


def word_counts(works: DataFrame, text: str) -> DataFrame:
    """``word, works`` over all rows, stop words left out."""
    return works.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("works"))


def _phased(text: str) -> Column:
    return F.col(text).rlike(rf"\b(?:{'|'.join(PHASE_WORDS)})\b")


def sound_pair() -> Column:
    """Whether nothing speaks against a pair ``text_a, words_a, text_b, words_b``: numbers conflict only if both texts
    have some and they differ, a side with fewer than four words is too general, and neither may name a further phase."""
    a, b = numbers_of(F.col("text_a")), numbers_of(F.col("text_b"))
    conflict = (F.size(a) > 0) & (F.size(b) > 0) & (a != b)
    return ~conflict & (F.least(F.size("words_a"), F.size("words_b")) >= 4) & ~_phased("text_a") & ~_phased("text_b")


def scored_pair(pairs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Pairs ``text_a, amount_a, text_b, amount_b`` with ``similarity``, ``same_amount``, ``number_conflict``, ``generic``,
    ``phase`` and ``high``, each scored alone. ``weights``: ``word, w`` of a corpus (else all words weigh the same).

    Null texts count as empty, an unknown amount equals none; two empty texts have a similarity of 0.
    """
    rows = pairs.withColumn("__row", F.monotonically_increasing_id()).withColumns({f"text_{s}": F.coalesce(f"text_{s}", F.lit("")) for s in "ab"})
    rows = rows.withColumns({f"words_{s}": F.array_sort(words_of(F.col(f"text_{s}"))) for s in "ab"})
    rows = staged(rows, "alone")
    words = rows.select("__row", "words_a", "words_b", F.explode(F.array_union("words_a", "words_b")).alias("word"))
    words = words.join(weights, "word", "left") if weights is not None else words.withColumn("w", F.lit(1.0))
    w = F.coalesce("w", F.lit(0.0))
    sums = words.groupBy("__row").agg(F.sum(w).alias("whole"), F.sum(F.when(F.array_contains("words_a", F.col("word")) & F.array_contains("words_b", F.col("word")), w)).alias("shared"))
    same_text = (F.col("text_a") == F.col("text_b")) & (F.col("text_a") != "")
    out = rows.join(sums, "__row", "left").withColumn("similarity", F.when(same_text, 1.0).when(F.col("whole") > 0, F.coalesce("shared", F.lit(0.0)) / F.col("whole")).otherwise(0.0))
    a, b = numbers_of(F.col("text_a")), numbers_of(F.col("text_b"))
    out = out.withColumns({
        "same_amount": F.coalesce(F.col("amount_a") == F.col("amount_b"), F.lit(False)),
        "number_conflict": (F.size(a) > 0) & (F.size(b) > 0) & (a != b),
        "generic": F.least(F.size("words_a"), F.size("words_b")) < 4,
        "phase": _phased("text_a") | _phased("text_b"),
    })
    high = (F.col("similarity") >= HIGH) & F.col("same_amount") & sound_pair()
    return out.withColumn("high", high).drop("__row", "words_a", "words_b", "whole", "shared")


def similar_pairs(works: DataFrame, key: str, block: list[str], text: str, amount: str) -> DataFrame:
    """``a, b, similarity, same_amount, high``: for each row ``b`` its best earlier rows ``a`` of the same block.

    Rows are in the order of their key. A word's weight falls with the number of rows that have it. Candidates share
    one of the three rarest words of either row, or the whole text and amount; similarity is shared weight over all
    weight, at least LEAST. ``high`` asks for HIGH, the same known amount, no numbers on both sides that differ, four
    words or more on either and no word for a further phase in either. The bounds on looking back are part of the result's definition; they also
    keep a crowded block linear: each row meets at most LOOK_BACK others for each anchor.
    """
    base = works.select(F.col(key).alias("id"), F.concat_ws("|", *block).alias("block"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(amount).alias("amount"))
    base = staged(base.withColumn("words", F.array_sort(words_of(F.col("text")))), "words")
    each = base.select("id", "block", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = base.count()
    weighted = each.join(counts, "word").withColumn("w", F.log1p(F.lit(float(total)) / (1 + F.col("df"))))
    weights = weighted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("weights"))
    rare = F.row_number().over(Window.partitionBy("id").orderBy("df", "word"))
    anchors = weighted.withColumn("r", rare).where(F.col("r") <= ANCHORS).select("id", "block", "word")

    # Numbers over all anchors: within a block and word they follow each other, and only differences matter. So a
    # crowded block is spread over range partitions like any other rows.
    posted = staged(ranked(anchors, [F.col("block"), F.col("word"), F.col("id")], "p"), "posted")
    # Positions in buckets of LOOK_BACK: a row meets its own bucket and the one before, an equi join.
    bucket = F.floor(F.col("p") / LOOK_BACK)
    late = posted.select("block", "word", F.col("id").alias("b"), F.col("p").alias("pb"), F.explode(F.array(bucket, bucket - 1)).alias("k"))
    early = posted.select("block", "word", F.col("id").alias("a"), F.col("p").alias("pa"), bucket.alias("k"))
    near = late.join(early, ["block", "word", "k"]).where((F.col("pb") - F.col("pa")).between(1, LOOK_BACK)).select("a", "b").distinct()
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.col("a").desc()))).where(F.col("r") <= CANDIDATES).select("a", "b")

    known = base.where("text <> '' and amount is not null").select("id", "block", "text", "amount")
    exact = staged(ranked(known, [F.col(c) for c in ("block", "text", "amount", "id")], "p"), "exact")
    others = [
        exact.select("block", "text", "amount", F.col("id").alias("a"), (F.col("p") + step).alias("p")).join(exact.select("block", "text", "amount", F.col("id").alias("b"), "p"), ["block", "text", "amount", "p"]).select("a", "b") for step in (1, 2, 3)
    ]
    pairs = near
    for other in others:
        pairs = pairs.union(other)
    pairs = pairs.distinct()

    facts = base.join(weights, "id")
    side = lambda c: facts.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("text", "amount", "words", "weights")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    total_of = lambda words, maps: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(*[F.element_at(m, w) for m in maps]))
    maps = (F.col("weights_a"), F.col("weights_b"))
    shared = total_of(F.array_sort(F.array_intersect("words_a", "words_b")), maps)
    whole = total_of(F.array_sort(F.array_union("words_a", "words_b")), maps)
    similarity = F.when((F.col("text_a") == F.col("text_b")) & (F.col("text_a") != ""), 1.0).otherwise(F.when(whole > 0, shared / whole).otherwise(0.0))
    same_amount = F.coalesce(F.col("amount_a") == F.col("amount_b"), F.lit(False))
    scored = both.withColumn("similarity", similarity).where(F.col("similarity") >= LEAST).withColumn("same_amount", same_amount)
    scored = scored.withColumn("high", (F.col("similarity") >= HIGH) & same_amount & sound_pair())
    order = Window.partitionBy("b").orderBy(F.col("high").desc(), F.col("similarity").desc(), F.col("same_amount").desc(), F.col("a"))
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= KEPT).select("a", "b", F.round("similarity", 6).alias("similarity"), "same_amount", "high")


def _facts(works: DataFrame, key: str, block: list[str], text: str, amount: str) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: rows with words or another text are members of the class of their block and text.

    ``members``: ``id, amount, class``, the class being its smallest id. ``classes``: ``class, block, text, words,
    weights, whole`` and ``prefix``, the words of which one at least is shared with any class similar by LEAST: in the
    order of their frequency those whose weight with all after them is LEAST of the whole or more.
    """
    base = works.select(F.col(key).alias("id"), F.concat_ws("|", *block).alias("block"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(amount).alias("amount"))
    base = staged(base, "texts")
    total, counts = base.count(), word_counts(base, "text").withColumnRenamed("works", "df")
    classes = base.where("text <> ''").groupBy("block", "text").agg(F.min("id").alias("class"))
    classes = staged(classes.withColumn("words", F.array_sort(words_of(F.col("text")))), "classes")
    each = classes.select("class", F.explode("words").alias("word")).join(counts, "word")
    each = each.select("class", F.struct("df", "word", F.log1p(F.lit(float(total)) / (1 + F.col("df"))).alias("w")).alias("x"))
    rare = each.groupBy("class").agg(F.array_sort(F.collect_list("x")).alias("rare"))
    sums = rare.withColumn("whole", F.aggregate("rare", F.lit(0.0), lambda s, x: s + x["w"]))
    # Running sums before each word; a word is of the prefix while the rest from it on suffices.
    seen = F.aggregate(
        "rare",
        F.struct(F.lit(0.0).alias("s"), F.array().cast("array<string>").alias("p")),
        lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(F.col("whole") - a["s"] >= LEAST * F.col("whole") - 1e-6, F.concat(a["p"], F.array(x["word"]))).otherwise(a["p"]).alias("p")),
    )
    sums = sums.select("class", "whole", seen["p"].alias("prefix"), F.map_from_entries(F.transform("rare", lambda x: F.struct(x["word"], x["w"]))).alias("weights"))
    members = base.join(classes.select("block", "text", "class"), ["block", "text"]).select("id", "amount", "class")
    return staged(members, "members"), staged(classes.join(sums, "class", "left"), "weighted")


def _links(classes: DataFrame) -> DataFrame:
    """``class_a, class_b, similarity, sound`` of every two classes of one block similar by LEAST, a before b."""
    post = classes.select("class", "block", "whole", F.explode("prefix").alias("word"))
    side = lambda c: post.select("block", "word", F.col("class").alias(f"class_{c}"), F.col("whole").alias(f"whole_{c}"))
    near = F.least("whole_a", "whole_b") >= LEAST * F.greatest("whole_a", "whole_b") - 1e-6
    found = side("a").join(side("b"), ["block", "word"]).where((F.col("class_a") < F.col("class_b")) & near).select("class_a", "class_b").distinct()
    facts = lambda c: classes.select(F.col("class").alias(f"class_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in ("text", "words", "weights")])
    both = found.join(facts("a"), "class_a").join(facts("b"), "class_b")
    weight = lambda words: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at("weights_a", w), F.element_at("weights_b", w)))
    shared, whole = weight(F.array_sort(F.array_intersect("words_a", "words_b"))), weight(F.array_sort(F.array_union("words_a", "words_b")))
    both = both.withColumn("similarity", shared / whole).where(F.col("similarity") >= LEAST)
    return both.select("class_a", "class_b", "similarity", sound_pair().alias("sound"))


def all_similar(works: DataFrame, key: str, block: list[str], text: str, amount: str) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: all similar pairs of a block, without bounds on looking back or on how many are kept.

    Rows of one block and text are a class (``id, class``), named by its smallest id; any two of its members are a pair
    of similarity 1. ``links`` has ``class_a, class_b, similarity`` for all classes similar by LEAST; each member of the
    one and each of the other are a pair. So copies aren't expanded. Weights are those of :func:`similar_pairs`.
    """
    members, classes = _facts(works, key, block, text, amount)
    return members.select("id", "class"), _links(classes).select("class_a", "class_b", F.round("similarity", 6).alias("similarity"))


def best_matches(works: DataFrame, key: str, block: list[str], text: str, amount: str) -> DataFrame:
    """``id, best, similarity, same_amount, high``: for each row the best of all other rows of its block, if any is
    similar by LEAST: ``high`` ones first (as in :func:`similar_pairs`), then by similarity, same amount, smallest id.

    Of a class only its smallest ids are looked at, for each amount and for all, so copies cost no square.
    """
    members, classes = _facts(works, key, block, text, amount)
    links = staged(_links(classes), "links")
    amounts = staged(_two_smallest(members.where("amount is not null"), ["class", "amount"]), "amounts")
    whole = staged(_two_smallest(members, ["class"]), "whole")
    self = classes.select("class", ((F.size("words") >= 4) & ~_phased("text")).alias("sound"))
    # Rows of the same class: the smallest other id of the same amount, and of all.
    other = F.when(F.col("one") != F.col("id"), F.col("one")).otherwise(F.col("two"))
    own = [
        members.join(group, on).join(self, "class").select("id", other.alias("best"), F.lit(1.0).alias("similarity"), F.lit(same).alias("same_amount"), (F.lit(same) & F.col("sound")).alias("high")).where("best is not null")
        for group, on, same in ((amounts, ["class", "amount"], True), (whole, ["class"], False))
    ]
    # Of other classes: the same for all rows of a class and amount.
    ends = links.select(F.col("class_a").alias("class"), F.col("class_b").alias("to"), "similarity", "sound")
    ends = ends.unionByName(links.select(F.col("class_b").alias("class"), F.col("class_a").alias("to"), "similarity", "sound"))
    units = members.select("class", "amount").distinct().join(ends, "class").join(whole.select(F.col("class").alias("to"), F.col("one").alias("any")), "to")
    units = units.join(amounts.select(F.col("class").alias("to"), "amount", F.col("one").alias("alike")), ["to", "amount"], "left")
    same = F.col("alike").isNotNull()
    units = units.select("class", "amount", F.coalesce("alike", "any").alias("best"), "similarity", same.alias("same_amount"), (same & F.col("sound") & (F.col("similarity") >= HIGH)).alias("high"))
    rank = F.struct(~F.col("high"), -F.col("similarity"), ~F.col("same_amount"), F.col("best"))
    first = lambda df, by: df.groupBy(*by).agg(F.min_by(F.struct("best", "similarity", "same_amount", "high"), rank).alias("m")).select(*by, "m.*")
    units = first(units, ["class", "amount"]).withColumnRenamed("class", "of").withColumnRenamed("amount", "at")
    foreign = members.join(units, (F.col("class") == F.col("of")) & F.col("amount").eqNullSafe(F.col("at"))).select("id", "best", "similarity", "same_amount", "high")
    return first(own[0].unionByName(own[1]).unionByName(foreign), ["id"]).withColumn("similarity", F.round("similarity", 6))


def _two_smallest(rows: DataFrame, by: list[str]) -> DataFrame:
    """The smallest id ``one`` and the next ``two`` (null if there is none) of each group, by grouped minima only."""
    one = rows.groupBy(*by).agg(F.min("id").alias("one"))
    two = rows.join(one, by).where("id <> one").groupBy(*by).agg(F.min("id").alias("two"))
    return one.join(two, by, "left")
