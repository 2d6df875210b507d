"""Problem 4: near-duplicate records with small edits (MinHash LSH forest, then exact verification).

Every distinct pair of word set and amount is a unit. A forest has ``trees`` tries; in each of them a unit is a path of
min-hashes, packed into one number, so the numeric order of a tree's paths is the order of its sorted trie. Two units
meet in a tree if their paths agree long enough. Matching starts from the whole path and shortens it until the
probability of meeting in some tree, at the lowest similarity that two sets of their sizes can have and still be a case,
reaches the target recall. The shortest prefix that any sizes need is what rows are brought together by; how much longer
two paths must agree is looked at when they meet. Units that meet and whose amounts may be close are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph import components
from ledgerloom.session import staged

#: Bits of a path's min-hashes, from the root on; five bits before them are the tree's number.
STEPS, TREE_BITS = (16, 16, 16, 11), 5
MAX_DEPTH = len(STEPS)
#: A case shares at least NUM/DEN of all distinct words.
NUM, DEN = 7, 10
#: 1/CLOSE of the larger amount is the most by which amounts may differ.
CLOSE = 50
#: Set sizes that have their own depth; for larger ones the depth of NUM/DEN holds, the shortest of all.
LARGEST = 200
#: Rows of a prefix that one task pairs as they come; fuller ones are divided among tasks.
CELL = 30_000
#: Pairs that a task looks at in one step.
AT_ONCE = 1 << 21


def recall_at(similarity: float, depth: int, trees: int) -> float:
    """The probability that two sets of that similarity meet to that depth in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_similarity(a: int, b: int) -> float | None:
    """The lowest Jaccard similarity of at least NUM/DEN which sets of sizes a and b can have; None if none."""
    for common in range(min(a, b) + 1):
        if common * DEN >= NUM * (a + b - common):
            return common / (a + b - common)
    return None


def shortened(similarity: float, trees: int, target: float) -> int:
    """The longest prefix, from MAX_DEPTH down, that meets the target recall at a similarity; 1 at least."""
    return next((d for d in range(MAX_DEPTH, 1, -1) if recall_at(similarity, d, trees) >= target), 1)


def depths(trees: int, target: float) -> np.ndarray:
    """``[size, size]``: how long the paths of two sets of these sizes must agree; sizes above LARGEST count as that."""
    out = np.full((LARGEST + 1, LARGEST + 1), MAX_DEPTH, dtype=np.int8)
    known: dict[float, int] = {}
    for a in range(1, LARGEST + 1):
        for b in range(1, LARGEST + 1):
            s = NUM / DEN if LARGEST in (a, b) else least_similarity(a, b)
            if s:
                out[a, b] = known.setdefault(s, shortened(s, trees, target))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift); the same on every machine."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(hashes: np.ndarray, starts: np.ndarray, trees: int, depth: int, seed: int) -> np.ndarray:
    """Min-hashes of word sets: ``[unit, tree, position]``. ``starts`` are the places where the sets begin."""
    out = np.empty((len(starts), trees, depth), dtype=np.uint64)
    salts = _mixed(np.arange(1, trees * depth + 1, dtype=np.uint64) + np.uint64(seed << 20))
    for i, salt in enumerate(salts):
        out[:, i // depth, i % depth] = np.minimum.reduceat(_mixed(hashes ^ salt), starts)
    return out


def paths(made: np.ndarray) -> np.ndarray:
    """``[unit, tree]``: the packed paths of signatures ``[unit, tree, step]``."""
    out = np.broadcast_to(np.arange(made.shape[1], dtype=np.uint64)[None, :], made.shape[:2]).copy()
    for step, bits in enumerate(STEPS):
        out = (out << np.uint64(bits)) | (made[:, :, step] & np.uint64((1 << bits) - 1))
    return out


def _cut(depth: int) -> int:
    """Bits of a path below a prefix."""
    return sum(STEPS[depth:])


#: A row of the forest: prefix, rest of the path, and what tells at a meeting whether two units may be a case.
ROW = "prefix bigint, rest bigint, uid bigint, amount bigint, n smallint, m0 bigint, m1 bigint, text int"


def _forest(units: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """A row for each unit and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            hashes = np.asarray(lists.flatten()).view(np.uint64)
            path = paths(signatures(hashes, (offsets[:-1] - offsets[0]).astype(np.int64), trees, MAX_DEPTH, seed)).T
            at = pa.array(np.tile(np.arange(batch.num_rows), trees))
            flat = path.reshape(-1)
            cut = np.uint64(_cut(depth))
            size = pa.array(np.minimum(np.diff(offsets), LARGEST).astype(np.int16))
            ends = [(flat >> cut).view(np.int64), (flat & np.uint64((1 << int(cut)) - 1)).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ends), *[c.take(at) for c in (batch.column(0), batch.column(2), size, *batch.columns[3:])]], ROW.replace(",", "").split()[::2])

    return units.select("uid", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), "amount", "m0", "m1", "text").mapInArrow(run, ROW)


def _agreeing(rest_a: np.ndarray, rest_b: np.ndarray, depth: int) -> np.ndarray:
    """How long two paths agree that have the first ``depth`` steps in common."""
    out = np.full(len(rest_a), depth, dtype=np.int8)
    differ = rest_a ^ rest_b
    for d in range(depth + 1, MAX_DEPTH + 1):
        out += (differ >> _cut(d)) == 0
    return out


def _possible(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, need: np.ndarray, depth: int, first: int) -> np.ndarray:
    """Whether pairs of rows, which share a prefix and have close amounts, agree as long as their sizes ask for and may
    share enough words. Equal texts meet in every tree; the first one is enough. A mask has one bit for each word, so a
    bit that one set has and another lacks stands for a word that the other lacks."""
    n, text = rows["n"].astype(np.int64), rows["text"]
    masks = [rows[m].view(np.uint64) for m in ("m0", "m1")]  # bits are counted without a sign
    a, b = [m[i] for m in masks], [m[j] for m in masks]
    ok = _agreeing(rows["rest"][i], rows["rest"][j], depth) >= need[n[i], n[j]]
    ok &= (rows["prefix"][i] >> first == 0) | (text[i] != text[j]) | (a[0] != b[0]) | (n[i] != n[j])
    lacks = lambda x, y: sum(np.bitwise_count(p & ~q).astype(np.int64) for p, q in zip(x, y, strict=True))
    shared = np.minimum(n[i] - lacks(a, b), n[j] - lacks(b, a))
    large = (n[i] >= LARGEST) | (n[j] >= LARGEST)  # their sizes aren't known
    return ok & (large | (shared * DEN >= NUM * (n[i] + n[j] - shared)))


def _meetings(rows: dict[str, np.ndarray], need: np.ndarray, depth: int) -> np.ndarray:
    """``[pair, 2]`` uids of rows, sorted by prefix and amount, that meet; each pair once, the smaller uid first."""
    prefix, amount, uid = rows["prefix"], rows["amount"], rows["uid"]
    fresh = np.ones(len(prefix), dtype=bool)
    fresh[1:] = prefix[1:] != prefix[:-1]
    cell = np.cumsum(fresh)
    # The last amount that is close to a row's: the larger may exceed the smaller by a part in CLOSE - 1 of it.
    known, place = np.unique(amount, return_inverse=True)
    upto = np.searchsorted(known, [min(int(a) * CLOSE // (CLOSE - 1), (1 << 63) - 1) for a in known], side="right")
    order = cell * (len(known) + 1) + place
    stop = np.searchsorted(order, cell * (len(known) + 1) + upto[place], side="left")
    counts = stop - np.arange(len(prefix)) - 1
    out, begin = [np.zeros((0, 2), dtype=np.int64)], 0
    ends = np.cumsum(counts)
    while begin < len(counts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, side="right")))
        mine = counts[begin:end]
        i = np.repeat(np.arange(begin, end), mine)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(mine) - mine, mine)
        ok = _possible(rows, i, j, need, depth, sum(STEPS[:depth]))
        i, j = uid[i[ok]], uid[j[ok]]
        out.append(np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0))
        begin = end
    return np.concatenate(out)


def _mask(words: Column, half: int) -> Column:
    """64 of 128 bits, one of which stands for each word."""
    bit = lambda w: F.pmod(F.xxhash64(w, F.lit("bit")), F.lit(128)).cast("int")
    mine = F.filter(words, lambda w: F.floor(bit(w) / 64) == half)
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(w) % 64)))


def _units(rows: DataFrame, key: str, text: str, amount: str) -> DataFrame:
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")))
    return (
        rows.select(F.col(key).alias("key"), words.alias("words"), F.col(amount).cast("bigint").alias("amount"))
        .where((F.size("words") > 0) & (F.col("amount") >= 0) & F.col("key").isNotNull())
        .withColumn("spelled", F.array_join("words", " "))
    )


def _paired(grown: DataFrame, need: np.ndarray, depth: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """``(pairs, full)``: ``a, b`` of rows that meet, and the rows of prefixes with more than CELL of them.

    Rows come to a task sorted by prefix and amount. A prefix is paired when its last row has come; rows of a full one
    are passed on as soon as it is known to be full, so a task never holds more than CELL rows of one.
    """
    names = ROW.replace(",", "").split()[::2]
    schema = "a bigint, b bigint, " + ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        full = None  # the prefix whose rows are being passed on

        def passed_on(rows: dict[str, np.ndarray], these: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(int(these.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *[pa.array(rows[c][these]) for c in names]], ["a", "b", *names])

        def paired(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            pairs = _meetings(rows, need, depth)
            empty = [pa.nulls(len(pairs), pa.array(rows[c][:0]).type) for c in names]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *empty], ["a", "b", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
            if full is not None:
                these = rows["prefix"] == full
                if these.any():
                    yield passed_on(rows, these)
                rows = {c: v[~these] for c, v in rows.items()}
                held = None
                if not len(rows["prefix"]):
                    continue
                full = None
            last = rows["prefix"] == rows["prefix"][-1]
            _, inverse, counts = np.unique(rows["prefix"], return_inverse=True, return_counts=True)
            crowded = counts[inverse] > CELL
            if crowded.any():
                yield passed_on(rows, crowded)
            if crowded[-1]:
                full = rows["prefix"][-1]
            done = ~crowded & ~last
            if done.any():
                yield paired({c: v[done] for c, v in rows.items()})
            held = {c: v[last & ~crowded] for c, v in rows.items()} if not crowded[-1] else None
        if held is not None and len(held["prefix"]):
            yield paired(held)

    made = grown.repartition(tasks, "prefix").sortWithinPartitions("prefix", "amount").mapInArrow(run, schema)
    made = staged(made, "met")
    return made.where("a is not null").select("a", "b"), made.where("a is null").drop("a", "b")


def _dealt(full: DataFrame, need: np.ndarray, depth: int, tasks: int) -> DataFrame:
    """``a, b`` of the rows of full prefixes that meet.

    A full prefix is cut by bands of the amount, of which close amounts lie in the same or the next. The rows of a band
    are dealt to parts of CELL / 2 rows, and each part meets each part of its own band and of the band below; all
    pairs are looked at, each by one task.
    """
    step = math.log(CLOSE / (CLOSE - 1)) * (1 + 1e-9)
    rows = full.withColumn("band", F.when(F.col("amount") > 0, F.floor(F.log("amount") / step)).otherwise(F.lit(-9)).cast("int"))
    sizes = rows.groupBy("prefix", "band").agg(F.ceil(F.count(F.lit(1)) / (CELL // 2)).cast("int").alias("parts"))
    above = sizes.select("prefix", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = sizes.select("prefix", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    sizes = sizes.join(above, ["prefix", "band"], "left").join(below, ["prefix", "band"], "left")
    rows = staged(rows.join(sizes, ["prefix", "band"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")), "full")
    # A block is two parts: (lower band, part) and (band, part). With its own band the smaller part is named first.
    name = lambda low, p, high, q: F.struct(low.alias("low"), p.alias("p"), high.alias("high"), q.alias("q"))
    band, part = F.col("band"), F.col("part")
    to = lambda n: F.when(n.isNotNull() & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(to(F.col("parts")), lambda q: name(band, F.least(part, q), band, F.greatest(part, q)))
    up = F.transform(to(F.col("above")), lambda q: name(band, part, band + 1, q))
    down = F.transform(to(F.col("below")), lambda q: name(band - 1, q, band, part))
    columns = ROW.replace(",", "").split()[::2]
    blocks = rows.select(*columns, "band", "part", F.explode(F.concat(own, up, down)).alias("block"))
    blocks = blocks.select(F.xxhash64("prefix", "block").alias("home"), *columns, ((band == F.col("block.low")) & (part == F.col("block.p"))).alias("left"), ((F.col("block.low") == F.col("block.high")) & (F.col("block.p") == F.col("block.q"))).alias("alone"))

    def run(group: pa.Table) -> pa.Table:
        rows = {c: group.column(c).to_numpy() for c in columns}
        left, alone = group.column("left").to_numpy(), group.column("alone").to_numpy()
        out = [np.zeros((0, 2), dtype=np.int64)]
        these, those = np.flatnonzero(left), np.flatnonzero(~left | alone)
        for begin in range(0, len(these), max(1, AT_ONCE // max(1, len(those)))):
            i = np.repeat(these[begin : begin + max(1, AT_ONCE // max(1, len(those)))], len(those))
            j = np.tile(those, len(i) // max(1, len(those)))
            a, b = rows["amount"][i], rows["amount"][j]
            near = (np.abs(a - b) <= np.maximum(a, b) // CLOSE) & (rows["prefix"][i] == rows["prefix"][j]) & (rows["uid"][i] != rows["uid"][j])
            i, j = i[near], j[near]
            ok = _possible(rows, i, j, need, depth, sum(STEPS[:depth]))
            x, y = rows["uid"][i[ok]], rows["uid"][j[ok]]
            out.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return blocks.repartition(tasks, "home").groupBy("home").applyInArrow(run, "a bigint, b bigint")


def linked_units(rows: DataFrame, key: str, text: str, amount: str, trees: int = 17, target: float = 0.999, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``members(key, uid)`` puts each row into its unit, ``links(a, b)`` are unit pairs.

    Exact copies (same words, same amount) are one unit, so a hot text costs one signature, not its square. Rows
    with null or blank text, null amount or negative amount belong to no unit: a negative larger amount can't be
    near anything. Every link is verified; a case is missed with a probability of at most ``1 - target``. At most 32
    trees.
    """
    depth = shortened(NUM / DEN, trees, target)
    if not 1 <= trees <= 1 << TREE_BITS or recall_at(NUM / DEN, depth, trees) < target:
        raise ValueError(f"{trees} trees can't reach a recall of {target}")
    need = depths(trees, target)
    base = _units(rows, key, text, amount)
    units = base.groupBy("spelled", "amount").agg(F.count(F.lit(1)).alias("copies"))
    words = F.split("spelled", " ")
    units = staged(units.select(F.monotonically_increasing_id().alias("uid"), "spelled", "amount"), "units")
    members = base.select("key", "spelled", "amount").join(units.select("uid", "spelled", "amount"), ["spelled", "amount"]).select("key", "uid")

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = units.withColumns({"words": words, "m0": _mask(words, 0), "m1": _mask(words, 1), "text": F.hash("spelled")})
    pairs, full = _paired(_forest(described, trees, depth, seed), need, depth, tasks)
    if not full.isEmpty():
        pairs = pairs.unionByName(_dealt(full, need, depth, tasks))
    found = pairs.distinct()
    one = units.select(F.col("uid").alias("a"), F.split("spelled", " ").alias("words_a"))
    two = units.select(F.col("uid").alias("b"), F.split("spelled", " ").alias("words_b"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    links = found.join(one, "a").join(two, "b").where(both * DEN >= NUM * (F.size("words_a") + F.size("words_b") - both)).select("a", "b")
    return members, links


def near_duplicate_pairs(rows: DataFrame, key: str, text: str, amount: str, **how) -> DataFrame:
    """``(a, b)``: every pair of rows, a before b by code points, whose words and amounts agree closely enough.

    Copies of one text and amount are all pairs of each other, as the result is defined by pairs of rows. A key that
    occurs twice counts once for each other key. Ties and empty tables need nothing special.
    """
    members, links = linked_units(rows, key, text, amount, **how)
    members = staged(members.distinct(), "members")
    one, two = members.select(F.col("key").alias("x"), F.col("uid").alias("a")), members.select(F.col("key").alias("y"), F.col("uid").alias("b"))
    apart = links.join(one, "a").join(two, "b").select("x", "y")
    within = one.join(two, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return apart.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicate_groups(rows: DataFrame, key: str, text: str, amount: str, **how) -> DataFrame:
    """``(key, group_id, copies, links)``: a row for each row with words and an amount.

    ``group_id`` is the component of its unit, ``copies`` the rows of its unit (itself included), ``links`` how many
    other units its unit is linked to. Copies aren't expanded into pairs.
    """
    members, links = linked_units(rows, key, text, amount, **how)
    links, members = staged(links, "links"), staged(members, "members")
    roots = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"))
    about = sizes.join(degree, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    about = about.select("uid", F.coalesce("root", "uid").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(about, "uid").select("key", "group_id", "copies", "links")
