"""Problem 7: mixing sources to target weights (multivariate-hypergeometric splitting tree).

Each source's texts are dealt into blocks of bounded size. From the shares follows how many tokens a source gives, and
from that how many whole passes over its blocks and how much of a further pass are drawn. The drawn blocks are
counted by source; a binary tree splits these counts exactly among the output shards, each split being a draw without
replacement (multivariate hypergeometric), so shards are like parts of one perfect shuffle. A shard then takes the
next blocks of each source in a random order of its blocks, and its rows are shuffled within the shard.

The driver holds totals of sources only. A node of the tree draws from its own seed, so every task can walk to the
shards it makes by itself; blocks, draws and quotas of shards are tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerloom.llm.tokens import vocabulary_path, with_token_counts
from ledgerloom.operators.relational import ranked, running_total
from ledgerloom.session import staged

#: Tokens in a block and in an output shard.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 16, 1 << 22
#: Shards whose quotas one task draws.
LEAVES = 4096
#: Most sources that may have a target; they are handled on the driver.
MOST_SOURCES = 10_000


def source_key(c: Column) -> Column:
    """A source's name: trimmed, in lower case, hyphens and spaces as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[-\s]", "_")


def split_counts(counts: np.ndarray, shards: int, seed: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """``[shard, source]`` counts of shards ``first`` to ``last`` (exclusive; default: all), which over all shards sum
    exactly to ``counts``: leaves of the splitting tree.

    A node's blocks are divided in proportion to the shards below either side; which sources they come from is drawn
    without replacement, from a seed of the node's own. So a part of the leaves can be had without the others.
    """
    last = shards if last is None else last
    out = np.zeros((last - first, len(counts)), dtype=np.int64)
    stack = [(0, shards, np.asarray(counts, dtype=np.int64))]
    while stack:
        low, high, here = stack.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            out[low - first] = here
            continue
        middle = low + (high - low) // 2
        total = int(here.sum())
        rng = np.random.default_rng([seed, low, high])
        drawn = rng.multivariate_hypergeometric(here, total * (middle - low) // (high - low), method="marginals") if total else here
        stack += [(low, middle, drawn), (middle, high, here - drawn)]
    return out


def before_leaf(counts: np.ndarray, shards: int, seed: int, leaf: int) -> np.ndarray:
    """What all shards before one have in sum: the left sides that the way to it passes by."""
    out = np.zeros(len(counts), dtype=np.int64)
    low, high, here = 0, shards, np.asarray(counts, dtype=np.int64)
    while high - low > 1:
        middle = low + (high - low) // 2
        total = int(here.sum())
        rng = np.random.default_rng([seed, low, high])
        drawn = rng.multivariate_hypergeometric(here, total * (middle - low) // (high - low), method="marginals") if total else here
        if leaf < middle:
            high, here = middle, drawn
        else:
            low, here = middle, here - drawn
            out += drawn
    return out


@dataclass(frozen=True)
class Source:
    """What a source has and may give."""

    name: str
    target: float
    max_repeats: int
    tokens: int
    texts: int

    @property
    def usable(self) -> bool:
        return self.tokens > 0 and self.target > 0 and self.max_repeats > 0


def mixture_size(sources: list[Source]) -> int:
    """The largest number of tokens at which every source that has texts reaches its share within its repeats."""
    have = [s for s in sources if s.usable]
    whole = sum(s.target for s in have)
    return min((int(s.tokens * s.max_repeats * whole / s.target) for s in have), default=0)


def all_tokens(sources: list[Source]) -> int:
    """The tokens of all sources that may give some, each text once."""
    return sum(s.tokens for s in sources if s.usable)


def quotas(sources: list[Source], total: int) -> dict[str, int]:
    """Tokens each source gives: its part of ``total`` among the sources with texts, at most all its repeats."""
    have = [s for s in sources if s.usable]
    whole = sum(s.target for s in have)
    return {s.name: min(s.tokens * s.max_repeats, round(total * s.target / whole)) for s in have}


#: Items at the end of a partly drawn block among which the best sum is found exactly.
EXCHANGE = 48


def part_of(sizes: list[int], room: int) -> list[int]:
    """Places of items whose sum comes close to ``room``, from below or, if that is nearer, from above: in the given
    order what fits, and then the last EXCHANGE of these and as many others are chosen anew for the best sum (reachable
    sums as bits of an integer)."""
    taken, left, rest = [], room, []
    for i, size in enumerate(sizes):
        if size <= left:
            taken.append(i)
            left -= size
        else:
            rest.append(i)
    pool, taken = taken[-EXCHANGE:] + rest[:EXCHANGE], taken[:-EXCHANGE]
    room -= sum(sizes[i] for i in taken)
    within = (1 << (2 * room + 1)) - 1  # beyond twice the room nothing is nearer than nothing
    sums = [1]
    for i in pool:
        sums.append((sums[-1] | sums[-1] << sizes[i]) & within)
    below = (sums[-1] & ((1 << (room + 1)) - 1)).bit_length() - 1
    above = sums[-1] >> room
    over = room + ((above & -above).bit_length() - 1) if above else below
    best = over if over - room < room - below else below
    for k in range(len(pool), 0, -1):
        if not sums[k - 1] >> best & 1:
            taken.append(pool[k - 1])
            best -= sizes[pool[k - 1]]
    return sorted(taken)


def distinct_texts(documents: DataFrame, names: list[str], key: str, text: str, source: str, path: str) -> DataFrame:
    """``key, source, tokens`` of every distinct text of the named sources.

    A text that stands in several rows counts once, for the row with the smallest key, so no text is used more often
    than its source allows. Null and empty texts are left out.
    """
    rows = documents.select(F.col(key).cast("bigint").alias("key"), source_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("source").isin(names) & (F.length("text") > 0))
    rows = rows.withColumn("mark", F.unhex(F.md5("text")))
    counted = with_token_counts(rows, "text", ["key", "source", "mark"], path)
    first = counted.groupBy("mark").agg(F.min_by(F.struct("key", "source", "tokens"), F.col("key")).alias("one"))
    return first.select("one.*").where("tokens > 0")


def _totals(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """``source, total`` of the sources that may give tokens: MOST_SOURCES rows at most."""
    return F.broadcast(spark.createDataFrame([(s.name, s.tokens) for s in sources if s.usable], "source string, total bigint"))


def _shards(spark: SparkSession, counts: list[int], firsts: list[int], names: list[str], shards: int, seed: int) -> DataFrame:
    """``source, row, shard``: which shard each drawn block goes to. Blocks are numbered over all sources, a source's
    from its first on; a task draws the quotas of LEAVES shards and what the shards before them have in sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(counts, dtype=np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                low, high = part * LEAVES, min(shards, (part + 1) * LEAVES)
                mine = split_counts(total, shards, seed, low, high)
                before = before_leaf(total, shards, seed, low)
                begin = np.array(firsts, dtype=np.int64) + before + np.cumsum(mine, axis=0) - mine
                for j, name in enumerate(names):
                    yield pa.RecordBatch.from_pydict({"source": pa.array([name] * len(mine), pa.string()), "shard": np.arange(low, high), "begin": begin[:, j], "n": mine[:, j]})

    tasks = max(1, -(-shards // LEAVES))
    leaves = spark.range(0, tasks, 1, tasks).mapInArrow(run, "source string, shard bigint, begin bigint, n bigint").where("n > 0")
    return leaves.select("source", "shard", F.explode(F.sequence(F.col("begin").cast("int"), (F.col("begin") + F.col("n") - 1).cast("int"))).alias("row"))


def mixture(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: int | str | None = None,
    path: str | None = None,
    seed: int = 23,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, shares)`` of a mixture.

    ``rows``: ``shard, position, doc_id, copy_no, source, tokens``, one for each use of a text, in mixed order.
    ``shares``: for each source with a target what it has, its ``goal_share`` (its target among sources with texts),
    its tokens in the mixture and the ``reached_share``.

    ``total_tokens`` is the size wanted, ``"all"`` as many tokens as all sources with targets have. Sources too small
    for it give all their repeats and fall short, which the report shows. Without it the mixture is the largest in
    which every source with texts reaches its share, so the smallest source bounds it.
    Texts are whole, so a source may miss its quota by a few tokens, or more if it has few and long texts. Sources
    without a target are left out; targets without texts get nothing. Null names and shares count as no target.
    """
    spark, path = documents.sparkSession, path or vocabulary_path()
    wanted = targets.groupBy(source_key(F.col("source")).alias("name")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most")).limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with a target")
    wanted = {r["name"]: (r["share"] or 0.0, r["most"] or 0) for r in wanted if r["name"] is not None}
    texts = staged(distinct_texts(documents, list(wanted), key, text, source, path), "texts")
    have = {r["source"]: (int(r["t"]), int(r["n"])) for r in texts.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    sources = [Source(n, s, m, *have.get(n, (0, 0))) for n, (s, m) in sorted(wanted.items())]
    total = mixture_size(sources) if total_tokens is None else all_tokens(sources) if total_tokens == "all" else total_tokens
    quota = quotas(sources, total)

    # Blocks of each source, and what they hold.
    number, given = F.lit(1), F.lit(0)
    for x in sources:
        if x.usable:
            number = F.when(F.col("source") == x.name, F.lit(max(1, -(-x.tokens // BLOCK_TOKENS)))).otherwise(number)
            given = F.when(F.col("source") == x.name, F.lit(quota[x.name])).otherwise(given)
    dealt = texts.where(F.col("source").isin(sorted(quota))).withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), number).cast("int"))
    dealt = staged(dealt, "dealt")
    held = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("size"))

    # Draws: whole passes over the blocks, then blocks of a further pass up to the quota; the last one is drawn in part.
    passes = held.withColumn("quota", given.cast("bigint")).join(_totals(spark, sources), "source")
    copies = F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("total")).cast("int"))
    drawn = passes.where("quota > 0").select("source", "block", "size", "quota", "total", F.explode(copies).alias("copy_no"))
    drawn = drawn.withColumn("turn", F.struct("source", "copy_no", F.xxhash64("source", "copy_no", "block", F.lit(seed + 3)).alias("mix"), "block"))
    summed = staged(running_total(drawn, "turn", "size", "upto"), "draws")
    starts = summed.groupBy("source", "copy_no").agg(F.min(F.col("upto") - F.col("size")).alias("start"))
    here = summed.join(starts, ["source", "copy_no"]).withColumn("before", F.col("copy_no") * F.col("total") + F.col("upto") - F.col("size") - F.col("start"))
    left = F.col("quota") - F.col("before")
    here = here.where(left > 0).select("source", "block", "copy_no", "turn", F.when(F.col("size") > left, left).alias("part"))
    order = staged(ranked(here, [F.col("turn")], "row").drop("turn"), "order")
    counts = {r["source"]: (r["n"], r["first"]) for r in order.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).collect()}
    names = sorted(counts)
    shards = max(1, -(-sum(quota.values()) // SHARD_TOKENS))
    plan = _shards(spark, [counts[n][0] for n in names], [counts[n][1] for n in names], names, shards, seed)
    steps = order.join(plan, ["source", "row"]).drop("row")
    drawn = dealt.join(steps, ["source", "block"])
    whole = drawn.where("part is null").drop("part", "block")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["mix", "key"], ignore_index=True)
        taken = part_of(group["tokens"].tolist(), int(group["part"].iloc[0]))
        return group.loc[taken, ["key", "source", "tokens", "copy_no", "shard"]]

    mix = F.xxhash64("key", "copy_no", F.lit(seed + 1))
    partly = drawn.where("part is not null").withColumn("mix", mix).groupBy("source", "block", "copy_no").applyInPandas(fill, "key bigint, source string, tokens int, copy_no int, shard bigint")
    rows = whole.select("key", "source", "tokens", "copy_no", "shard").unionByName(partly)
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("key", "copy_no", F.lit(seed + 2)), "key", "copy_no")) - 1
    rows = rows.select(F.col("shard").cast("int").alias("shard"), place.alias("position"), F.col("key").alias("doc_id"), "copy_no", "source", "tokens")

    goal = sum(s.target for s in sources if s.usable)
    about = spark.createDataFrame(
        [(s.name, float(s.target), int(s.max_repeats), s.texts, s.tokens, (s.target / goal if s.usable else 0.0)) for s in sources],
        "source string, target_share double, max_repeats int, texts bigint, source_tokens bigint, goal_share double",
    )
    used = rows.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.max("copy_no").alias("last_copy"))
    mixed = F.sum(F.coalesce("mixed_tokens", F.lit(0))).over(Window.partitionBy())
    shares = about.join(F.broadcast(used), "source", "left")
    shares = shares.withColumn("reached_share", F.round(F.coalesce(F.col("mixed_tokens") / F.nullif(mixed, F.lit(0)), F.lit(0.0)), 6))
    return rows, shares.select("source", "target_share", F.round("goal_share", 6).alias("goal_share"), "max_repeats", "texts", "source_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), (F.coalesce("last_copy", F.lit(-1)) + 1).alias("copies"), "reached_share")
