"""Amounts against their peers: exact order statistics from counts of distinct values, earlier years, leave-one-out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.relational import running_total
from ledgerloom.session import staged

#: Makes a median absolute deviation, and a distance of quartiles, an estimate of a normal deviation.
MAD_SCALE, IQR_SCALE = 1.4826, 1.349


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def order_values(counts: DataFrame, keys: Sequence[str], value: str, count: str, picks: Mapping[str, Column]) -> DataFrame:
    """``keys, n`` and, under each name of ``picks``, the group's value at that place (from 0, in ascending order).

    A pick is a column over ``n``, the number of values. ``counts`` has each distinct value of a group once with its
    count. Running counts come from range partitions over all groups, so a group with very many values is spread over
    tasks like any other. Places outside a group give null.
    """
    placed = counts.select(*keys, F.col(value).alias("__v"), F.col(count).alias("__c")).where("__v is not null").withColumn("__order", F.struct(*keys, "__v"))
    summed = running_total(placed, "__order", "__c", "__upto").drop("__order")
    whole = summed.groupBy(*keys).agg(F.sum("__c").alias("n"), F.min(F.col("__upto") - F.col("__c")).alias("__start"))
    names = list(picks)
    at = whole.select(*keys, "n", "__start", *[picks[p].cast("bigint").alias(f"__at_{p}") for p in names])
    both = summed.alias("s").join(at.alias("w"), _same("s", "w", keys)).select(*[F.col(f"w.{k}").alias(k) for k in keys], "n", "__v", "__c", (F.col("__upto") - F.col("__start")).alias("__to"), *[f"__at_{p}" for p in names])
    here = lambda p: (F.col("__to") > F.col(f"__at_{p}")) & (F.col("__to") - F.col("__c") <= F.col(f"__at_{p}"))
    return both.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(here(p), F.col("__v"))).alias(p) for p in names])


def medians(counts: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """``keys, n, median``: the mean of the two middle values of an even number."""
    n = F.col("n")
    found = order_values(counts, keys, value, count, {"__lo": F.floor((n - 1) / 2), "__hi": F.floor(n / 2)})
    return found.select(*keys, "n", ((F.col("__lo") + F.col("__hi")) / 2).alias("median"))


def prior_peers(works: DataFrame, least: int = 20, floor: float = 0.1, years: Sequence[str] | None = None) -> DataFrame:
    """``fy, state, activity, peers, med, scale``: the median and robust scale of log amounts of all earlier years.

    For ``(state, activity)`` and, with a null state, for ``activity``; groups of fewer than ``least`` are left out.
    ``works`` has ``state, activity, sanction_fy, paise``, of which rows without an activity, a year or a positive
    amount count nowhere. ``years`` are those to find peers for (default: the years of the works); a single later one
    makes a reference frozen at what ``works`` holds. Rows are reduced to counts of amounts first, and only these are copied to later years, of
    which there are few.
    """
    rows = works.where("paise > 0 and sanction_fy is not null and activity is not null")
    counts = staged(rows.groupBy("state", "activity", "sanction_fy", "paise").agg(F.count(F.lit(1)).alias("c")), "amounts")
    years = years or sorted(r[0] for r in counts.select("sanction_fy").distinct().collect())
    later = F.filter(F.array(*[F.lit(y) for y in years]).cast("array<string>"), lambda y: y > F.col("sanction_fy"))
    spread = counts.select("state", "activity", "paise", "c", F.explode(later).alias("fy"))
    level = spread.where("state is not null").unionByName(spread.withColumn("state", F.lit(None).cast("string")))
    keys = ["fy", "state", "activity"]
    level = level.groupBy(*keys, "paise").agg(F.sum("c").alias("c")).withColumn("x", F.log1p(F.col("paise") / 100.0))
    level = staged(level, "levels")
    middle = medians(level, keys, "x", "c").where(F.col("n") >= least)
    middle = staged(middle, "middles")
    apart = level.alias("a").join(middle.alias("m"), _same("a", "m", keys)).select(*[F.col(f"m.{k}").alias(k) for k in keys], F.abs(F.col("x") - F.col("median")).alias("d"), "c")
    apart = apart.groupBy(*keys, "d").agg(F.sum("c").alias("c"))
    mad = medians(apart, keys, "d", "c")
    both = middle.alias("m").join(mad.alias("d"), _same("m", "d", keys))
    return both.select(*[F.col(f"m.{k}").alias(k) for k in keys], F.col("m.n").alias("peers"), F.col("m.median").alias("med"), F.greatest(MAD_SCALE * F.col("d.median"), F.lit(floor)).alias("scale"))


def cost_benchmark(works: DataFrame, key: str, least: int = 20, z: float = 3.5, times: float = 2.0, material: int = 10_000_000) -> DataFrame:
    """Every work against the earlier years of its state and activity, or of its activity where these are too few.

    ``key, level, peers, median_inr, log_z, cost_ratio, outlier``; without enough peers or without an amount the
    figures are null and ``outlier`` is false. ``works`` is as for :func:`prior_peers`, with ``key``.
    """
    peers = staged(prior_peers(works, least), "peers")
    facts = F.struct("peers", "med", "scale")
    near = peers.where("state is not null").select(F.col("fy").alias("sanction_fy"), "state", "activity", facts.alias("near"))
    wide = peers.where("state is null").select(F.col("fy").alias("sanction_fy"), "activity", facts.alias("wide"))
    joined = works.join(near, ["sanction_fy", "state", "activity"], "left").join(wide, ["sanction_fy", "activity"], "left")
    level = F.when(F.col("near").isNotNull(), "state and activity").when(F.col("wide").isNotNull(), "activity").otherwise("none")
    joined = joined.select(key, "paise", level.alias("level"), F.coalesce("near", "wide").alias("p")).select(key, "paise", "level", "p.*")
    median = F.expm1("med")
    log_z = (F.log1p(F.col("paise") / 100.0) - F.col("med")) / F.col("scale")
    over = F.when(median > 0, F.col("paise") / 100.0 / median)
    out = joined.select(key, "level", F.coalesce("peers", F.lit(0)).alias("peers"), median.alias("median_inr"), log_z.alias("log_z"), over.alias("cost_ratio"), "paise")
    return out.withColumn("outlier", F.coalesce((F.col("log_z") > z) & (F.col("cost_ratio") >= times) & (F.col("paise") >= material), F.lit(False))).drop("paise")


def _without(low: str, high: str, own: Column) -> Column:
    """A place's value once one ``own`` is taken out: ``low`` stands there and ``high`` one place further."""
    return F.when(F.col(low) < own, F.col(low)).otherwise(F.col(high))


def _between(places: Mapping[str, Column], name: str, own: Column, share: float) -> Column:
    """The interpolated quantile without ``own``, from the picks that :func:`_quantile_picks` asked for."""
    at = share * (F.col("n") - 2)
    low, high = _without(f"{name}0", f"{name}1", own), _without(f"{name}2", f"{name}3", own)
    return low + (at - F.floor(at)) * (high - low)


def _quantile_picks(name: str, share: float) -> dict[str, Column]:
    at = share * (F.col("n") - 2)
    return {f"{name}0": F.floor(at), f"{name}1": F.floor(at) + 1, f"{name}2": F.ceil(at), f"{name}3": F.ceil(at) + 1}


def _others(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value, others, median, scale, method`` for each distinct value of a group: figures of all other rows.

    A row's figures depend on its value alone. Of the medians without one row a group has three at most, so deviations
    are counted for each of these once.
    """
    counts = staged(rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), "counts")
    picks = _quantile_picks("m", 0.5) | _quantile_picks("l", 0.25) | _quantile_picks("h", 0.75)
    middle = order_values(counts, keys, "v", "c", picks)
    own = F.col("v")
    each = counts.alias("c").join(middle.alias("o"), _same("c", "o", keys)).where("n > 1")
    each = each.select(*[F.col(f"c.{k}").alias(k) for k in keys], "v", "c", "n", *[_between(picks, n, own, s).alias(t) for n, s, t in (("m", 0.5, "median"), ("l", 0.25, "lower"), ("h", 0.75, "upper"))])
    each = staged(each, "middles")
    medians_of = each.select(*keys, "median").distinct()
    apart = counts.alias("c").join(medians_of.alias("m"), _same("c", "m", keys)).select(*[F.col(f"m.{k}").alias(k) for k in keys], "median", F.abs(F.col("v") - F.col("median")).alias("d"), "c")
    apart = apart.groupBy(*keys, "median", "d").agg(F.sum("c").alias("c"))
    dev_picks = _quantile_picks("d", 0.5)
    spread = order_values(apart, [*keys, "median"], "d", "c", dev_picks)
    both = each.alias("e").join(spread.alias("s"), _same("e", "s", [*keys, "median"]))
    both = both.select(*[F.col(f"e.{k}").alias(k) for k in keys], "v", F.col("e.n").alias("n"), F.col("e.median").alias("median"), (F.col("upper") - F.col("lower")).alias("iqr"), F.abs(F.col("v") - F.col("e.median")).alias("dev"), *dev_picks)
    mad = _between(dev_picks, "d", F.col("dev"), 0.5)
    both = both.withColumn("mad", mad)
    scale = F.when(F.col("mad") > 0, MAD_SCALE * F.col("mad")).when(F.col("iqr") > 0, F.col("iqr") / IQR_SCALE).otherwise(F.greatest(0.1 * F.col("median"), F.lit(1.0)))
    method = F.when(F.col("mad") > 0, "deviations").when(F.col("iqr") > 0, "quartiles").otherwise("tenth of the median")
    return both.select(*keys, "v", (F.col("n") - 1).alias("others"), "median", scale.alias("scale"), method.alias("method"))


def peer_scores(works: DataFrame, key: str, levels: Sequence[Sequence[str]], value: str, least: int = 10) -> DataFrame:
    """``key, level, others, median, scale, method, z, ratio`` of each row with a positive value, against all others.

    A row is compared with the first of ``levels`` (lists of grouping columns, nulls are a group of their own) in which
    ``least`` others have a positive value; the last level takes whatever is there. The scale is that of the median
    absolute deviation, of the quartiles if that is zero, else a tenth of the median (1 at least). A row that is
    alone everywhere has nulls. Exact: no sampling, and no group is gathered in a task.
    """
    named = sorted({c for level in levels for c in level})
    rows = staged(works.select(F.col(key).alias("__key"), *named, F.col(value).cast("double").alias("v")).where("v > 0"), "rows")
    out = rows
    for i, level in enumerate(levels):
        facts = _others(rows.withColumn("__all", F.lit(0)), list(level) or ["__all"], "v")
        on = [*level] or ["__all"]
        facts = facts.select(*[F.col(c).alias(f"__{i}_{c}") for c in (*on, "v")], F.struct(F.lit(i).alias("level"), "others", "median", "scale", "method").alias(f"f{i}"))
        left = out if level else out.withColumn("__all", F.lit(0))
        out = left.join(facts, reduce(Column.__and__, [left[c].eqNullSafe(facts[f"__{i}_{c}"]) for c in (*on, "v")]), "left").drop(*[f"__{i}_{c}" for c in (*on, "v")], "__all")
    last = len(levels) - 1
    chosen = F.coalesce(*[F.when(F.col(f"f{i}.others") >= least, F.col(f"f{i}")) for i in range(last)], F.col(f"f{last}"))
    out = out.select("__key", "v", chosen.alias("f")).select(F.col("__key").alias(key), "v", "f.*")
    return out.withColumn("z", (F.col("v") - F.col("median")) / F.col("scale")).withColumn("ratio", F.when(F.col("median") > 0, F.col("v") / F.col("median"))).drop("v")
