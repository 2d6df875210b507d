"""Evaluation of rankings: budgets, confusion, tie seeds, temporal splits, bootstrap and forecasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import next_month, tie_break
from ledgerloom.operators.relational import joined_one_to_one, ranked, running_total
from ledgerloom.session import staged


def confusion(df: DataFrame, said: Column, truth: Column) -> DataFrame:
    """One row ``tp, fp, fn, tn``; null counts as false."""
    s, t = F.coalesce(said, F.lit(False)), F.coalesce(truth, F.lit(False))
    return df.agg(F.count_if(s & t).alias("tp"), F.count_if(s & ~t).alias("fp"), F.count_if(~s & t).alias("fn"), F.count_if(~s & ~t).alias("tn"))


def cut_date(df: DataFrame, day: str, share: float):
    """The date at a share of all rows in order of date: counts of days are summed up, rows aren't sorted."""
    per_day = df.where(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    total = per_day.agg(F.sum("n")).first()[0]
    if not total:
        return None
    wanted = max(1, int(total * share))
    upto = per_day.withColumn("u", F.sum("n").over(Window.orderBy(day)))  # as many rows as there are days
    return upto.where(F.col("u") >= wanted).agg(F.min(day)).first()[0]


def budget_table(scored: DataFrame, key: str, score: str, truth: str, shares: list[float], seeds: list[str]) -> DataFrame:
    """For each tie seed and budget: how many rows are taken, hold a positive score and are true.

    Ties are settled by a hash of the seed and the key. All seeds are ranked at once over range partitions, so no task
    sorts all rows. Rows with a score of zero fill a budget but are no finding.
    """
    total = scored.count()
    spread = scored.select(key, score, truth, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    tied = F.when(F.col("seed").isNull(), None)
    for s in seeds:
        tied = tied.when(F.col("seed") == s, tie_break(s, F.col(key)))
    numbered = ranked(spread.withColumn("tie", tied), [F.col("seed"), F.col(score).desc(), F.col("tie"), F.col(key)], "row")
    before = F.lit(0)
    for i, s in enumerate(sorted(seeds)):
        before = F.when(F.col("seed") == s, F.lit(i * total)).otherwise(before)
    numbered = numbered.withColumn("place", F.col("row") - before)
    budgets = F.array(*[F.struct(F.lit(q).alias("budget"), F.lit(int(np.ceil(round(q * total, 9)))).alias("size")) for q in shares])
    taken = numbered.select(score, truth, "seed", "place", F.inline(budgets)).where(F.col("place") <= F.col("size"))
    found = (F.col(score) > 0) & F.col(truth)
    return taken.groupBy("seed", "budget").agg(F.count(F.lit(1)).alias("taken"), F.count_if(F.col(score) > 0).alias("positive"), F.count_if(found).alias("recovered"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift); the same on every machine."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired_bootstrap(contexts: DataFrame, context: str, a: str, b: str, rounds: int = 1000, seed: int = 17) -> DataFrame:
    """``mean, low, high`` of b - a over contexts, resampled whole (percentiles 2.5 and 97.5).

    A context's weight in a round is a Poisson draw from a hash, so rounds are sums over all contexts at once, and no
    context table goes to the driver. No contexts give nulls.
    """
    each = contexts.groupBy(context).agg(F.sum(a).cast("double").alias("a"), F.sum(b).cast("double").alias("b"), F.count(F.lit(1)).alias("n"))

    # A weight is drawn by inverting the Poisson distribution at a hash of context and round.
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])
    salts = _mixed(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed << 32))

    def run(parts):
        sums = np.zeros((rounds, 3))
        for p in parts:
            values = p[["a", "b", "n"]].to_numpy(dtype=float)
            hashes = p["h"].to_numpy(dtype=np.int64).view(np.uint64)
            for i in range(0, len(hashes), 1024):
                uniform = (_mixed(hashes[i : i + 1024, None] ^ salts[None, :]) >> np.uint64(11)) * 2.0**-53
                sums += np.searchsorted(steps, uniform, side="right").T @ values[i : i + 1024]
        yield pd.DataFrame({"r": np.arange(rounds), "a": sums[:, 0], "b": sums[:, 1], "n": sums[:, 2]})

    drawn = each.select(F.xxhash64(context).alias("h"), "a", "b", "n").mapInPandas(run, "r int, a double, b double, n double")
    totals = drawn.groupBy("r").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n")).where("n > 0")
    rate = totals.select(((F.col("b") - F.col("a")) / F.col("n")).alias("d"))
    return rate.agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.percentile("d", 0.025), 6).alias("low"), F.round(F.percentile("d", 0.975), 6).alias("high"), F.count(F.lit(1)).alias("rounds"))


def forecast_folds(months: DataFrame, month: str, amount: str, before: str, keep: int = 36, first: int = 6, test: int = 3) -> DataFrame:
    """Rolling one-step folds of the last ``keep`` months before a month: actual value, last value and mean of three.

    Only earlier months are used for a forecast. Empty unless there are 15 months, without a gap, up to the month before.
    Months are few, so their windows may lie in one task.
    """
    by_month = Window.partitionBy(F.lit(0)).orderBy("month")
    known = months.where(F.col(month) < before).select(F.col(month).alias("month"), F.col(amount).alias("actual"))
    latest = known.withColumn("back", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("month").desc()))).where(F.col("back") <= keep)
    checked = latest.withColumn("i", F.row_number().over(by_month) - 1).withColumn("after", F.coalesce(F.lead("month").over(by_month), F.lit(before)))
    whole = Window.partitionBy(F.lit(0))
    sound = (F.count(F.lit(1)).over(whole) >= 15) & (F.count_if(F.col("after") != next_month(F.col("month"))).over(whole) == 0)
    folds = checked.withColumn("sound", sound).withColumn("last", F.lag("actual").over(by_month)).withColumn("mean3", F.avg("actual").over(by_month.rowsBetween(-3, -1)))
    return folds.where("sound").where(F.col("i") >= first).select("month", "actual", "last", F.round("mean3", 3).alias("mean3"), F.when(F.col("back") <= test, "test").otherwise("validation").alias("split"))


def chosen_forecast(folds: DataFrame) -> DataFrame:
    """``method, validation_mae, test_mae, chosen``: the method with the smaller validation error, the first of equals."""
    long = folds.select("split", "actual", F.inline(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(m).alias("method"), F.col(m).cast("double").alias("said")) for i, m in enumerate(("last", "mean3"))])))
    error = F.abs(F.col("said") - F.col("actual"))
    mae = long.groupBy("rank", "method").agg(F.round(F.avg(F.when(F.col("split") == "validation", error)), 3).alias("validation_mae"), F.round(F.avg(F.when(F.col("split") == "test", error)), 3).alias("test_mae"))
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("validation_mae", "rank")) == 1
    return mae.withColumn("chosen", best).drop("rank")


def queue_edges(scored: DataFrame, score: str, shares: list[float]) -> DataFrame:
    """For each budget what lies at its edge: ``budget, taken, fillers, edge_score, edge_rows, edge_taken, positive``.

    ``fillers`` are rows without a score that only fill the budget, ``edge_rows`` all rows with the last score taken and
    ``edge_taken`` those of them that are taken, so ties decide ``edge_rows - edge_taken``. Counts of scores are summed
    up, rows aren't ranked. An empty table gives no rows.
    """
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    summed = staged(running_total(counts, "s", "c", "upto", descending=True), "edges")
    total = summed.agg(F.sum("c")).first()[0]
    if not total:
        return summed.limit(0).selectExpr("0d as budget", "0L as taken", "0L as fillers", "s as edge_score", "c as edge_rows", "c as edge_taken", "c as positive")
    sizes = F.array(*[F.struct(F.lit(q).alias("budget"), F.lit(int(np.ceil(round(q * total, 9)))).cast("bigint").alias("taken")) for q in shares])
    positive = int(summed.where("s > 0").agg(F.sum("c")).first()[0] or 0)
    edge = summed.select("s", "c", "upto", F.inline(sizes)).where((F.col("upto") >= F.col("taken")) & (F.col("upto") - F.col("c") < F.col("taken")))
    edge_taken = F.col("taken") - (F.col("upto") - F.col("c"))
    return edge.select("budget", "taken", F.greatest(F.col("taken") - positive, F.lit(0)).cast("bigint").alias("fillers"), F.col("s").alias("edge_score"), F.col("c").alias("edge_rows"), edge_taken.alias("edge_taken"), F.lit(positive).cast("bigint").alias("positive"))


def queue_mix(ordered: DataFrame, place: str, size: int, by: str) -> DataFrame:
    """``by, selected, share``: of which groups the first ``size`` rows of an order are."""
    chosen = ordered.where(F.col(place) <= size).groupBy(by).agg(F.count(F.lit(1)).alias("selected"))
    return chosen.withColumn("share", F.col("selected") / F.lit(float(max(1, size))))


def queue_coverage(ordered: DataFrame, place: str, size: int, screens: list[str]) -> DataFrame:
    """``screen, selected, population``: how many of each screen's rows the first ``size`` of an order hold."""
    cells = F.array(*[F.struct(F.lit(c).alias("screen"), F.col(c).alias("hit")) for c in screens])
    return ordered.select(place, F.inline(cells)).where("hit").groupBy("screen").agg(F.count_if(F.col(place) <= size).alias("selected"), F.count(F.lit(1)).alias("population"))


def labelled(scores: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Scores with their labels, joined only now, so no score can have seen one. Scores that bring a column of the
    label's name are an error, as are repeated keys on either side; keys without a label are negative."""
    if label in scores.columns:
        raise ValueError(f"{label} was known before scoring")
    return joined_one_to_one(scores, labels.select(key, label), [key]).withColumn(label, F.coalesce(label, F.lit(False)))


def recovery_at(scored: DataFrame, key: str, score: str, truth: str, shares: list[float], seed: str = "0") -> DataFrame:
    """``budget, taken, recovered, recovery`` of a score's order with hashed ties; zero scores count like any other."""
    placed = ranked(scored.select(key, score, truth, tie_break(seed, F.col(key)).alias("tie")), [F.col(score).desc_nulls_last(), F.col("tie"), F.col(key)], "place")
    placed = staged(placed, "places")
    facts = placed.agg(F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("true")).first()
    budgets = F.array(*[F.struct(F.lit(q).alias("budget"), F.lit(int(np.ceil(round(q * facts["n"], 9)))).alias("size")) for q in shares])
    hits = placed.select(truth, "place", F.inline(budgets)).where(F.col("place") <= F.col("size")).groupBy("budget").agg(F.count(F.lit(1)).alias("taken"), F.count_if(truth).alias("recovered"))
    return hits.withColumn("recovery", F.round(F.col("recovered") / F.lit(float(max(1, facts["true"]))), 6))


def rank_correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``x, y, rows, rho``: Spearman correlations of all pairs of columns, average ranks taken anew on the rows complete
    for a pair. Null and NaN are missing; a constant side gives a null.

    All pairs are handled at once: equal pairs of values are counted, ranks come from running counts over range
    partitions, and the correlation is a sum over counts of ranks centred at their known mean.
    """
    real = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), real[a].alias("a"), real[b].alias("b")) for i, (a, b) in enumerate(pairs)])
    each = rows.select(F.inline(cells)).where("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    each = staged(each, "pairs")
    sides = each.groupBy("pair", F.lit(0).alias("side"), F.col("a").alias("v")).agg(F.sum("c").alias("c")).unionByName(each.groupBy("pair", F.lit(1).alias("side"), F.col("b").alias("v")).agg(F.sum("c").alias("c")))
    summed = staged(running_total(sides.withColumn("at", F.struct("pair", "side", "v")), "at", "c", "upto"), "ranks")
    whole = summed.groupBy("pair", "side").agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("start"))
    centred = F.col("upto") - F.col("start") - (F.col("c") - 1) / 2 - (F.col("n") + 1) / 2
    ranks = summed.join(F.broadcast(whole), ["pair", "side"]).select("pair", "side", "v", centred.alias("r"))  # two rows for each pair
    one, two = (ranks.where(F.col("side") == i).select("pair", F.col("v").alias(c), F.col("r").alias(f"r{c}")) for i, c in enumerate("ab"))
    both = each.join(one, ["pair", "a"]).join(two, ["pair", "b"])
    sums = both.groupBy("pair").agg(F.sum("c").alias("rows"), *[F.sum(F.col("c") * F.col(f"r{p}") * F.col(f"r{q}")).alias(p + q) for p, q in ("aa", "bb", "ab")])
    named = F.element_at(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs]), F.col("pair") + 1)
    return sums.select(named["x"].alias("x"), named["y"].alias("y"), "rows", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 6)).alias("rho"))
