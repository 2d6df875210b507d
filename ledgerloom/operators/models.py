"""Unsupervised models: standardised features, an isolation forest and density clusters."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.functions.schemas import extended
from ledgerloom.operators.graph import components
from ledgerloom.operators.peers import medians
from ledgerloom.session import staged


def imputed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Nulls and NaN replaced by the column's median, with an indicator column for each feature.

    Medians are exact and come from counts of distinct values over range partitions, all features at once, so no task
    gathers a column. A column without any value becomes zero.
    """
    real = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    cells = F.array(*[F.struct(F.lit(i).alias("f"), c.alias("v")) for i, c in enumerate(real.values())])
    counts = df.select(F.inline(cells)).where("v is not null").groupBy("f", "v").agg(F.count(F.lit(1)).alias("c"))
    found = {r["f"]: r["median"] for r in medians(counts, ["f"], "v", "c").collect()}  # a row for each feature
    filled = {f: F.coalesce(c, F.lit(found.get(i, 0.0))) for i, (f, c) in enumerate(real.items())}
    return df.withColumns({f"{f}_missing": real[f].isNull().cast("int") for f in features} | filled)


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features minus their mean over their population deviation; a constant feature becomes zero."""
    stats = df.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    return df.withColumns({f: (F.col(f) - F.lit(stats[f"m_{f}"] or 0.0)) / F.lit(stats[f"s_{f}"] or 1.0) for f in features})


#: Rows from which trees draw their samples, chosen by a hash; a bound, so the driver's part doesn't grow with the data.
POOL, TREES, SAMPLE = 25_600, 100, 256


def path_constant(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _split(low: float, high: float, share: float) -> float:
    """A place above ``low``, up to ``high``: between neighbouring or endless numbers it is ``high``, so neither side is empty."""
    s = low + (high - low) * share
    return min(s, high) if s > low else high


class Forest:
    """Isolation trees kept as flat arrays, so a batch walks all trees level by level."""

    def __init__(self, rows: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE) -> None:
        rng = np.random.default_rng(seed)
        self.n = min(sample, len(rows))
        self.depth = math.ceil(math.log2(self.n)) if self.n > 1 else 0
        size = 1 << (self.depth + 1)
        self.feature = np.full((trees, size), -1, dtype=np.int32)
        self.split = np.zeros((trees, size))
        self.length = np.zeros((trees, size))
        for t in range(trees if self.n > 1 else 0):
            queue = [(1, rng.choice(len(rows), self.n, replace=False), 0)]
            while queue:
                node, inside, level = queue.pop()
                low, high = rows[inside].min(0), rows[inside].max(0)
                varied = np.flatnonzero(high > low)
                if level == self.depth or len(inside) < 2 or not len(varied):
                    self.length[t, node] = level + path_constant(len(inside))
                    continue
                f = int(rng.choice(varied))
                s = _split(float(low[f]), float(high[f]), float(rng.random()))
                self.feature[t, node], self.split[t, node] = f, s
                below = rows[inside, f] < s
                queue += [(2 * node, inside[below], level + 1), (2 * node + 1, inside[~below], level + 1)]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, near 1 for rows that are isolated early; 0.5 for all if there is nothing to compare."""
        if self.n < 2 or path_constant(self.n) == 0:
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        at_rows = np.arange(len(rows))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.ones(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = rows[at_rows, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, 2 * node + right, node)
            total += length[node]
        return np.power(2.0, -total / len(self.feature) / path_constant(self.n))


def _lowest(df: DataFrame, hashed: str, most: int) -> list[Row]:
    """The ``most`` rows of the smallest hashes. Tasks send about twice as many together, however many tasks there are:
    a bound on the hash leaves that many of evenly spread hashes; where it leaves too few, all rows are asked."""
    n = df.count()
    if n > 2 * most:
        below = df.where(F.col(hashed) < int(2**64 * (2 * most / n)) - 2**63)
        if len(found := below.orderBy(hashed).limit(most).collect()) == most:
            return found
    return df.orderBy(hashed).limit(most).collect()


def isolation_scores(df: DataFrame, key: str, features: Sequence[str], seed: int = 17) -> DataFrame:
    """``key, score`` of every row; nulls and NaN take the median. Trees come from a bounded, seeded pool of rows."""
    filled = imputed(df.select(key, *features), features)
    pool = _lowest(filled.select(F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h"), F.array(*features).alias("x")), "h", POOL)
    forest = Forest(np.array([r["x"] for r in pool], dtype=float).reshape(len(pool), len(features)), seed)
    shared = df.sparkSession.sparkContext.broadcast(forest)  # TREES x SAMPLE nodes, whatever the data

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "score": shared.value.scores(p[list(features)].to_numpy(dtype=float))})

    return filled.select(key, *features).mapInPandas(run, extended(df.select(key).schema, "score double"))


#: Features that make the grid; a point is looked for in 3 ** GRID cells.
GRID = 3


def density_clusters(df: DataFrame, key: str, features: Sequence[str], eps: float = 0.9, least: int = 50) -> DataFrame:
    """``key, cluster``: DBSCAN on standardised features rounded to one decimal; -1 is noise.

    Equal rows are one point with their number as weight. Points within ``eps`` are found by an equi join on grid cells
    of the first GRID features and the cells around them; as features are rounded, a cell of three holds a bounded number
    of points (9 ** 3 at the default ``eps``), however many rows these stand for. A point is core if its neighbourhood weighs ``least``; clusters
    are components of cores, named by their smallest point; other points join the smallest cluster among their core
    neighbours. Nulls and NaN take the median.
    """
    rounded = standardised(imputed(df.select(key, *features), features), features).withColumns({f: F.bround(f, 1) + 0.0 for f in features})
    points = rounded.groupBy(*features).agg(F.count(F.lit(1)).alias("weight"))
    points = staged(points.withColumn("point", F.monotonically_increasing_id()), "points")
    grid = list(features[:GRID])
    cells = [F.floor(F.col(f) / eps) for f in grid]
    here = points.select(F.col("point").alias("p"), *[F.col(f).alias(f"p_{f}") for f in features], *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"d{i}") for i, s in enumerate(d)]) for d in itertools.product((-1, 0, 1), repeat=len(grid))])
    around = points.select(F.col("point").alias("q"), "weight", *[F.col(f).alias(f"q_{f}") for f in features], *[c.alias(f"e{i}") for i, c in enumerate(cells)], F.explode(steps).alias("d"))
    around = around.select("q", "weight", *[f"q_{f}" for f in features], *[(F.col(f"e{i}") + F.col(f"d.d{i}")).alias(f"c{i}") for i in range(len(grid))])
    square = sum(((F.col(f"p_{f}") - F.col(f"q_{f}")) * (F.col(f"p_{f}") - F.col(f"q_{f}")) for f in features), F.lit(0.0))
    near = staged(here.join(around, [f"c{i}" for i in range(len(grid))]).where(square <= eps * eps + 1e-9).select("p", "q", "weight"), "near")
    cores = staged(near.groupBy("p").agg(F.sum("weight").alias("w")).where(F.col("w") >= least).select("p"), "cores")
    between = near.join(cores, "p", "left_semi").join(cores.select(F.col("p").alias("q")), "q", "left_semi")
    roots = components(between, "p", "q")
    label = near.join(roots.withColumnRenamed("node", "q"), "q").groupBy("p").agg(F.min("root").alias("cluster"))
    label = label.join(roots.select(F.col("node").alias("p"), F.col("root").alias("own")), "p", "left").select(F.col("p").alias("point"), F.coalesce("own", "cluster").alias("cluster"))
    named = points.join(label, "point", "left").select(*[F.col(f).alias(f"n_{f}") for f in features], F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return rounded.join(named, [F.col(f) == F.col(f"n_{f}") for f in features]).select(key, "cluster")
