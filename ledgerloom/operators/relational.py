"""Relational operators: checked joins, grouped metrics, windows, ranks and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import both, either, next_month
from ledgerloom.session import staged


class CardinalityError(ValueError):
    """A join's side has a key more than once although the join needs it unique."""


def unique_or_raise(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` itself if no combination of ``keys`` occurs twice; the check stops at the first repeated one."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise CardinalityError(f"{what}: {', '.join(keys)} is not unique")
    return df


def joined_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join after a check that ``right`` has each key once; null keys match nothing."""
    return left.join(unique_or_raise(right, keys, "right side"), keys, "left")


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join after a check that both sides have each key once."""
    return joined_many_to_one(unique_or_raise(left, keys, "left side"), right, keys)


def own_keys(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with a text ``key`` of its own for each row: the first row of a key keeps it, every further one (by
    ``order``) has its number behind a unit separator, as have rows without a key. Rows equal in ``order`` change places at most."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    text = F.col(key).cast("string")
    named = F.when(text.isNotNull() & (F.col("__nth") == 1), text).otherwise(F.concat(F.coalesce(text, F.lit("")), F.lit("\x1f"), F.col("__nth")))
    return df.withColumn("__nth", nth).withColumn(key, named).drop("__nth")


def matched(left: DataFrame, right: DataFrame, keys: list[str], name: str = "match") -> DataFrame:
    """Left join with a column telling ``Matched`` from ``Unmatched`` rows."""
    marked = right.withColumn("__here", F.lit(True))
    return left.join(marked, keys, "left").withColumn(name, F.when(F.col("__here"), "Matched").otherwise("Unmatched")).drop("__here")


def merged_outer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join where the first side's values win and the second's fill its nulls (blanks are values).

    Columns of one side only are kept; ``in_first`` and ``in_second`` tell where a key occurs.
    """
    shared = [c for c in first.columns if c in second.columns and c not in keys]
    a = first.withColumn("in_first", F.lit(True)).withColumnsRenamed({c: f"__a_{c}" for c in shared})
    b = second.withColumn("in_second", F.lit(True)).withColumnsRenamed({c: f"__b_{c}" for c in shared})
    both_sides = a.join(b, keys, "full_outer")
    out = both_sides.withColumns({c: F.coalesce(f"__a_{c}", f"__b_{c}") for c in shared})
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_first", "in_second")})
    return out.drop(*[f"__{s}_{c}" for c in shared for s in "ab"])


def conflicts(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, first_value, second_value`` wherever both sides have the key and differ (null and value differ)."""
    a = first.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    b = second.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("first_value"), F.col(f"b_{f}").alias("second_value")) for f in fields])
    return a.join(b, key).select(key, F.inline(rows)).where(~F.col("first_value").eqNullSafe(F.col("second_value")))


def prior_window(key: str, day: str, from_days: int | None = None) -> Window:
    """Rows of the same key on strictly earlier days, optionally of the last so many days only."""
    low = Window.unboundedPreceding if from_days is None else -from_days
    return Window.partitionBy(key).orderBy(F.unix_date(F.col(day))).rangeBetween(low, -1)


def prior_sum_if_known(value: str, window) -> Column:
    """Sum over a window of earlier rows: zero without any, null once any of them is unknown."""
    unknown = F.count(F.lit(1)).over(window) - F.count(value).over(window)
    return F.when(unknown == 0, F.coalesce(F.sum(value).over(window), F.lit(0)))


def prior_by_day(df: DataFrame, key: str, day: str, value: str, from_days: int | None = None) -> DataFrame:
    """``df`` with ``earlier``, ``earlier_known`` and ``earlier_if_known``: rows of the key on strictly earlier days, the
    sum of their known values, and that sum unless one of them is unknown.

    Days are summed up first and the window runs over them, so a key with very many rows costs its days only. Rows with
    a null key or day get nulls.
    """
    daily = df.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(day).alias("__day"))
    daily = daily.agg(F.count(F.lit(1)).alias("__n"), F.count(value).alias("__known"), F.sum(value).alias("__sum"))
    w = prior_window("__key", "__day", from_days)
    over = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    stats = daily.select("__key", "__day", over("__n").alias("earlier"), over("__sum").alias("earlier_known"), F.when(over("__n") == over("__known"), over("__sum")).alias("earlier_if_known"))
    return df.join(stats, (F.col(key) == F.col("__key")) & (F.col(day) == F.col("__day")), "left").drop("__key", "__day")


def percent_rank_avg(df: DataFrame, value: str, name: str) -> DataFrame:
    """Percentile rank with average ranks for ties, 0 to 100; null values get none.

    The ranks come from counts of distinct values: these are summed up over range partitions, so no task sorts all
    rows, which one global window would make it do.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    summed = running_total(counts, value, "__c", "__upto")
    total = counts.agg(F.sum("__c")).first()[0] or 1
    ranks = summed.select(value, ((F.col("__upto") - (F.col("__c") - 1) / 2) * 100.0 / F.lit(total)).alias(name))
    return df.join(ranks, value, "left")


def running_total(df: DataFrame, order: str, amount: str, name: str, descending: bool = False) -> DataFrame:
    """Inclusive running sum of ``amount`` in the order of a column without repeated values.

    Two passes over range partitions: sums within each, and the sums of those before it (one row a partition). The
    partitions are written down in between, as sampling their borders again could move them.
    """
    column = F.col(order).desc() if descending else F.col(order).asc()
    placed = staged(df.repartitionByRange(column).withColumn("__p", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("__p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__p").agg(F.sum(amount).alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0))).select("__p", "__o")
    return placed.withColumn(name, F.sum(amount).over(inner)).join(F.broadcast(offsets), "__p").withColumn(name, F.col(name) + F.col("__o")).drop("__p", "__o")


def ranked(df: DataFrame, order: Sequence[Column], name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Row numbers by a total order, within each partition if there is one.

    Numbers over all rows come from range partitions and the counts of those before, so no task gets all rows.
    """
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    placed = staged(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0))).select("__p", "__o")
    numbered = placed.withColumn(name, F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return numbered.join(F.broadcast(offsets), "__p").withColumn(name, (F.col(name) + F.col("__o")).cast("int")).drop("__p", "__o")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each partition's groups before the shuffle."""
    return ranked(df, order, "__k", group).where(F.col("__k") <= k).drop("__k")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: a grouped maximum, so repeated keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*")


def shares(df: DataFrame, group: Sequence[str], member: str, amount: str) -> DataFrame:
    """Each member's total and its share of the group's total (null unless that is positive); null keys are left out."""
    kept = df.where(both([F.col(c).isNotNull() for c in (*group, member)]))
    totals = kept.groupBy(*group, member).agg(F.sum(amount).alias("total"))
    whole = totals.groupBy(*group).agg(F.sum("total").alias("__whole"))
    return totals.join(whole, list(group)).withColumn("share", F.when(F.col("__whole") > 0, F.col("total") / F.col("__whole"))).drop("__whole")


def concentration(df: DataFrame, group: Sequence[str], member: str, amount: str) -> DataFrame:
    """Herfindahl index, largest share and number of members of each group."""
    each = shares(df, group, member, amount)
    return each.groupBy(*group).agg(F.round(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"), F.round(F.max("share"), 6).alias("top_share"), F.count(F.lit(1)).alias("members"), F.sum("total").alias("total"))


def month_gaps(months: DataFrame, month: str, by: Sequence[str] = ()) -> DataFrame:
    """Months (of a group, if ``by`` names one) that aren't followed by the next calendar month although a later one
    exists. Without groups the months of all lie in one task; they are few."""
    after = F.lead(month).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(month))
    return months.withColumn("following", after).where(F.col("following").isNotNull() & (F.col("following") != next_month(F.col(month))))


def searched(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column, as text, contains the search text in any letter case; wildcards have no meaning."""
    wanted = F.lit(text.lower())
    return df.where(either([F.contains(F.lower(F.col(c).cast("string")), wanted) for c in columns]))


def paged(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order; 1 to 100 rows from an offset of at most ten million."""
    if not 1 <= limit <= 100 or not 0 <= offset <= 10_000_000:
        raise ValueError("limit must be 1..100 and offset 0..10000000")
    return df.orderBy(*order).offset(offset).limit(limit)


def profiled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, rows, blanks, na_tokens, distinct_values, bytes`` of each column as text.

    Null and cells of blanks only are blanks, ``NA`` is counted apart, neither is a distinct value. Cells are counted by
    value before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    plain = F.trim("value")
    given = F.when(~plain.isin("", "NA"), F.col("value"))
    return df.select(F.inline(cells)).groupBy("field").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(plain, F.lit("")) == "").alias("blanks"),
        F.count_if(plain == "NA").alias("na_tokens"),
        F.count_distinct(given).alias("distinct_values"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("bigint").alias("bytes"),
    )


def documented(df: DataFrame, name: str, value: Column, meaning: str, source: str = "") -> DataFrame:
    """A computed column that carries its meaning and source in the schema."""
    return df.withColumn(name, value).withMetadata(name, {"meaning": meaning, "source": source})


def dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, field, type, meaning, source`` of all columns of some tables, from their schemas alone."""
    rows = [(t, f.name, f.dataType.simpleString(), f.metadata.get("meaning"), f.metadata.get("source")) for t, df in sorted(tables.items()) for f in df.schema]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, field string, type string, meaning string, source string")


def quarantined(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(sound, rejected)``: rows with a null or blank required column are rejected, and say which."""
    empty = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in required]
    marked = df.withColumn("missing_fields", F.array_join(F.array_compact(F.array(*empty)), ";"))
    return marked.where("missing_fields = ''").drop("missing_fields"), marked.where("missing_fields <> ''")


def reconciled(checks: Sequence[tuple[str, tuple[DataFrame, Column], tuple[DataFrame, Column]]]) -> DataFrame:
    """``name, found, expected, ok`` for each pair of aggregates that should be equal whole numbers; a null equals nothing.

    All are branches of one query, so scans and exchanges that occur in several are reused.
    """
    one = lambda name, kind, side: side[0].agg(side[1].cast("bigint").alias("v")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "v")
    rows = reduce(DataFrame.union, [one(name, kind, side) for name, *sides in checks for kind, side in zip((0, 1), sides, strict=True)])
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("v")))
    return rows.groupBy("name").agg(pick(0).alias("found"), pick(1).alias("expected")).withColumn("ok", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)))


def same_members(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """``key, side`` of the keys that only one of two tables has (``missing`` or ``unknown``); none if the sets are equal."""
    a, b = wanted.select(key).distinct(), there.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unknown")))
