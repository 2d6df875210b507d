"""The queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import mixture
from ledgerloom.llm.names import link_names, person_pairs
from ledgerloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from ledgerloom.llm.packing import Limit, fill_report, packed, text_items, with_text
from ledgerloom.llm.quantiles import daily_sketches, from_days, merge_sketches, read_quantiles, sketch_values
from ledgerloom.llm.splitting import split_texts
from ledgerloom.sources.tables import table


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "works_recommended").select("mp_profile_id", "mp_name", "state_name", "constituency", "cohort")
    calamities = table(spark, sf_dir, "calamity_features").select("mp_profile_id", "mp_name", F.col("mp_state").alias("state_name"), F.col("mp_constituency").alias("constituency"), F.lit(None).cast("string").alias("cohort"))
    return link_names(works.unionByName(calamities), "mp_profile_id", "mp_name", ["state_name", "constituency", "cohort"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of profiles that belong to one member."""
    return person_pairs(_persons(spark, sf_dir)).select(F.col("a").alias("profile_a"), F.col("b").alias("profile_b"))


def p1_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile with its member's smallest profile and how many other profiles it is linked to."""
    linked = _persons(spark, sf_dir)
    sizes = linked.groupBy("person").agg((F.count(F.lit(1)) - 1).alias("links"))
    return linked.join(sizes, "person").select(F.col("id").alias("mp_profile_id"), F.col("person").alias("person_profile_id"), "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of works whose descriptions and sanctioned amounts nearly agree."""
    pairs = near_duplicate_pairs(table(spark, sf_dir, "work_features"), "work_id", "description_normalized", "sanction_amount_paise")
    return pairs.select(F.col("a").alias("work_id_a"), F.col("b").alias("work_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work with its group of near duplicates."""
    return near_duplicate_groups(table(spark, sf_dir, "work_features"), "work_id", "description_normalized", "sanction_amount_paise").withColumnRenamed("key", "work_id")


FIELDS = ["peer_median_inr", "sanction_amount_paise"]
SHARES = [0.1, 0.5, 0.9, 0.99]


def _named(found: DataFrame) -> DataFrame:
    return found.select("field", "state", "sanction_fy", "n", F.col("share").alias("percentile"), "estimate", "rank_error")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of two columns per state and fiscal year, each partition sketched where it lies."""
    works = table(spark, sf_dir, "work_features")
    long = works.select("state", "sanction_fy", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in FIELDS])))
    keys = ["field", "state", "sanction_fy"]
    return _named(read_quantiles(merge_sketches(sketch_values(long, keys, "value"), keys), keys, SHARES))


def p3_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles, put together from the sketches of single days of loaded_at."""
    daily = daily_sketches(table(spark, sf_dir, "work_features"), FIELDS, ["state", "sanction_fy"], "loaded_at")
    return _named(from_days(daily, ["state", "sanction_fy"], SHARES))


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of whole columns, and whether the exact ranks of the estimates lie within the stated error."""
    works = table(spark, sf_dir, "work_features")
    long = works.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in FIELDS])))
    long = long.where("value is not null and not isnan(value)")
    found = read_quantiles(merge_sketches(sketch_values(long, ["field"], "value"), ["field"]), ["field"], SHARES)
    ranks = long.join(F.broadcast(found), "field").groupBy("field", "n", "share", "rank_error").agg(F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"))  # eight rows
    # The wanted rank lies in the run of values equal to the estimate, give or take the error.
    want, slack = F.greatest(F.lit(1), F.ceil(F.round(F.col("share") * F.col("n"), 6))), F.col("rank_error") * F.col("n")
    within = (F.col("below") < want + slack) & (F.col("upto") >= want - slack)
    return ranks.select("field", "n", F.col("share").alias("percentile"), (F.col("rank_error") > 0).alias("compacted"), within.alias("within"))


def _limits(spark: SparkSession, sf_dir: str, purpose: str) -> list[tuple[int, int, int]]:
    rows = table(spark, sf_dir, "token_limits").where(F.col("purpose") == purpose).orderBy("limit_id").collect()
    return [(r["limit_id"], r["max_tokens"], r["overlap_tokens"]) for r in rows]


def _containers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Limit]]:
    limits = [Limit.of(i, most) for i, most, _ in _limits(spark, sf_dir, "container")]
    return packed(text_items(table(spark, sf_dir, "documents"), "doc_id", "text", limits), "doc_id", limits), limits


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of containers: which text, or which part of an oversized text, lies in which slot."""
    return _containers(spark, sf_dir)[0]


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of containers with their texts."""
    return with_text(_containers(spark, sf_dir)[0], table(spark, sf_dir, "documents"), "doc_id", "text").select("limit_id", "container_id", "slot", "doc_id", "piece_no", "text")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(*_containers(spark, sf_dir))


def p6_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of containers of which also the segments (one for each 512 tokens) and the loss (7/8 of the tokens) are limited."""
    limits = [Limit.of(i, most, max(1, most // 512), most * 7 // 8) for i, most, _ in _limits(spark, sf_dir, "container")]
    return packed(text_items(table(spark, sf_dir, "documents"), "doc_id", "text", limits), "doc_id", limits)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as all sources with targets; those too small for their share give all their repeats."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), total_tokens="all")[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that this mixture reaches."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), total_tokens="all")[1]


def p7_exact_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture in which every source that has texts reaches its target share; its smallest source bounds it."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p7_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the exact mixture reaches."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p7_shares_of_20m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached if 20 million tokens are wanted: small sources give all their repeats and fall short."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), total_tokens=20_000_000)[1]


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered, overlapping pieces of the texts above each limit."""
    return split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", _limits(spark, sf_dir, "piece"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_persons": p1_persons,
    "p3_percentiles": p3_percentiles,
    "p3_from_days": p3_from_days,
    "p3_bounds": p3_bounds,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_texts": p6_texts,
    "p6_tight": p6_tight,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_exact_mixture": p7_exact_mixture,
    "p7_exact_shares": p7_exact_shares,
    "p7_shares_of_20m": p7_shares_of_20m,
    "p8_pieces": p8_pieces,
}

_PERCENTILES = """
WITH v AS (
  SELECT 'peer_median_inr' AS field, state, sanction_fy, peer_median_inr AS x FROM work_features
  UNION ALL SELECT 'sanction_amount_paise', state, sanction_fy, CAST(sanction_amount_paise AS DOUBLE) FROM work_features),
r AS (
  SELECT field, state, sanction_fy, x, count(*) OVER (PARTITION BY field, state, sanction_fy) AS n,
    row_number() OVER (PARTITION BY field, state, sanction_fy ORDER BY x) AS k
  FROM v WHERE x IS NOT NULL AND NOT isnan(x))
SELECT field, state, sanction_fy, n, q.percentile, x AS estimate, CAST(0 AS DOUBLE) AS rank_error
FROM r JOIN (VALUES (CAST(0.1 AS DOUBLE), 10), (0.5, 50), (0.9, 90), (0.99, 99)) AS q(percentile, pct)
  ON k = greatest(1, (n * q.pct + 99) // 100)"""

SQL: dict[str, str] = {
    "p3_percentiles": _PERCENTILES,
    "p3_from_days": _PERCENTILES,
    "p3_bounds": """
SELECT field, n, q AS percentile, n > 383 AS compacted, TRUE AS within FROM (
  SELECT 'peer_median_inr' AS field, count(*) AS n FROM work_features WHERE peer_median_inr IS NOT NULL AND NOT isnan(peer_median_inr)
  UNION ALL SELECT 'sanction_amount_paise', count(*) FROM work_features WHERE sanction_amount_paise IS NOT NULL), (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.9), (0.99)) AS t(q)""",
    "p4_found": r"""
WITH u AS (
  SELECT work_id, sanction_amount_paise AS amt, list_distinct(list_filter(regexp_split_to_array(description_normalized, '\s+'), lambda x: x <> '')) AS w
  FROM work_features WHERE trim(coalesce(description_normalized, '')) <> '' AND sanction_amount_paise IS NOT NULL),
c AS (
  SELECT a.work_id AS work_id_a, b.work_id AS work_id_b, len(list_intersect(a.w, b.w)) AS both_n, len(a.w) + len(b.w) AS sum_n
  FROM u a JOIN u b ON a.work_id < b.work_id AND 50 * abs(a.amt - b.amt) <= greatest(a.amt, b.amt))
SELECT work_id_a, work_id_b FROM c WHERE 10 * both_n >= 7 * (sum_n - both_n)""",
}
