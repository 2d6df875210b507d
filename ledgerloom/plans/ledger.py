"""Queries over the works ledger: scans, joins, aggregates, windows, ranks and set operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import binned, fiscal_quarter, fiscal_year, formula_safe, last_days_of_fiscal_year, listed_reasons, material, month_of, next_month, ratio
from ledgerloom.functions.values import amount_paise, date_of, present
from ledgerloom.operators import peers as P
from ledgerloom.operators import relational as R
from ledgerloom.operators import works as W
from ledgerloom.plans.sql import day, fy, given, paise, using
from ledgerloom.session import staged
from ledgerloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2026-09-01"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with its SQL if there is any."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- Scans and profiles ---


#: The raw exports and their columns of text, as documented.
_RAW = {
    "allocated_limit": "cohort mp_name state_name constituency house_of_parliament house_name tenure tenure_start_date tenure_end_date allocated_amt".split(),
    "works_recommended": "cohort work_recommendation_dtl_id mp_name state_name ida_name constituency constituency_id house_of_parliament tenure work_category activity_name work_description letter_no recommended_amount sanction_amount recommendation_date sanction_date work_stage flag".split(),
    "works_sanctioned": "cohort work_recommendation_dtl_id mp_name state_name ida_name constituency constituency_id house_of_parliament tenure work_category activity_name work_description letter_no recommended_amount sanction_amount recommendation_date sanction_date work_stage flag".split(),
    "expenditure": "cohort sno work_recommendation_dtl_id vendor_id vendor_name ia_name work_status state_name ida_name mp_name work_id expenditure_date fund_disbursed_amt".split(),
}
_CELLS = "SELECT tab, field, count(*) AS rows, count(*) FILTER (WHERE v IS NULL OR trim(v, ' ') = '') AS blanks, count(*) FILTER (WHERE trim(v, ' ') = 'NA') AS na_tokens, count(DISTINCT v) FILTER (WHERE trim(v, ' ') NOT IN ('', 'NA')) AS distinct_values, CAST(coalesce(sum(strlen(v)), 0) AS BIGINT) AS bytes FROM ("


@query(_CELLS + " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS field, CAST({c} AS VARCHAR) AS v FROM {t}" for t, columns in _RAW.items() for c in columns) + ") GROUP BY tab, field")
def q_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank cells, ``NA`` tokens, distinct values and bytes of every text column of the raw exports."""
    parts = [R.profiled(table(spark, sf_dir, t), columns).select(F.lit(t).alias("tab"), "*") for t, columns in _RAW.items()]
    return reduce(DataFrame.unionByName, parts)


_PROFILED = {"works_recommended": ("recommendation_date", "recommended_amount", "work_stage"), "works_sanctioned": ("sanction_date", "sanction_amount", "work_stage"), "expenditure": ("expenditure_date", "fund_disbursed_amt", "work_status")}


@query(
    "SELECT tab, cohort, status, count(*) AS rows, min(d) AS first_day, max(d) AS last_day, CAST(sum(p) AS BIGINT) AS total_paise, count(*) FILTER (WHERE p = 0) AS zero_amounts, count(*) FILTER (WHERE p IS NULL) AS unusable FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS tab, cohort, {status} AS status, {day(d)} AS d, {paise(m)} AS p FROM {t}" for t, (d, m, status) in _PROFILED.items())
    + ") GROUP BY ALL"
)
def q_profile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, sums, zero and unusable amounts of each export, cohort and status."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tab"), "cohort", F.col(status).alias("status"), date_of(F.col(d)).alias("d"), amount_paise(F.col(m)).alias("p")) for t, (d, m, status) in _PROFILED.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("tab", "cohort", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.sum("p").alias("total_paise"), F.count_if(F.col("p") == 0).alias("zero_amounts"), F.count_if(F.col("p").isNull()).alias("unusable"),
    )


@query(
    using("pay")
    + " SELECT cohort, count(*) AS rows, min(paid_on) AS first_day, max(paid_on) AS last_day, count(*) FILTER (WHERE paise = 0) AS zero_amounts, count(*) FILTER (WHERE paise IS NULL) AS unusable, CAST(sum(paise) AS BIGINT) AS total_paise, count(*) FILTER (WHERE is_repeat) AS repeats FROM pay GROUP BY cohort"
)
def q_source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, sums, zero and unusable amounts and repeats of each cohort."""
    p = W.payments_with_repeats(spark, sf_dir)
    return p.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("rows"), F.min("paid_on").alias("first_day"), F.max("paid_on").alias("last_day"), F.count_if(F.col("paise") == 0).alias("zero_amounts"),
        F.count_if(F.col("paise").isNull()).alias("unusable"), F.sum("paise").alias("total_paise"), F.count_if("is_repeat").alias("repeats"),
    )


@query(
    "SELECT record_id, CASE WHEN coalesce(trim(work_recommendation_dtl_id), '') = '' AND coalesce(trim(vendor_id), '') = '' THEN 'work_recommendation_dtl_id;vendor_id' WHEN coalesce(trim(work_recommendation_dtl_id), '') = '' THEN 'work_recommendation_dtl_id' ELSE 'vendor_id' END AS missing_fields FROM expenditure WHERE coalesce(trim(work_recommendation_dtl_id), '') = '' OR coalesce(trim(vendor_id), '') = ''"
)
def q_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows set aside because a required field is blank."""
    return R.quarantined(table(spark, sf_dir, "expenditure"), ["work_recommendation_dtl_id", "vendor_id"])[1].select("record_id", "missing_fields")


@query(f"SELECT record_id, {paise('fund_disbursed_amt')} AS paise FROM expenditure WHERE {given('fund_disbursed_amt')}")
def q_money_paise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: amounts as whole paise."""
    return table(spark, sf_dir, "expenditure").where(present(F.col("fund_disbursed_amt"))).select("record_id", amount_paise(F.col("fund_disbursed_amt")).alias("paise"))


@query("SELECT vendor_id, CASE WHEN regexp_matches(vendor_name, '^[=+@\\-\\t\\r]') THEN '''' || vendor_name ELSE vendor_name END AS cell FROM vendor_features")
def q_formula_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that spreadsheets don't take for formulas."""
    return table(spark, sf_dir, "vendor_features").select("vendor_id", formula_safe(F.col("vendor_name")).alias("cell"))


# --- Joins ---


@query(using("wk") + " SELECT work_key, cohort, state, recommended_paise, sanction_paise, sanction_date, is_sanctioned, is_recommended FROM wk")
def q_full_outer_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each work of either export."""
    return W.works(spark, sf_dir).select("work_key", "cohort", "state", "recommended_paise", "sanction_paise", "sanction_date", "is_sanctioned", "is_recommended")


@query(using("pay", "san") + " SELECT cohort, count(*) AS rows, count(DISTINCT work_key) AS keys FROM pay WHERE work_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM san WHERE san.work_key = pay.work_key) GROUP BY cohort")
def q_unmatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments whose work isn't in the sanctioned export at all."""
    p = W.payments(spark, sf_dir).where(F.col("work_key").isNotNull())
    return p.join(W.sanctioned(spark, sf_dir).select("work_key"), "work_key", "left_anti").groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("work_key").alias("keys"))


@query(using("san", "pay") + " SELECT work_key, state, sanction_paise FROM san WHERE work_key IN (SELECT work_key FROM pay WHERE vendor = 'V00000001')")
def q_semi_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that a vendor was paid for."""
    paid = W.payments(spark, sf_dir).where(F.col("vendor") == "V00000001").select("work_key")
    return W.sanctioned(spark, sf_dir).join(paid, "work_key", "left_semi").select("work_key", "state", "sanction_paise")


@query(using("san", "pay") + " SELECT DISTINCT vendor FROM pay WHERE vendor IS NOT NULL AND work_key IN (SELECT work_key FROM san WHERE ida IN (SELECT ida FROM san WHERE sanction_paise >= 1000000000))")
def q_nested_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors of works of authorities that have a very large work."""
    s = W.sanctioned(spark, sf_dir)
    big = s.where("sanction_paise >= 1000000000").select("ida")
    inside = s.join(big, "ida", "left_semi").select("work_key")
    return W.payments(spark, sf_dir).where("vendor is not null").join(inside, "work_key", "left_semi").select("vendor").distinct()


@query(using("pay") + " SELECT p.record_id, CASE WHEN v.vendor_id IS NULL THEN 'Unmatched' ELSE 'Matched' END AS match, v.payment_row_count FROM pay p LEFT JOIN vendor_features v ON p.vendor = v.vendor_id")
def q_validated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with their vendor's row, after a check that vendors are unique."""
    v = table(spark, sf_dir, "vendor_features").select(F.col("vendor_id").alias("vendor"), "payment_row_count")
    return R.matched(W.payments(spark, sf_dir), R.unique_or_raise(v, ["vendor"], "vendors"), ["vendor"]).select("record_id", "match", "payment_row_count")


_COMPARED = ["state", "ida", "description", "stage", "recommended_paise", "sanction_paise", "recommendation_date", "sanction_date", "profile", "activity"]


@query(using("san", "rec") + " " + " UNION ALL ".join(f"SELECT s.work_key, '{c}' AS field, CAST(r.{c} AS VARCHAR) AS first_value, CAST(s.{c} AS VARCHAR) AS second_value FROM san s JOIN rec r ON s.work_key = r.work_key WHERE r.{c} IS DISTINCT FROM s.{c}" for c in _COMPARED))
def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten fields of both exports, wherever they differ for one work."""
    return R.conflicts(W.recommended(spark, sf_dir), W.sanctioned(spark, sf_dir), "work_key", _COMPARED)


@query(using("rec") + " SELECT a.cohort AS cohort_a, b.cohort AS cohort_b, count(*) AS shared_ids FROM (SELECT DISTINCT cohort, split_part(work_key, ':', 2) AS id FROM rec) a JOIN (SELECT DISTINCT cohort, split_part(work_key, ':', 2) AS id FROM rec) b ON a.id = b.id AND a.cohort < b.cohort GROUP BY 1, 2")
def q_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur in two cohorts."""
    ids = W.recommended(spark, sf_dir).select("cohort", F.substring_index("work_key", ":", -1).alias("id")).distinct()
    a, b = ids.withColumnRenamed("cohort", "cohort_a"), ids.withColumnRenamed("cohort", "cohort_b")
    return a.join(b, "id").where("cohort_a < cohort_b").groupBy("cohort_a", "cohort_b").agg(F.count(F.lit(1)).alias("shared_ids"))


@query(using("pay") + " SELECT work_key, vendor, paid_on, paise FROM pay WHERE vendor = 'V00000002' OR (work_key IS NOT NULL AND work_key IN (SELECT work_key FROM pay WHERE vendor = 'V00000003'))")
def q_or_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that satisfy one of two lookups, as an existence join with an alternative."""
    p = W.payments(spark, sf_dir)
    other = p.where("vendor = 'V00000003' and work_key is not null").select("work_key").distinct().withColumn("hit", F.lit(True))
    return p.join(other, "work_key", "left").where("vendor = 'V00000002' or hit").select("work_key", "vendor", "paid_on", "paise")


@query(using("pay", "san") + " SELECT p.record_id, s.state AS work_state, v.vendor_name FROM pay p JOIN san s ON p.work_key = s.work_key JOIN vendor_features v ON p.vendor = v.vendor_id WHERE p.is_success")
def q_double_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with two dimensions."""
    s = W.sanctioned(spark, sf_dir).select("work_key", F.col("state").alias("work_state"))
    v = table(spark, sf_dir, "vendor_features").select(F.col("vendor_id").alias("vendor"), F.col("vendor_name").alias("v_name"))
    return W.payments(spark, sf_dir).where("is_success").join(s, "work_key").join(v, "vendor").select("record_id", "work_state", F.col("v_name").alias("vendor_name"))


# --- Aggregates ---


@query(
    using("full_wk")
    + " SELECT state, count(*) AS works, count(*) FILTER (WHERE is_sanctioned) AS sanctioned, CAST(sum(sanction_paise) AS BIGINT) AS sanction_paise, CAST(sum(paid_paise) AS BIGINT) AS paid_paise, round(CAST(sum(paid_paise) AS DOUBLE) / nullif(sum(sanction_paise), 0), 6) AS settled_share FROM full_wk WHERE state IS NOT NULL GROUP BY state HAVING count(*) >= 20 ORDER BY settled_share DESC NULLS LAST, works DESC, state LIMIT 10"
)
def q_grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten states with the highest settled share among those with 20 works or more."""
    g = W.works_with_payments(spark, sf_dir).where("state is not null").groupBy("state")
    m = g.agg(F.count(F.lit(1)).alias("works"), F.count_if("is_sanctioned").alias("sanctioned"), F.sum("sanction_paise").alias("sanction_paise"), F.sum("paid_paise").alias("paid_paise"))
    m = m.withColumn("settled_share", F.round(ratio(F.col("paid_paise"), F.col("sanction_paise")), 6)).where("works >= 20")
    return m.orderBy(F.col("settled_share").desc_nulls_last(), F.col("works").desc(), "state").limit(10)


@query(using("full_wk") + " SELECT count(*) AS works, count(DISTINCT profile) AS profiles, CAST(sum(sanction_paise) AS BIGINT) AS sanction_paise, CAST(sum(paid_paise) AS BIGINT) AS paid_paise, round(avg(sanction_paise), 3) AS mean_sanction FROM full_wk")
def q_global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals without groups."""
    return W.works_with_payments(spark, sf_dir).agg(F.count(F.lit(1)).alias("works"), F.count_distinct("profile").alias("profiles"), F.sum("sanction_paise").alias("sanction_paise"), F.sum("paid_paise").alias("paid_paise"), F.round(F.avg("sanction_paise"), 3).alias("mean_sanction"))


@query(using("led") + " SELECT * FROM led")
def q_ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments summed for each work."""
    return W.ledger_by_work(W.payments_with_repeats(spark, sf_dir))


@query(using("pay") + " SELECT vendor, min(vendor_name) AS vendor_name, count(*) AS rows, count(DISTINCT work_key) AS works, count(DISTINCT ida) AS authorities, count(DISTINCT agency) AS agencies, CAST(coalesce(sum(paise) FILTER (WHERE is_success), 0) AS BIGINT) AS paid_paise, min(paid_on) AS first_day, max(paid_on) AS last_day FROM pay WHERE vendor IS NOT NULL GROUP BY vendor")
def q_vendor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors."""
    return W.payments(spark, sf_dir).where("vendor is not null").groupBy("vendor").agg(
        F.min("vendor_name").alias("vendor_name"), F.count(F.lit(1)).alias("rows"), F.count_distinct("work_key").alias("works"), F.count_distinct("ida").alias("authorities"), F.count_distinct("agency").alias("agencies"),
        F.coalesce(F.sum(F.when(F.col("is_success"), F.col("paise"))), F.lit(0)).alias("paid_paise"), F.min("paid_on").alias("first_day"), F.max("paid_on").alias("last_day"),
    )


@query(using("pay") + f" SELECT vendor, ida, agency, cohort, fy, count(*) AS rows, CAST(sum(paise) AS BIGINT) AS paise FROM (SELECT *, {fy('paid_on')} AS fy FROM pay) WHERE vendor IS NOT NULL AND ida IS NOT NULL AND agency IS NOT NULL AND fy IS NOT NULL GROUP BY 1, 2, 3, 4, 5")
def q_vendor_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments by five keys."""
    p = W.payments(spark, sf_dir).withColumn("fy", fiscal_year(F.col("paid_on"))).dropna(subset=["vendor", "ida", "agency", "fy"])
    return p.groupBy("vendor", "ida", "agency", "cohort", "fy").agg(F.count(F.lit(1)).alias("rows"), F.sum("paise").alias("paise"))


@query(using("full_wk") + " SELECT profile, count(*) AS works, CAST(sum(recommended_paise) AS BIGINT) AS recommended_paise, CAST(sum(sanction_paise) AS BIGINT) AS sanction_paise, CAST(sum(paid_paise) AS BIGINT) AS paid_paise, round(avg(paid_ratio), 6) AS mean_ratio, count(*) FILTER (WHERE any_repeat) AS with_repeats FROM full_wk WHERE profile IS NOT NULL GROUP BY profile")
def q_member_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members."""
    return W.works_with_payments(spark, sf_dir, repeats=True).where("profile is not null").groupBy("profile").agg(
        F.count(F.lit(1)).alias("works"), F.sum("recommended_paise").alias("recommended_paise"), F.sum("sanction_paise").alias("sanction_paise"), F.sum("paid_paise").alias("paid_paise"),
        F.round(F.avg("paid_ratio"), 6).alias("mean_ratio"), F.count_if("any_repeat").alias("with_repeats"),
    )


_CONC = "t AS (SELECT ida, vendor, sum(paise) AS total FROM pay WHERE is_success AND ida IS NOT NULL AND vendor IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, CASE WHEN sum(total) OVER (PARTITION BY ida) > 0 THEN CAST(total AS DOUBLE) / sum(total) OVER (PARTITION BY ida) END AS share FROM t)"


@query(using("pay") + f", {_CONC} SELECT ida, round(sum(share * share), 6) AS hhi, round(max(share), 6) AS top_share, count(*) AS members, CAST(sum(total) AS BIGINT) AS total FROM s GROUP BY ida")
def q_hhi_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of an authority's payments on vendors."""
    return R.concentration(W.payments(spark, sf_dir).where("is_success"), ["ida"], "vendor", "paise")


@query(using("pay") + ", c AS (SELECT ida, vendor, count(*) AS n FROM pay WHERE ida IS NOT NULL AND vendor IS NOT NULL GROUP BY 1, 2) SELECT ida, round(sum(p * p), 6) AS hhi FROM (SELECT ida, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY ida) AS p FROM c) GROUP BY ida")
def q_value_count_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration by number of payments."""
    return R.concentration(W.payments(spark, sf_dir).withColumn("one", F.lit(1)), ["ida"], "vendor", "one").select("ida", "hhi")


@query(using("pay") + f", {_CONC} SELECT ida, vendor, round(share, 6) AS share FROM s")
def q_partition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vendor's share of an authority's payments."""
    return R.shares(W.payments(spark, sf_dir).where("is_success"), ["ida"], "vendor", "paise").select("ida", "vendor", F.round("share", 6).alias("share"))


@query(using("pay") + " SELECT strftime(paid_on, '%Y-%m') AS month, state, count(*) AS rows, CAST(coalesce(sum(paise) FILTER (WHERE is_success), 0) AS BIGINT) AS paid_paise, CAST(coalesce(sum(paise) FILTER (WHERE NOT is_success), 0) AS BIGINT) AS pending_paise FROM pay WHERE paid_on IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2")
def q_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments by month and state."""
    p = W.payments(spark, sf_dir).where("paid_on is not null and state is not null")
    return p.groupBy(month_of(F.col("paid_on")).alias("month"), "state").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(F.col("is_success"), F.col("paise"))), F.lit(0)).alias("paid_paise"), F.coalesce(F.sum(F.when(~F.col("is_success"), F.col("paise"))), F.lit(0)).alias("pending_paise"))


@query(using("wk") + " SELECT coalesce(sanction_fy, 'Not recorded') AS fy, count(*) AS works, CAST(sum(sanction_paise) AS BIGINT) AS sanction_paise FROM wk GROUP BY 1")
def q_null_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years with a bucket for works without one."""
    return W.works(spark, sf_dir).groupBy(F.coalesce("sanction_fy", F.lit("Not recorded")).alias("fy")).agg(F.count(F.lit(1)).alias("works"), F.sum("sanction_paise").alias("sanction_paise"))


@query(using("wk") + " SELECT stage, cohort, count(*) AS works FROM wk GROUP BY 1, 2")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts."""
    return W.works(spark, sf_dir).groupBy("stage", "cohort").agg(F.count(F.lit(1)).alias("works"))


@query(using("wk") + " SELECT cohort, state, ida, CAST(grouping(cohort) * 4 + grouping(state) * 2 + grouping(ida) AS BIGINT) AS level, count(*) AS works, CAST(sum(sanction_paise) AS BIGINT) AS sanction_paise FROM wk GROUP BY GROUPING SETS ((), (cohort), (state), (state, ida))")
def q_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all, of cohorts, of states and of authorities in one scan."""
    W.works(spark, sf_dir).createOrReplaceTempView("__overview")
    return spark.sql("SELECT cohort, state, ida, grouping_id(cohort, state, ida) AS level, count(*) AS works, sum(sanction_paise) AS sanction_paise FROM __overview GROUP BY GROUPING SETS ((), (cohort), (state), (state, ida))")


_GRAINS = {"vendor": "vendor", "month": "strftime(paid_on, '%Y-%m')", "authority": "ida", "state": "state", "agency": "agency"}


@query(
    using("pay", "led")
    + " SELECT 'ledger' AS grain, count(*) AS groups, CAST(sum(paise) AS BIGINT) AS paise FROM pay WHERE work_key IS NOT NULL UNION ALL SELECT 'work', count(*), CAST(sum(paid_paise + pending_paise) AS BIGINT) FROM led UNION ALL "
    + " UNION ALL ".join(f"SELECT '{g}', count(*), CAST(sum(p) AS BIGINT) FROM (SELECT {k} AS k, sum(paise) AS p FROM pay WHERE work_key IS NOT NULL GROUP BY 1)" for g, k in _GRAINS.items())
)
def q_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same total at seven grains."""
    p = W.payments(spark, sf_dir).where("work_key is not null")
    one = lambda df, grain, c: df.agg(F.count(F.lit(1)).alias("groups"), F.sum(c).alias("paise")).select(F.lit(grain).alias("grain"), "groups", "paise")
    keys = {"vendor": F.col("vendor"), "month": month_of(F.col("paid_on")), "authority": F.col("ida"), "state": F.col("state"), "agency": F.col("agency")}
    parts = [one(p, "ledger", "paise"), one(W.ledger_by_work(p, repeats=False), "work", F.col("paid_paise") + F.col("pending_paise"))]
    parts += [one(p.groupBy(k.alias("k")).agg(F.sum("paise").alias("p")), g, "p") for g, k in keys.items()]
    return reduce(DataFrame.union, parts)


_CHECKS = {
    "one_row_per_work": ("SELECT count(*) FROM wk", "SELECT count(DISTINCT work_key) FROM (SELECT work_key FROM rec UNION ALL SELECT work_key FROM san)"),
    "recommended_kept": ("SELECT count(*) FROM wk WHERE is_recommended", "SELECT count(*) FROM rec"),
    "sanctioned_kept": ("SELECT count(*) FROM wk WHERE is_sanctioned", "SELECT count(*) FROM san"),
    "accepted_and_rejected": ("SELECT count(*) FROM (SELECT record_id FROM expenditure WHERE {ok} UNION ALL SELECT record_id FROM expenditure WHERE NOT ({ok}))", "SELECT count(*) FROM expenditure"),
    "paid": ("SELECT sum(paid_paise) FROM led", "SELECT sum(paise) FROM pay WHERE is_success AND work_key IS NOT NULL"),
    "pending": ("SELECT sum(pending_paise) FROM led", "SELECT sum(paise) FROM pay WHERE NOT is_success AND work_key IS NOT NULL"),
    "sanctioned_amount": ("SELECT sum(sanction_paise) FROM wk WHERE is_sanctioned", "SELECT sum(coalesce(s.sanction_paise, r.sanction_paise)) FROM san s LEFT JOIN rec r ON s.work_key = r.work_key"),
    "recommended_amount": ("SELECT sum(recommended_paise) FROM wk WHERE NOT is_sanctioned", "SELECT sum(recommended_paise) FROM rec WHERE work_key NOT IN (SELECT work_key FROM san)"),
    "allocated": ("SELECT sum(p) FROM (SELECT mp_name, sum({alloc}) AS p FROM allocated_limit GROUP BY 1)", "SELECT sum({alloc}) FROM allocated_limit"),
    "consents": ("SELECT round(sum(p)) FROM (SELECT mp_profile_id, sum(CAST(round(consent_amount * 100) AS BIGINT)) AS p FROM calamity_features GROUP BY 1)", "SELECT sum(CAST(round(consent_amount * 100) AS BIGINT)) FROM calamity_features"),
    "payment_rows": ("SELECT count(DISTINCT record_id) FROM pay", "SELECT count(*) FROM expenditure"),
    "payments_with_work": ("SELECT count(*) FROM pay WHERE work_key IN (SELECT work_key FROM wk)", "SELECT count(*) FROM pay WHERE work_key IS NOT NULL"),
    "sanctioned_was_recommended": ("SELECT count(*) FROM wk WHERE is_sanctioned AND is_recommended", "SELECT count(*) FROM san"),
    "no_later_payment": ("SELECT count(*) FROM pay WHERE paid_on > DATE '{today}'", "SELECT 0"),
    "no_later_sanction": ("SELECT count(*) FROM wk WHERE sanction_date > DATE '{today}'", "SELECT 0"),
    "vendors_total": ("SELECT sum(p) FROM (SELECT vendor, sum(paise) AS p FROM pay GROUP BY 1)", "SELECT sum(paise) FROM pay"),
    "months_total": ("SELECT sum(p) FROM (SELECT date_trunc('month', paid_on) AS m, sum(paise) AS p FROM pay GROUP BY 1)", "SELECT sum(paise) FROM pay"),
    "authorities_total": ("SELECT sum(p) FROM (SELECT ida, sum(paise) AS p FROM pay GROUP BY 1)", "SELECT sum(paise) FROM pay"),
    "members_total": ("SELECT sum(p) FROM (SELECT profile, sum(sanction_paise) AS p FROM wk GROUP BY 1)", "SELECT sum(sanction_paise) FROM wk"),
    "states_total": ("SELECT sum(p) FROM (SELECT state, sum(sanction_paise) AS p FROM wk GROUP BY 1)", "SELECT sum(sanction_paise) FROM wk"),
    "vendor_ids": ("SELECT count(DISTINCT vendor_id) FROM vendor_features", "SELECT count(*) FROM vendor_features"),
}
_FILL = {"ok": given("work_recommendation_dtl_id"), "alloc": "TRY_CAST(" + paise("allocated_amt") + " AS BIGINT)", "today": AS_OF}


@query(
    using("wk", "led")
    + " SELECT *, coalesce(found = expected, FALSE) AS ok FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS name, CAST(({a.format(**_FILL)}) AS BIGINT) AS found, CAST(({b.format(**_FILL)}) AS BIGINT) AS expected" for name, (a, b) in _CHECKS.items())
    + ")"
)
def q_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 totals, each from two ways to it. Data may fail a check; the report says which."""
    rec, san, pay, t = W.recommended(spark, sf_dir), W.sanctioned(spark, sf_dir), W.payments(spark, sf_dir), lambda n: table(spark, sf_dir, n)
    wk, led = W.works(spark, sf_dir), W.ledger_by_work(pay, repeats=False)
    keyed = pay.where("work_key is not null")
    today, n, alloc, paid = F.lit(AS_OF).cast("date"), F.count(F.lit(1)), amount_paise(F.col("allocated_amt")), F.round(F.col("consent_amount") * 100).cast("bigint")
    ok = present(F.col("work_recommendation_dtl_id"))
    spend = t("expenditure")
    by = lambda df, key, c: (df.groupBy(key).agg(F.sum(c).alias("p")), F.sum("p"))
    sides = [
        ("one_row_per_work", (wk, n), (rec.select("work_key").union(san.select("work_key")), F.count_distinct("work_key"))),
        ("recommended_kept", (wk, F.count_if("is_recommended")), (rec, n)),
        ("sanctioned_kept", (wk, F.count_if("is_sanctioned")), (san, n)),
        ("accepted_and_rejected", (spend.where(ok).select("record_id").union(spend.where(~ok).select("record_id")), n), (spend, n)),
        ("paid", (led, F.sum("paid_paise")), (keyed, F.sum(F.when(F.col("is_success"), F.col("paise"))))),
        ("pending", (led, F.sum("pending_paise")), (keyed, F.sum(F.when(~F.col("is_success"), F.col("paise"))))),
        ("sanctioned_amount", (wk.where("is_sanctioned"), F.sum("sanction_paise")), (san.alias("s").join(rec.alias("r"), "work_key", "left"), F.sum(F.coalesce("s.sanction_paise", "r.sanction_paise")))),
        ("recommended_amount", (wk.where("not is_sanctioned"), F.sum("recommended_paise")), (rec.join(san, "work_key", "left_anti"), F.sum("recommended_paise"))),
        ("allocated", by(t("allocated_limit"), "mp_name", alloc), (t("allocated_limit"), F.sum(alloc))),
        ("consents", by(t("calamity_features"), "mp_profile_id", paid), (t("calamity_features"), F.sum(paid))),
        ("payment_rows", (pay, F.count_distinct("record_id")), (spend, n)),
        ("payments_with_work", (keyed.join(wk.select("work_key"), "work_key", "left_semi"), n), (keyed, n)),
        ("sanctioned_was_recommended", (wk, F.count_if(F.col("is_sanctioned") & F.col("is_recommended"))), (san, n)),
        ("no_later_payment", (pay, F.count_if(F.col("paid_on") > today)), (spark.range(1), F.lit(0))),
        ("no_later_sanction", (wk, F.count_if(F.col("sanction_date") > today)), (spark.range(1), F.lit(0))),
        ("vendors_total", by(pay, "vendor", "paise"), (pay, F.sum("paise"))),
        ("months_total", by(pay.withColumn("m", month_of(F.col("paid_on"))), "m", "paise"), (pay, F.sum("paise"))),
        ("authorities_total", by(pay, "ida", "paise"), (pay, F.sum("paise"))),
        ("members_total", by(wk, "profile", "sanction_paise"), (wk, F.sum("sanction_paise"))),
        ("states_total", by(wk, "state", "sanction_paise"), (wk, F.sum("sanction_paise"))),
        ("vendor_ids", (t("vendor_features"), F.count_distinct("vendor_id")), (t("vendor_features"), n)),
    ]
    return R.reconciled(sides)


_PRIOR = using("san") + """, r AS (SELECT state, activity, sanction_fy, ln(1 + sanction_paise / 100.0) AS x FROM (SELECT *, (CAST(year(sanction_date - INTERVAL 3 MONTH) AS VARCHAR) || '-' || CAST(year(sanction_date - INTERVAL 3 MONTH) + 1 AS VARCHAR)) AS sanction_fy FROM san) WHERE sanction_paise > 0 AND sanction_fy IS NOT NULL AND activity IS NOT NULL),
y AS (SELECT DISTINCT sanction_fy AS fy FROM r)"""


_PEERS = (
    _PRIOR
    + """, g AS (SELECT fy, state, activity, x FROM y JOIN r ON r.sanction_fy < y.fy WHERE state IS NOT NULL UNION ALL SELECT fy, NULL, activity, x FROM y JOIN r ON r.sanction_fy < y.fy),
m AS (SELECT *, median(x) OVER (PARTITION BY fy, state, activity) AS med FROM g),
ps AS (SELECT fy, state, activity, count(*) AS peers, min(med) AS med, greatest(1.4826 * median(abs(x - med)), 0.1) AS scale FROM m GROUP BY fy, state, activity HAVING count(*) >= 20)"""
)


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = W.sanctioned(spark, sf_dir).withColumn("sanction_fy", fiscal_year(F.col("sanction_date")))
    return s.select("work_key", "state", "activity", "sanction_fy", F.col("sanction_paise").alias("paise"))


@query(_PEERS + " SELECT fy, state, activity, peers, round(exp(med) - 1, 2) AS median_inr, round(scale, 6) AS scale FROM ps")
def q_prior_year_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and scales of all earlier years, by state and activity and by activity."""
    peers = P.prior_peers(_priced(spark, sf_dir))
    return peers.select("fy", "state", "activity", "peers", F.round(F.expm1("med"), 2).alias("median_inr"), F.round("scale", 6).alias("scale"))


@query(
    _PEERS
    + f""", c AS (SELECT s.work_key, s.sanction_paise, CASE WHEN a.fy IS NOT NULL THEN 'state and activity' WHEN b.fy IS NOT NULL THEN 'activity' ELSE 'none' END AS level,
  CASE WHEN a.fy IS NOT NULL THEN a.peers ELSE b.peers END AS peers, CASE WHEN a.fy IS NOT NULL THEN a.med ELSE b.med END AS med, CASE WHEN a.fy IS NOT NULL THEN a.scale ELSE b.scale END AS scale
FROM (SELECT *, {fy("sanction_date")} AS fy FROM san) s LEFT JOIN ps a ON a.fy = s.fy AND a.state = s.state AND a.activity = s.activity LEFT JOIN ps b ON b.fy = s.fy AND b.state IS NULL AND b.activity = s.activity),
d AS (SELECT *, (ln(1 + sanction_paise / 100.0) - med) / scale AS z, sanction_paise / 100.0 / (exp(med) - 1) AS r FROM c)
SELECT work_key, level, coalesce(peers, 0) AS peers, round(exp(med) - 1, 2) AS median_inr, round(z, 6) AS log_z, round(r, 6) AS cost_ratio, coalesce(z > 3.5 AND r >= 2 AND sanction_paise >= 10000000, FALSE) AS outlier FROM d"""
)
def q_cost_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sanctioned work against earlier years of its state and activity, else of its activity."""
    c = P.cost_benchmark(_priced(spark, sf_dir), "work_key")
    return c.withColumns({"median_inr": F.round("median_inr", 2), "log_z": F.round("log_z", 6), "cost_ratio": F.round("cost_ratio", 6)})


@query(
    _PEERS.replace("sanction_fy < y.fy", "sanction_fy <= '2024-2025'").replace("SELECT DISTINCT sanction_fy AS fy FROM r", "SELECT 'frozen' AS fy")
    + " SELECT state, activity, peers, round(exp(med) - 1, 2) AS median_inr, round(scale, 6) AS scale FROM ps"
)
def q_frozen_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference that is frozen at a cutoff: peers of all years up to it, whatever comes later."""
    peers = P.prior_peers(_priced(spark, sf_dir).where("sanction_fy <= '2024-2025'"), years=["9999-10000"])
    return peers.select("state", "activity", "peers", F.round(F.expm1("med"), 2).alias("median_inr"), F.round("scale", 6).alias("scale"))


_LEVELS = [("0", "a.state IS NOT DISTINCT FROM b.state AND a.activity IS NOT DISTINCT FROM b.activity"), ("1", "a.activity IS NOT DISTINCT FROM b.activity"), ("2", "TRUE")]


@query(
    using("san")
    + ", r AS (SELECT work_key, state, activity, CAST(sanction_paise AS DOUBLE) AS v FROM san WHERE sanction_paise > 0), "
    + ", ".join(f"m{i} AS (SELECT a.work_key, a.v, count(*) AS n, median(b.v) AS med, quantile_cont(b.v, 0.75) - quantile_cont(b.v, 0.25) AS iqr FROM r a JOIN r b ON a.work_key <> b.work_key AND {on} GROUP BY 1, 2)" for i, on in _LEVELS)
    + ", "
    + ", ".join(f"d{i} AS (SELECT a.work_key, median(abs(b.v - m.med)) AS mad FROM r a JOIN m{i} m ON a.work_key = m.work_key JOIN r b ON a.work_key <> b.work_key AND {on} GROUP BY 1)" for i, on in _LEVELS)
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT m.*, mad, {i} AS level FROM m{i} m JOIN d{i} d ON m.work_key = d.work_key" for i, _ in _LEVELS)
    + """), k AS (SELECT *, CASE WHEN mad > 0 THEN 1.4826 * mad WHEN iqr > 0 THEN iqr / 1.349 ELSE greatest(0.1 * med, 1.0) END AS scale FROM u WHERE level = 2 OR n >= 10 QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY level) = 1)
SELECT work_key, level, n AS others, med AS median, round(scale, 4) AS scale, CASE WHEN mad > 0 THEN 'deviations' WHEN iqr > 0 THEN 'quartiles' ELSE 'tenth of the median' END AS method, round((v - med) / scale, 6) AS z, round(v / med, 6) AS ratio FROM k"""
)
def q_peer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work against all others of its state and activity, else of its activity, else of all."""
    out = P.peer_scores(W.sanctioned(spark, sf_dir), "work_key", [["state", "activity"], ["activity"], []], "sanction_paise")
    return out.withColumns({"scale": F.round("scale", 4), "z": F.round("z", 6), "ratio": F.round("ratio", 6)})


@query(
    using("san")
    + """, r AS (SELECT work_key, state, sanction_paise AS x, row_number() OVER (PARTITION BY state ORDER BY sanction_paise, work_key) AS k, count(*) OVER (PARTITION BY state) AS n FROM san WHERE sanction_paise IS NOT NULL AND state IS NOT NULL)
SELECT a.work_key, a.n - 1 AS peers, (lo.x + hi.x) / 2.0 AS median_others FROM r a
JOIN r lo ON lo.state = a.state AND lo.k = CASE WHEN a.k <= (a.n - 2) // 2 + 1 THEN (a.n - 2) // 2 + 2 ELSE (a.n - 2) // 2 + 1 END
JOIN r hi ON hi.state = a.state AND hi.k = CASE WHEN a.k <= (a.n - 1) // 2 + 1 THEN (a.n - 1) // 2 + 2 ELSE (a.n - 1) // 2 + 1 END WHERE a.n >= 11"""
)
def q_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 (one level): the median of all other works of a state, for states with ten others or more."""
    s = W.sanctioned(spark, sf_dir).where("sanction_paise is not null and state is not null").select("work_key", "state", "sanction_paise")
    return leave_one_out(s, "work_key", "state", "sanction_paise", 10)


def leave_one_out(df: DataFrame, key: str, group: str, value: str, least: int) -> DataFrame:
    """``key, peers, median_others``: without a row, the median of its group is one of three neighbours' mean.

    Ranks come from range partitions over all groups and are joined with the three middle ranks of the group, so no
    group is gathered in an array or sorted by one task.
    """
    known = df.select(F.col(key).alias("__key"), F.col(group).alias("__g"), F.col(value).alias("__v"))
    r = staged(R.ranked(known, [F.col("__g"), F.col("__v"), F.col("__key")], "__rank"), "ranks")
    span = r.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), F.min("__rank").alias("__first")).where(F.col("__n") > least)
    r = r.join(span, "__g").withColumn("__k", F.col("__rank") - F.col("__first") + 1)
    lo, hi = F.floor((F.col("__n") - 2) / 2) + 1, F.floor((F.col("__n") - 1) / 2) + 1
    pick = lambda at: F.max(F.when(F.col("__k") == at, F.col("__v")))
    middle = r.groupBy("__g").agg(pick(lo).alias("l0"), pick(lo + 1).alias("l1"), pick(hi).alias("h0"), pick(hi + 1).alias("h1"))
    a = F.when(F.col("__k") <= lo, F.col("l1")).otherwise(F.col("l0"))
    b = F.when(F.col("__k") <= hi, F.col("h1")).otherwise(F.col("h0"))
    return r.join(middle, "__g").select(F.col("__key").alias(key), (F.col("__n") - 1).alias("peers"), ((a + b) / 2.0).alias("median_others"))


# --- Windows ---


_DAYS = using("san") + " SELECT work_key, "
_DATED = " FROM san WHERE recommendation_date IS NOT NULL AND ida IS NOT NULL"


@query(_DAYS + "count(*) OVER w AS earlier, CAST(coalesce(sum(sanction_paise) OVER w, 0) AS BIGINT) AS earlier_known, CASE WHEN count(*) OVER w = count(sanction_paise) OVER w THEN CAST(coalesce(sum(sanction_paise) OVER w, 0) AS BIGINT) END AS earlier_if_known" + _DATED + " WINDOW w AS (PARTITION BY ida ORDER BY recommendation_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def q_prior_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authority's works of strictly earlier days, counted and summed."""
    s = W.sanctioned(spark, sf_dir).where("recommendation_date is not null and ida is not null")
    return R.prior_by_day(s, "ida", "recommendation_date", "sanction_paise").select("work_key", "earlier", "earlier_known", "earlier_if_known")


@query(_DAYS + "count(*) OVER w AS in_90_days" + _DATED + " WINDOW w AS (PARTITION BY ida ORDER BY recommendation_date RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def q_trailing_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authority's works of the 90 days before."""
    s = W.sanctioned(spark, sf_dir).where("recommendation_date is not null and ida is not null")
    return R.prior_by_day(s, "ida", "recommendation_date", "sanction_paise", 90).select("work_key", F.col("earlier").alias("in_90_days"))


@query(using("san") + ", d AS (SELECT DISTINCT ida, recommendation_date AS d FROM san WHERE ida IS NOT NULL AND recommendation_date IS NOT NULL) SELECT ida, d, lag(d) OVER (PARTITION BY ida ORDER BY d) AS before, CAST(d - lag(d) OVER (PARTITION BY ida ORDER BY d) AS INTEGER) AS gap_days FROM d")
def q_lag_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since an authority's previous day with a recommendation."""
    d = W.sanctioned(spark, sf_dir).where("ida is not null and recommendation_date is not null").select("ida", F.col("recommendation_date").alias("d")).distinct()
    before = F.lag("d").over(Window.partitionBy("ida").orderBy("d"))
    return d.withColumn("before", before).withColumn("gap_days", F.date_diff("d", "before"))


@query(using("san") + " SELECT work_key, round((rank() OVER (ORDER BY sanction_paise) + (count(*) OVER (PARTITION BY sanction_paise) - 1) / 2.0) * 100.0 / count(*) OVER (), 6) AS percentile FROM san WHERE sanction_paise IS NOT NULL")
def q_pct_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile rank with average ties."""
    s = W.sanctioned(spark, sf_dir).where("sanction_paise is not null").select("work_key", "sanction_paise")
    return R.percent_rank_avg(s, "sanction_paise", "p").select("work_key", F.round("p", 6).alias("percentile"))


@query(using("san") + " SELECT ida, work_key, sanction_paise FROM san WHERE ida IS NOT NULL AND sanction_paise IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ida ORDER BY sanction_paise DESC, work_key) <= 3")
def q_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authority's three largest works."""
    s = W.sanctioned(spark, sf_dir).where("ida is not null and sanction_paise is not null").select("ida", "work_key", "sanction_paise")
    return R.top_per_group(s, ["ida"], [F.col("sanction_paise").desc(), F.col("work_key")], 3)


@query(using("san") + " SELECT work_key, CAST(row_number() OVER (ORDER BY sanction_paise DESC, work_key) AS INTEGER) AS place FROM san WHERE sanction_paise IS NOT NULL QUALIFY row_number() OVER (ORDER BY sanction_paise DESC, work_key) <= ceil(0.1 * count(*) OVER ()) AND sanction_paise > 0")
def q_rank_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tenth of all works in a total order."""
    s = W.sanctioned(spark, sf_dir).where("sanction_paise is not null").select("work_key", "sanction_paise")
    budget = -(-s.count() // 10)
    return R.ranked(s, [F.col("sanction_paise").desc(), F.col("work_key")], "place").where((F.col("place") <= budget) & (F.col("sanction_paise") > 0)).select("work_key", "place")


@query("SELECT record_id, copies, copies > 1 AS any_copy, record_id > first_record AS is_repeat FROM (SELECT record_id, count(*) OVER k AS copies, min(record_id) OVER k AS first_record FROM expenditure WINDOW k AS (PARTITION BY " + ", ".join(W.KINDS) + "))")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are of a row's kind, whether there are others, and whether one is earlier."""
    return W.payments_with_repeats(spark, sf_dir).select("record_id", "copies", (F.col("copies") > 1).alias("any_copy"), "is_repeat")


@query("SELECT cohort, work_recommendation_dtl_id, record_id, recommended_amount FROM works_recommended WHERE work_recommendation_dtl_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cohort, work_recommendation_dtl_id ORDER BY record_id DESC) = 1")
def q_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each id as typed, whatever its amount."""
    t = table(spark, sf_dir, "works_recommended").where("work_recommendation_dtl_id is not null").select("cohort", "work_recommendation_dtl_id", "record_id", "recommended_amount")
    return R.latest(t, ["cohort", "work_recommendation_dtl_id"], ["record_id"])


_MONTHS = using("pay") + ", m AS (SELECT strftime(paid_on, '%Y-%m') AS month, CAST(sum(paise) AS BIGINT) AS paise FROM pay WHERE is_success AND paid_on IS NOT NULL GROUP BY 1)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.payments(spark, sf_dir).where("is_success and paid_on is not null")
    return p.groupBy(month_of(F.col("paid_on")).alias("month")).agg(F.sum("paise").alias("paise"))


@query(
    using("pay")
    + ", m AS (SELECT vendor, strftime(paid_on, '%Y-%m') AS month, CAST(sum(paise) AS BIGINT) AS paise FROM pay WHERE is_success AND paid_on IS NOT NULL AND vendor IS NOT NULL GROUP BY 1, 2) SELECT vendor, month, paise, lead(month) OVER w AS following FROM m WINDOW w AS (PARTITION BY vendor ORDER BY month) QUALIFY lead(month) OVER w <> strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')"
)
def q_gap_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a vendor after which a month without payments follows, but a later one with some."""
    p = W.payments(spark, sf_dir).where("is_success and paid_on is not null and vendor is not null")
    months = p.groupBy("vendor", month_of(F.col("paid_on")).alias("month")).agg(F.sum("paise").alias("paise"))
    return R.month_gaps(months, "month", ["vendor"])


@query(_MONTHS + " SELECT month, lag(paise) OVER (ORDER BY month) AS last_value, round(avg(paise) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 3) AS mean3, strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS next_month FROM m")
def q_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value and mean of three before each month (months are few)."""
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    return _months(spark, sf_dir).select("month", F.lag("paise").over(w).alias("last_value"), F.round(F.avg("paise").over(w.rowsBetween(-3, -1)), 3).alias("mean3"), next_month(F.col("month")).alias("next_month"))


@query(using("pay") + ", c AS (SELECT state, vendor, count(*) AS copies FROM pay WHERE vendor IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(copies) OVER (PARTITION BY state ORDER BY copies DESC, vendor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT state, vendor, CAST(least(copies, greatest(0, 100 - before)) AS BIGINT) AS taken FROM b WHERE before < 100")
def q_bounded_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred payments of each state, taken vendor by vendor with their multiplicity."""
    c = W.payments(spark, sf_dir).where("vendor is not null and state is not null").groupBy("state", "vendor").agg(F.count(F.lit(1)).alias("copies"))
    w = Window.partitionBy("state").orderBy(F.col("copies").desc(), "vendor").rowsBetween(Window.unboundedPreceding, -1)
    b = c.withColumn("before", F.coalesce(F.sum("copies").over(w), F.lit(0))).where("before < 100")
    return b.select("state", "vendor", F.least("copies", F.greatest(F.lit(0), 100 - F.col("before"))).alias("taken"))


# --- Projections, filters and flags ---


_FLAGS = f"""f AS (SELECT work_key,
  coalesce(sanction_date - recommendation_date > 45, FALSE) AS slow, coalesce(is_sanctioned AND sanction_date + INTERVAL 1 YEAR < DATE '{AS_OF}' AND last_success IS NULL, FALSE) AS unpaid_year,
  coalesce(paid_paise - sanction_paise > greatest(1000000.0, 0.02 * sanction_paise), FALSE) AS over_paid, any_repeat AS repeated,
  coalesce(paid_paise > 0 AND march_paise > 0 AND CAST(march_paise AS DOUBLE) / paid_paise >= 0.8, FALSE) AS march, NOT is_recommended AS unannounced FROM full_wk)"""
#: Example weights of the rule engine; callers give their own.
WEIGHTS = {"slow": 8, "unpaid_year": 20, "over_paid": 30, "repeated": 15, "march": 8, "unannounced": 5}
EDGES = [(0, "none"), (19, "low"), (39, "medium")]


def flagged(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """Works with example flags and the columns to ``keep``; comparisons with nulls are false."""
    w = W.works_with_payments(spark, sf_dir, repeats=True)
    sure = lambda c: F.coalesce(c, F.lit(False))
    return w.select(
        "work_key",
        *keep,
        sure(F.date_diff("sanction_date", "recommendation_date") > 45).alias("slow"),
        sure(F.col("is_sanctioned") & (F.add_months("sanction_date", 12) < F.lit(AS_OF).cast("date")) & F.col("last_success").isNull()).alias("unpaid_year"),
        sure(F.col("paid_paise") - F.col("sanction_paise") > material(F.col("sanction_paise"), 1_000_000, 0.02)).alias("over_paid"),
        F.col("any_repeat").alias("repeated"),
        sure((F.col("paid_paise") > 0) & (F.col("march_paise") > 0) & (ratio(F.col("march_paise"), F.col("paid_paise")) >= 0.8)).alias("march"),
        (~F.col("is_recommended")).alias("unannounced"),
    )


_SCORE = "least(100, " + " + ".join(f"CAST({k} AS INTEGER) * {v}" for k, v in WEIGHTS.items()) + ")"


def _points():
    return sum((F.col(k).cast("int") * v for k, v in WEIGHTS.items()), F.lit(0))


@query(using("full_wk") + f", {_FLAGS} SELECT work_key, {_SCORE} AS score, concat_ws(';', " + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in WEIGHTS) + ") AS reasons FROM f")
def q_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted flags, capped, with their names."""
    return flagged(spark, sf_dir).select("work_key", F.least(F.lit(100), _points()).alias("score"), listed_reasons([(k, F.col(k)) for k in WEIGHTS]).alias("reasons"))


@query(using("full_wk") + f", {_FLAGS} " + " UNION ALL ".join(f"SELECT work_key, '{k}' AS rule, {v} AS points FROM f WHERE {k}" for k, v in WEIGHTS.items()))
def q_unpivot_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each true flag of a work."""
    parts = F.array_compact(F.array(*[F.when(F.col(k), F.struct(F.lit(k).alias("rule"), F.lit(v).alias("points"))) for k, v in WEIGHTS.items()]))
    return flagged(spark, sf_dir).select("work_key", F.inline(parts))


@query(using("full_wk") + f", {_FLAGS} SELECT CASE WHEN s <= 0 THEN 'none' WHEN s <= 19 THEN 'low' WHEN s <= 39 THEN 'medium' ELSE 'high' END AS band, count(*) AS works FROM (SELECT {_SCORE} AS s FROM f) GROUP BY 1")
def q_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of the score."""
    return flagged(spark, sf_dir).groupBy(binned(F.least(F.lit(100), _points()), EDGES, "high").alias("band")).agg(F.count(F.lit(1)).alias("works"))


@query(using("san") + " SELECT work_key, (CAST(year(sanction_date - INTERVAL 3 MONTH) AS VARCHAR) || '-' || CAST(year(sanction_date - INTERVAL 3 MONTH) + 1 AS VARCHAR)) AS fy, CAST(quarter(sanction_date - INTERVAL 3 MONTH) AS INTEGER) AS fq, month(sanction_date) = 3 AND day(sanction_date) >= 2 AS at_year_end, CAST(sanction_date + INTERVAL 3 MONTH AS DATE) AS in_3_months, CAST(sanction_date + INTERVAL 1 YEAR AS DATE) AS in_a_year FROM san WHERE sanction_date IS NOT NULL")
def q_fiscal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fiscal dates and calendar steps."""
    d = F.col("sanction_date")
    return W.sanctioned(spark, sf_dir).where(d.isNotNull()).select("work_key", fiscal_year(d).alias("fy"), fiscal_quarter(d).alias("fq"), last_days_of_fiscal_year(d).alias("at_year_end"), F.add_months(d, 3).alias("in_3_months"), F.add_months(d, 12).alias("in_a_year"))


@query(using("full_wk") + " SELECT work_key, round(paid_ratio, 6) AS paid_ratio, CASE WHEN recommended_paise > 0 THEN round(CAST(sanction_paise AS DOUBLE) / recommended_paise, 6) END AS sanction_ratio FROM full_wk")
def q_guarded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios without a denominator are null."""
    return W.works_with_payments(spark, sf_dir).select("work_key", F.round("paid_ratio", 6).alias("paid_ratio"), F.round(ratio(F.col("sanction_paise"), F.col("recommended_paise")), 6).alias("sanction_ratio"))


@query(using("wk") + " SELECT work_key FROM wk WHERE (description ILIKE '%road%' OR ida ILIKE '%road%' OR activity ILIKE '%road%') AND cohort = 'lok_sabha' AND sanction_fy IN ('2024-2025', '2025-2026')")
def q_search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctive filters and a search over several columns."""
    w = W.works(spark, sf_dir).where((F.col("cohort") == "lok_sabha") & F.col("sanction_fy").isin("2024-2025", "2025-2026"))
    return R.searched(w, "road", ["description", "ida", "activity"]).select("work_key")


@query("SELECT vendor_id FROM vendor_features WHERE concat_ws('|', vendor_id, vendor_name, CAST(payment_row_count AS VARCHAR), CAST(successful_paise AS VARCHAR), CAST(first_payment_date AS VARCHAR)) ILIKE '%2024-1%' OR vendor_name ILIKE '%50\\%%' ESCAPE '\\'")
def q_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over every column as text."""
    v = table(spark, sf_dir, "vendor_features")
    columns = ["vendor_id", "vendor_name", "payment_row_count", "successful_paise", "first_payment_date"]
    return R.searched(v, "2024-1", columns).select("vendor_id").union(R.searched(v, "50%", ["vendor_name"]).select("vendor_id")).distinct()


@query(using("full_wk") + " SELECT work_key, paid_paise FROM full_wk ORDER BY paid_paise DESC NULLS LAST, work_key LIMIT 50 OFFSET 100")
def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty."""
    return R.paged(W.works_with_payments(spark, sf_dir).select("work_key", "paid_paise"), [F.col("paid_paise").desc(), F.col("work_key")], 50, 100)


@query(using("pay") + " SELECT vendor, count(*) AS rows, CAST(sum(paise) AS BIGINT) AS paise FROM pay WHERE vendor IS NOT NULL GROUP BY vendor ORDER BY (count(DISTINCT work_key) >= 3 AND sum(paise) >= 500000000) DESC, sum(paise) DESC NULLS LAST, vendor LIMIT 30")
def q_material_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order whose first key is a condition."""
    v = W.payments(spark, sf_dir).where("vendor is not null").groupBy("vendor").agg(F.count(F.lit(1)).alias("rows"), F.sum("paise").alias("paise"), F.count_distinct("work_key").alias("works"))
    return v.orderBy(((F.col("works") >= 3) & F.coalesce(F.col("paise") >= 500_000_000, F.lit(False))).desc(), F.col("paise").desc_nulls_last(), "vendor").limit(30).drop("works")


# --- Set operations ---


@query(using("rec", "san") + " SELECT DISTINCT work_key FROM (SELECT work_key FROM rec UNION ALL SELECT work_key FROM san)")
def q_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of either export."""
    return W.recommended(spark, sf_dir).select("work_key").union(W.sanctioned(spark, sf_dir).select("work_key")).distinct()


@query(using("rec", "san") + " SELECT work_key FROM rec INTERSECT SELECT work_key FROM san")
def q_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of both exports."""
    return W.recommended(spark, sf_dir).select("work_key").intersect(W.sanctioned(spark, sf_dir).select("work_key"))


@query(using("rec", "san") + " SELECT work_key FROM san EXCEPT SELECT work_key FROM rec")
def q_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the sanctioned export alone."""
    return W.sanctioned(spark, sf_dir).select("work_key").exceptAll(W.recommended(spark, sf_dir).select("work_key"))


@query(using("rec") + " SELECT coalesce(a.cohort, b.cohort) AS cohort, CASE WHEN b.cohort IS NULL THEN 'missing' ELSE 'unknown' END AS side FROM (SELECT unnest(['lok_sabha', 'rs_sitting', 'rs_retired', 'rs_former']) AS cohort) a FULL OUTER JOIN (SELECT DISTINCT cohort FROM rec) b ON a.cohort = b.cohort WHERE a.cohort IS NULL OR b.cohort IS NULL")
def q_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing from, or unknown to, the agreed scope."""
    agreed = spark.createDataFrame([(c,) for c in ("lok_sabha", "rs_sitting", "rs_retired", "rs_former")], "cohort string")
    return R.same_members(agreed, W.recommended(spark, sf_dir).select("cohort"), "cohort")


@query(using("full_wk") + ", a AS (SELECT work_key FROM full_wk ORDER BY coalesce(sanction_paise, -1) DESC, work_key LIMIT 200), b AS (SELECT work_key FROM full_wk ORDER BY paid_paise DESC, work_key LIMIT 200) SELECT count(*) FILTER (WHERE a.work_key IS NOT NULL AND b.work_key IS NOT NULL) AS shared, count(*) AS either, round(CAST(count(*) FILTER (WHERE a.work_key IS NOT NULL AND b.work_key IS NOT NULL) AS DOUBLE) / count(*), 6) AS jaccard FROM a FULL OUTER JOIN b ON a.work_key = b.work_key")
def q_jaccard_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two queues of 200 agree."""
    w = W.works_with_payments(spark, sf_dir)
    top = lambda c, mark: w.select("work_key", c.alias("v")).orderBy(F.col("v").desc(), "work_key").limit(200).select("work_key", F.lit(True).alias(mark))
    m = top(F.coalesce("sanction_paise", F.lit(-1)), "a").join(top(F.col("paid_paise"), "b"), "work_key", "full_outer")
    m = m.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("either"))
    return m.withColumn("jaccard", F.round(ratio(F.col("shared"), F.col("either")), 6))


@query(using("wk") + " SELECT DISTINCT state, sanction_fy FROM wk")
def q_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that filters offer."""
    return W.works(spark, sf_dir).select("state", "sanction_fy").distinct()
