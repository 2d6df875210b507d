"""The works ledger: typed exports, one row for each work, payments and what is summed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import fingerprint, fiscal_year, month_of, ratio
from ledgerloom.functions.values import amount_paise, code_key, date_of, number_key, stripped
from ledgerloom.operators.relational import merged_outer
from ledgerloom.sources.tables import table


def _blank_to_null(name: str):
    return F.nullif(stripped(F.col(name)), F.lit(""))


def typed_export(df: DataFrame) -> DataFrame:
    """A recommended or sanctioned export with typed columns, one row for each work: the earliest record.

    The key is the cohort and the id as a whole number; rows without an id are no works. Repeated records are reduced
    by a grouped minimum before the shuffle.
    """
    typed = df.select(
        F.concat_ws(":", "cohort", number_key(F.col("work_recommendation_dtl_id"))).alias("work_key"),
        "record_id",
        "cohort",
        F.upper(_blank_to_null("state_name")).alias("state"),
        F.upper(_blank_to_null("ida_name")).alias("ida"),
        stripped(F.col("work_description")).alias("description"),
        amount_paise(F.col("recommended_amount")).alias("recommended_paise"),
        amount_paise(F.col("sanction_amount")).alias("sanction_paise"),
        date_of(F.col("recommendation_date")).alias("recommendation_date"),
        date_of(F.col("sanction_date")).alias("sanction_date"),
        _blank_to_null("work_stage").alias("stage"),
        F.nullif(F.regexp_extract("activity_name", r"^WS/ *MP(\d+)/", 1), F.lit("")).alias("profile"),
        F.nullif(F.trim(F.regexp_replace("activity_name", r"^WS/ *MP\d+/\d{4}-\d{4}/\d+-", "")), F.lit("")).alias("activity"),
        number_key(F.col("work_recommendation_dtl_id")).isNotNull().alias("__has_id"),
    ).where("__has_id")
    rest = [c for c in typed.columns if c not in ("work_key", "__has_id")]
    return typed.groupBy("work_key").agg(F.min_by(F.struct(*rest), F.col("record_id")).alias("__row")).select("work_key", "__row.*")


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommended works."""
    return typed_export(table(spark, sf_dir, "works_recommended"))


def sanctioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanctioned works."""
    return typed_export(table(spark, sf_dir, "works_sanctioned"))


def works(spark: SparkSession, sf_dir: str, cohorts: Sequence[str] = ()) -> DataFrame:
    """One row for each work of either export; the sanctioned side's values win (``in_first``: sanctioned).

    ``cohorts`` keeps works of these only. The cohort is part of the key, so both scans are filtered before the join.
    """
    sides = [table(spark, sf_dir, name) for name in ("works_sanctioned", "works_recommended")]
    if cohorts:
        sides = [side.where(F.col("cohort").isin(list(cohorts))) for side in sides]
    merged = merged_outer(typed_export(sides[0]), typed_export(sides[1]), ["work_key"])
    return merged.withColumnsRenamed({"in_first": "is_sanctioned", "in_second": "is_recommended"}).withColumn("sanction_fy", fiscal_year(F.col("sanction_date")))


#: What makes two payment rows repeats of each other, as typed.
KINDS = ["cohort", "work_recommendation_dtl_id", "vendor_id", "vendor_name", "ia_name", "work_status", "work_id", "expenditure_date", "fund_disbursed_amt"]


def payments(spark: SparkSession, sf_dir: str, fields: Sequence[str] = ()) -> DataFrame:
    """The payment ledger, typed; every accepted row stays, repeats too. ``fields``: columns as typed to keep besides."""
    return table(spark, sf_dir, "expenditure").select(
        "record_id",
        "cohort",
        F.when(number_key(F.col("work_recommendation_dtl_id")).isNotNull(), F.concat_ws(":", "cohort", number_key(F.col("work_recommendation_dtl_id")))).alias("work_key"),
        code_key(F.col("vendor_id")).alias("vendor"),
        _blank_to_null("vendor_name").alias("vendor_name"),
        _blank_to_null("ia_name").alias("agency"),
        F.upper(_blank_to_null("state_name")).alias("state"),
        F.upper(_blank_to_null("ida_name")).alias("ida"),
        date_of(F.col("expenditure_date")).alias("paid_on"),
        amount_paise(F.col("fund_disbursed_amt")).alias("paise"),
        F.coalesce(F.col("work_status") == "Payment Success", F.lit(False)).alias("is_success"),
        *fields,
    )


def payments_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with ``copies``, the rows of a row's kind, and ``is_repeat``: not the first of them.

    Only for queries that ask for repeats. First rows and counts of kinds are combined before the shuffle, and the rows
    are joined to them again, so a kind with very many copies isn't gathered.
    """
    typed = payments(spark, sf_dir, [fingerprint([F.col(c) for c in KINDS]).alias("fingerprint")])
    kinds = typed.groupBy("fingerprint").agg(F.min("record_id").alias("first_record"), F.count(F.lit(1)).alias("copies"))
    return typed.join(kinds, "fingerprint").withColumn("is_repeat", F.col("record_id") > F.col("first_record")).drop("first_record")


def ledger_by_work(pay: DataFrame, repeats: bool = True) -> DataFrame:
    """Payments summed for each work, before any join; so amounts can't multiply. Without ``repeats`` what counts them
    is left out, and ``pay`` needs no column of them."""
    ok = F.col("is_success")
    counted = [F.count_if("is_repeat").alias("repeat_rows"), F.bool_or("is_repeat").alias("any_repeat")] if repeats else []
    return (
        pay.where(F.col("work_key").isNotNull())
        .groupBy("work_key")
        .agg(
            F.count(F.lit(1)).alias("payment_rows"),
            F.count_if(ok).alias("success_rows"),
            F.coalesce(F.sum(F.when(ok, F.col("paise"))), F.lit(0)).alias("paid_paise"),
            F.coalesce(F.sum(F.when(~ok, F.col("paise"))), F.lit(0)).alias("pending_paise"),
            F.count_distinct("vendor").alias("vendors"),
            F.min("paid_on").alias("first_payment"),
            F.max("paid_on").alias("last_payment"),
            F.min(F.when(ok, F.col("paid_on"))).alias("first_success"),
            F.max(F.when(ok, F.col("paid_on"))).alias("last_success"),
            F.coalesce(F.sum(F.when(ok & (F.month("paid_on") == 3), F.col("paise"))), F.lit(0)).alias("march_paise"),
            *counted,
            F.count_distinct(month_of(F.col("paid_on"))).alias("months"),
        )
    )


def works_with_payments(spark: SparkSession, sf_dir: str, cohorts: Sequence[str] = (), repeats: bool = False) -> DataFrame:
    """Works with their summed payments: counts and sums are zero without payments, ratios null.

    ``repeats`` adds ``repeat_rows`` and ``any_repeat``, which cost a second pass over the ledger; ``cohorts`` filters
    all three scans.
    """
    pay = (payments_with_repeats if repeats else payments)(spark, sf_dir)
    if cohorts:
        pay = pay.where(F.col("cohort").isin(list(cohorts)))
    sums = ledger_by_work(pay, repeats)
    zero = {c: F.coalesce(c, F.lit(0)) for c, kind in sums.dtypes if kind == "bigint"}
    if repeats:
        zero["any_repeat"] = F.coalesce("any_repeat", F.lit(False))
    joined = works(spark, sf_dir, cohorts).join(sums, "work_key", "left").withColumns(zero)
    return joined.withColumn("paid_ratio", F.when(F.col("success_rows") > 0, ratio(F.col("paid_paise"), F.col("sanction_paise"))))
