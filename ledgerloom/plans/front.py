"""Queries of the front door and of streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ascii_norm, binned, ratio
from ledgerloom.operators import works as W
from ledgerloom.operators.peers import cost_benchmark
from ledgerloom.operators.relational import concentration, latest
from ledgerloom.operators.similar_works import similar_pairs
from ledgerloom.plans.analysis import _PAIRS, _SIMILAR, _WORDS, q_weighted_jaccard_pairs
from ledgerloom.plans.ledger import _FLAGS, _PEERS, _SCORE, AS_OF, EDGES, WEIGHTS, _points, flagged, q_rule_scores, q_unpivot_contrib
from ledgerloom.plans.sql import fy, using
from ledgerloom.query import listing as L
from ledgerloom.query.questions import MEASURES, Answer, Choice, Intent, Refusal, asked, states_in, understood
from ledgerloom.query.reviews import open_cases
from ledgerloom.session import shared_path, staged
from ledgerloom.sources.exports import read_sqlite, write_csv_file, write_sqlite, write_workbook
from ledgerloom.sources.files import ContractError, WorkbookSource
from ledgerloom.sources.records import read_split_export, stream_digest
from ledgerloom.sources.tables import table
from ledgerloom.streaming import events as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL if there is any."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_LISTED = " FROM full_wk WHERE cohort IN ('rs_sitting', 'rs_retired') AND is_sanctioned AND (work_key ILIKE '%hall%' OR description ILIKE '%hall%' OR ida ILIKE '%hall%' OR activity ILIKE '%hall%')"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.WORKS.filtered(W.works_with_payments(spark, sf_dir, ["rs_sitting", "rs_retired"]), {"cohort": ["rs_sitting", "rs_retired"]}, "is_sanctioned", "hall")


@query(using("full_wk") + " SELECT work_key, state, sanction_paise, paid_paise" + _LISTED + " ORDER BY sanction_paise DESC NULLS LAST, work_key LIMIT 25 OFFSET 25")
def q_works_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of filtered works."""
    return L.WORKS.page(_listed(spark, sf_dir), "sanction_paise", True, 25, 25).select("work_key", "state", "sanction_paise", "paid_paise")


@query(using("full_wk") + " SELECT count(*) AS rows, CAST(sum(sanction_paise) AS BIGINT) AS sanction_paise, CAST(sum(paid_paise) AS BIGINT) AS paid_paise, CAST(sum(pending_paise) AS BIGINT) AS pending_paise" + _LISTED)
def q_works_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals beside the page."""
    return L.WORKS.summary(_listed(spark, sf_dir))


@query(using("full_wk") + " SELECT coalesce(sanction_fy, 'Not recorded') AS fy, count(*) AS works, CAST(sum(sanction_paise) AS BIGINT) AS sanction_paise, CAST(sum(paid_paise) AS BIGINT) AS paid_paise FROM full_wk WHERE state = 'MADHUVAN' GROUP BY 1")
def q_entity_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state's works by year."""
    return L.entity_years(W.works_with_payments(spark, sf_dir), "state", "MADHUVAN")


@query(using("full_wk") + " SELECT work_key, state, paid_paise FROM full_wk WHERE work_key IN (SELECT work_key FROM pay WHERE vendor = 'V00000002')")
def q_vendor_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor's works."""
    return L.vendor_works(W.works_with_payments(spark, sf_dir), W.payments(spark, sf_dir), "V00000002").select("work_key", "state", "paid_paise")


#: What the measures of questions need beyond works and payments: SQL over works, payments and flags, and over models.
_MEASURED = f"""SELECT w.*, f.slow, f.over_paid, f.march, {_SCORE} AS score, CASE WHEN {_SCORE} <= 0 THEN 'none' WHEN {_SCORE} <= 19 THEN 'low' WHEN {_SCORE} <= 39 THEN 'medium' ELSE 'high' END AS band,
  coalesce(is_sanctioned AND stage = 'Work Completed', FALSE) AS is_completed, coalesce(is_sanctioned AND stage <> 'Work Completed' AND sanction_date + INTERVAL 1 YEAR < DATE '{AS_OF}', FALSE) AS open_over_year,
  coalesce(is_sanctioned AND payment_rows = 0 AND sanction_date + INTERVAL 3 MONTH < DATE '{AS_OF}', FALSE) AS unpaid_3_months, coalesce(NOT is_sanctioned AND DATE '{AS_OF}' - recommendation_date > 45, FALSE) AS pending_45_days,
  coalesce(is_sanctioned AND stage = 'Work Completed' AND payment_rows = 0, FALSE) AS completed_unpaid FROM full_wk w JOIN f ON w.work_key = f.work_key"""
_MW = using("full_wk") + f", {_FLAGS}, mw AS ({_MEASURED})"


def measured(spark: SparkSession, sf_dir: str, dear: bool = False, alike: bool = False) -> DataFrame:
    """Works with everything that a question may measure; cost outliers and similar works only if they are asked for."""
    kept = "cohort state ida profile activity stage sanction_fy sanction_date recommendation_date is_sanctioned is_recommended sanction_paise recommended_paise paid_paise pending_paise payment_rows success_rows any_repeat description".split()
    w = flagged(spark, sf_dir, kept)
    today, done, sure = F.lit(AS_OF).cast("date"), F.col("stage") == "Work Completed", lambda c: F.coalesce(c, F.lit(False))
    score = F.least(F.lit(100), _points())
    w = w.withColumns({
        "score": score,
        "band": binned(score, EDGES, "high"),
        "is_completed": sure(F.col("is_sanctioned") & done),
        "open_over_year": sure(F.col("is_sanctioned") & ~done & (F.add_months("sanction_date", 12) < today)),
        "unpaid_3_months": sure(F.col("is_sanctioned") & (F.col("payment_rows") == 0) & (F.add_months("sanction_date", 3) < today)),
        "pending_45_days": sure(~F.col("is_sanctioned") & (F.date_diff(today, "recommendation_date") > 45)),
        "completed_unpaid": sure(F.col("is_sanctioned") & done & (F.col("payment_rows") == 0)),
    })
    if dear:
        priced = w.where("is_sanctioned").select("work_key", "state", "activity", "sanction_fy", F.col("sanction_paise").alias("paise"))
        outliers = cost_benchmark(priced, "work_key").where("outlier").select("work_key", F.lit(True).alias("cost_outlier"))
        w = w.join(outliers, "work_key", "left").withColumn("cost_outlier", sure(F.col("cost_outlier")))
    if alike:
        texts = w.where("is_sanctioned").select("work_key", "ida", "activity", ascii_norm(F.col("description")).alias("text"), "sanction_paise")
        high = similar_pairs(texts, "work_key", ["ida", "activity"], "text", "sanction_paise").where("high")
        ends = high.select(F.explode(F.array("a", "b")).alias("work_key")).distinct().withColumn("has_similar", F.lit(True))
        w = w.join(ends, "work_key", "left").withColumn("has_similar", sure(F.col("has_similar")))
    return w


def answered(spark: SparkSession, sf_dir: str, question: str, names: DataFrame | None = None) -> Answer | Choice | Refusal:
    """Answer a question from the tables of a folder: state names come from the exports alone, and only models that the
    question needs are run."""
    states = reduce(DataFrame.union, [table(spark, sf_dir, t).select(F.upper(F.trim("state_name")).alias("state")) for t in ("works_recommended", "works_sanctioned")]).distinct()
    intent = understood(question, states_in(question, states))
    needs = MEASURES[intent.measure].needs if isinstance(intent, Intent) else None
    return asked(question, measured(spark, sf_dir, needs == "cost_outlier", needs == "has_similar"), W.payments(spark, sf_dir), states, names)


def _told(question: str, sql: str):
    """Register the answer to a question as a query, with the SQL that the question should become."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            answer = answered(spark, sf_dir, question)
            if not isinstance(answer, Answer):
                raise ValueError(f"{question}: {answer}")
            money = [c for c, kind in answer.rows.dtypes if c == "value" and kind == "double"]
            return answer.rows.withColumns({c: F.round(c, 6) for c in money})

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__], SQL[fn.__name__] = run, sql
        return run

    return add


_BY = "SELECT {0} AS name, count(*) AS works, {1} AS value FROM mw WHERE {2} GROUP BY 1{3} ORDER BY value {4}, works DESC, name LIMIT {5}"
_MANY, _FEW = "DESC NULLS LAST", "ASC NULLS FIRST"


@_told("Top 5 states by pending payments in 2024-25", _MW + _BY.format("state", "CAST(sum(pending_paise) AS BIGINT)", "state IS NOT NULL AND sanction_fy = '2024-2025'", "", _MANY, 5))
def q_nl_ask():
    """Q10-Q14, Q18: a ranking with a filter and a limit."""


@_told("How many works were sanctioned in Madhuvan?", _MW + " SELECT count(*) AS works, count(*) FILTER (WHERE is_sanctioned) AS value FROM mw WHERE state = 'MADHUVAN'")
def q_nl_total():
    """Q14: one figure."""


@_told("worst five states by utilisation", _MW + _BY.format("state", "round(CAST(sum(paid_paise) AS DOUBLE) / nullif(sum(sanction_paise), 0), 6)", "state IS NOT NULL", " HAVING count(*) >= 20", _FEW, 5))
def q_nl_worst():
    """Of a share of which more is better the worst come first; groups of 20 works and more."""


@_told("Which districts in Madhuvan have the most delays?", _MW + _BY.format("ida", "count(*) FILTER (WHERE open_over_year)", "ida IS NOT NULL AND state = 'MADHUVAN'", " HAVING count(*) FILTER (WHERE open_over_year) > 0", _MANY, 10))
def q_nl_districts():
    """Q12, Q13: groups within a state."""


@_told("average sanctioned amount in the upper house by financial year", _MW + _BY.format("sanction_fy", "round(avg(sanction_paise), 6)", "sanction_fy IS NOT NULL AND cohort IN ('rs_sitting', 'rs_retired')", " HAVING count(*) >= 20", _MANY, 10))
def q_nl_house():
    """Q13: a house is two cohorts."""


@_told("completed works without payment by priority band", _MW + _BY.format("band", "count(*) FILTER (WHERE completed_unpaid)", "band IS NOT NULL", " HAVING count(*) FILTER (WHERE completed_unpaid) > 0", _MANY, 10))
def q_nl_band():
    """Q12: bands of the score."""


@_told("top 7 vendors by payments", using("pay") + " SELECT vendor AS name, count(*) AS works, CAST(sum(CASE WHEN is_success THEN paise ELSE 0 END) AS BIGINT) AS value FROM pay WHERE vendor IS NOT NULL GROUP BY vendor ORDER BY value DESC NULLS LAST, works DESC, name LIMIT 7")
def q_nl_vendors():
    """Q16: the path of vendors, over payments."""


@_told("pending payments by month in Madhuvan", using("pay") + " SELECT strftime(paid_on, '%Y-%m') AS name, count(*) AS works, CAST(sum(CASE WHEN is_success THEN 0 ELSE paise END) AS BIGINT) AS value FROM pay WHERE paid_on IS NOT NULL AND state = 'MADHUVAN' GROUP BY 1 ORDER BY value DESC NULLS LAST, works DESC, name LIMIT 10")
def q_nl_months():
    """Q16: the path of months, over payments."""


_REFUSED = [
    ("which states are corrupt", "refused"), ("predict payments in 2027", "refused"), ("colour of the sky", "refused"), ("vendors by payments in Madhuvan", "refused"), ("works in 2024-29", "refused"), ("works by month", "refused"),
    ("cost overruns by state", "refused"), ("top districts by repeated payments in 1999", "answered"), ("similar works by district", "answered"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{a}')" for q, a in _REFUSED) + ") AS t(question, outcome)")
def q_nl_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15, Q17: what is refused; cost overruns need amounts at completion, which these tables lack."""
    states = [r[0] for r in table(spark, sf_dir, "works_sanctioned").select(F.upper(F.trim("state_name"))).where("state_name in ('Madhuvan')").distinct().collect()]
    columns = {m.needs for m in MEASURES.values()} - {None, "completion_over_sanction"}
    said = [(q, "refused" if isinstance(understood(q, states, columns), Refusal) else "answered") for q, _ in _REFUSED]
    return spark.createDataFrame(said, "question string, outcome string")


_ALL = {
    "sanction_paise": "CAST(sum(sanction_paise) AS BIGINT)", "paid_paise": "CAST(sum(paid_paise) AS BIGINT)", "pending_paise": "CAST(sum(pending_paise) AS BIGINT)", "mean_sanction": "round(avg(sanction_paise), 4)", "mean_score": "round(avg(score), 6)",
    "paid_share": "round(CAST(sum(paid_paise) AS DOUBLE) / nullif(sum(sanction_paise), 0), 6)", "completed_share": "round(CAST(count(*) FILTER (WHERE is_completed) AS DOUBLE) / nullif(count(*) FILTER (WHERE is_sanctioned), 0), 6)",
    "high_score": "count(*) FILTER (WHERE band = 'high')", "sanctioned": "count(*) FILTER (WHERE is_sanctioned)", "completed": "count(*) FILTER (WHERE is_completed)", "open_long": "count(*) FILTER (WHERE open_over_year)", "unpaid": "count(*) FILTER (WHERE unpaid_3_months)",
    "slow_sanction": "count(*) FILTER (WHERE slow)", "not_sanctioned": "count(*) FILTER (WHERE pending_45_days)", "over_paid": "count(*) FILTER (WHERE over_paid)", "march": "count(*) FILTER (WHERE march)", "repeats": "count(*) FILTER (WHERE any_repeat)",
    "completed_unpaid": "count(*) FILTER (WHERE completed_unpaid)", "dear": "count(*) FILTER (WHERE cost_outlier)", "alike": "count(*) FILTER (WHERE has_similar)", "works": "count(*)",
}
_COST = f""", cb AS (SELECT s.work_key, s.sanction_paise, coalesce(a.med, b.med) AS med, coalesce(a.scale, b.scale) AS scale
FROM (SELECT *, {fy("sanction_date")} AS fy FROM san) s LEFT JOIN ps a ON a.fy = s.fy AND a.state = s.state AND a.activity = s.activity LEFT JOIN ps b ON b.fy = s.fy AND b.state IS NULL AND b.activity = s.activity),
co AS (SELECT work_key FROM cb WHERE (ln(1 + sanction_paise / 100.0) - med) / scale > 3.5 AND sanction_paise / 100.0 / (exp(med) - 1) >= 2 AND sanction_paise >= 10000000),
ds AS (SELECT work_key AS id, concat_ws('|', ida, activity) AS block, trim(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9]+', ' ', 'g')) AS text, sanction_paise AS amount FROM mw WHERE is_sanctioned),
base AS (SELECT *, {_WORDS.format("text")} AS words FROM ds),"""
_ENDS = _PAIRS[: _PAIRS.rindex("SELECT a, b, round(sim, 6)")].rstrip() + ", kk AS (SELECT a, b, high FROM k QUALIFY row_number() OVER (PARTITION BY b ORDER BY high DESC, sim DESC, same_amount DESC, a) <= 3), en AS (SELECT a AS work_key FROM kk WHERE high UNION SELECT b FROM kk WHERE high)"


@query(
    _MW
    + _PEERS.removeprefix(using("san"))
    + _COST
    + _ENDS
    + ", mx AS (SELECT mw.*, mw.work_key IN (SELECT work_key FROM co) AS cost_outlier, mw.work_key IN (SELECT work_key FROM en) AS has_similar FROM mw) SELECT state, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _ALL.items())
    + " FROM mx GROUP BY state"
)
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, Q11: every measure but that of amounts at completion, by state."""
    w = measured(spark, sf_dir, True, True)
    m = w.groupBy("state").agg(*[F.expr(MEASURES[name].sql).alias(name) for name in _ALL])
    return m.withColumns({c: F.round(c, 4 if c == "mean_sanction" else 6) for c in ("mean_sanction", "mean_score", "paid_share", "completed_share")})


def _first_work(spark: SparkSession, sf_dir: str) -> str | None:
    row = q_rule_scores(spark, sf_dir).orderBy(F.col("score").desc(), "work_key").select("work_key").first()
    return row["work_key"] if row else None


_REASONS = ", rs AS (" + " UNION ALL ".join(f"SELECT work_key, '{k}' AS rule, {v} AS points FROM f WHERE {k}" for k, v in WEIGHTS.items()) + f"), fi AS (SELECT work_key FROM f ORDER BY {_SCORE} DESC, work_key LIMIT 1)"


@query(_MW + _REASONS + " SELECT 'work' AS part, 'paid_paise' AS name, CAST(paid_paise AS VARCHAR) AS value FROM mw WHERE work_key IN (SELECT work_key FROM fi) UNION ALL SELECT 'work', 'state', state FROM mw WHERE work_key IN (SELECT work_key FROM fi) UNION ALL SELECT 'reason', rule, CAST(points AS VARCHAR) FROM rs WHERE work_key IN (SELECT work_key FROM fi)")
def q_work_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q03: a work's row and reasons (its pairs are q_work_pairs)."""
    none = spark.createDataFrame([], "a string, b string, similarity double")
    row, reasons, _ = L.work_detail(W.works_with_payments(spark, sf_dir), q_unpivot_contrib(spark, sf_dir), none, _first_work(spark, sf_dir) or "")
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("paid_paise", "state")])
    return row.select(F.lit("work").alias("part"), F.inline(cells)).union(reasons.select(F.lit("reason"), "rule", F.col("points").cast("string")))


@query(f"WITH p AS ({_SIMILAR}), o AS (SELECT least(a, b) AS w FROM p ORDER BY similarity DESC, 1 LIMIT 1) SELECT a, b, similarity FROM p WHERE a IN (SELECT w FROM o) OR b IN (SELECT w FROM o) ORDER BY similarity DESC, a, b LIMIT 100")
def q_work_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of one work, on either end."""
    pairs = staged(q_weighted_jaccard_pairs(spark, sf_dir), "pairs")
    row = pairs.select(F.least("a", "b").alias("w"), "similarity").orderBy(F.col("similarity").desc(), "w").first()
    none = spark.createDataFrame([], "work_key string, rule string, points int")
    return L.work_detail(none, none, pairs, row["w"] if row else "")[2].select("a", "b", "similarity")


@query(f"SELECT p.a, p.b, p.similarity, p.high, x.description_normalized AS description_normalized_a, y.description_normalized AS description_normalized_b, x.sanction_amount_paise AS sanction_amount_paise_a, y.sanction_amount_paise AS sanction_amount_paise_b FROM ({_SIMILAR}) p JOIN work_features x ON p.a = x.work_id JOIN work_features y ON p.b = y.work_id WHERE concat_ws(chr(1), p.a, p.b, x.description_normalized, y.description_normalized, CAST(x.sanction_amount_paise AS VARCHAR), CAST(y.sanction_amount_paise AS VARCHAR)) ILIKE '%school%' ORDER BY p.high DESC, p.similarity DESC, p.a, p.b LIMIT 50")
def q_duplicates_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of similar works with both sides' facts, searched on either side."""
    pairs = q_weighted_jaccard_pairs(spark, sf_dir).drop("same_amount")
    return L.pairs_page(pairs, table(spark, sf_dir, "work_features"), "work_id", ["description_normalized", "sanction_amount_paise"], "school")[0]


@query("SELECT vendor_id, vendor_name, payment_row_count, successful_paise, pending_paise, first_payment_date, last_payment_date FROM vendor_features WHERE concat_ws(chr(1), vendor_id, vendor_name, CAST(payment_row_count AS VARCHAR), CAST(successful_paise AS VARCHAR), CAST(pending_paise AS VARCHAR), CAST(first_payment_date AS VARCHAR), CAST(last_payment_date AS VARCHAR)) ILIKE '%07%' ORDER BY successful_paise DESC NULLS LAST, vendor_id LIMIT 40 OFFSET 20")
def q_table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a table, searched over every column."""
    v = table(spark, sf_dir, "vendor_features").drop("loaded_at", "deleted_at")
    return L.table_page(v, "vendor_id", [F.col("successful_paise").desc_nulls_last()], "07", 40, 20)[0]


@query(
    using("pay")
    + ", t AS (SELECT ida, vendor, sum(paise) AS total FROM pay WHERE is_success AND ida IS NOT NULL AND vendor IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, CASE WHEN sum(total) OVER (PARTITION BY ida) > 0 THEN CAST(total AS DOUBLE) / sum(total) OVER (PARTITION BY ida) END AS share FROM t), g AS (SELECT ida, round(sum(share * share), 6) AS hhi, count(*) AS members, CAST(sum(total) AS BIGINT) AS total FROM s GROUP BY ida) SELECT * FROM g ORDER BY (members >= 3 AND total >= 500000000) DESC, hhi DESC NULLS LAST, total DESC NULLS LAST, ida LIMIT 100"
)
def q_table_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities by concentration, those with several vendors and a material sum first."""
    c = concentration(W.payments(spark, sf_dir).where("is_success"), ["ida"], "vendor", "paise").drop("top_share")
    material_first = (F.col("members") >= 3) & F.coalesce(F.col("total") >= 500_000_000, F.lit(False))
    return L.table_page(c, "ida", [material_first.desc(), F.col("hhi").desc_nulls_last(), F.col("total").desc_nulls_last()], None, 100)[0]


@query(_MW + " SELECT ida, min(state) AS state, count(*) AS works, count(*) FILTER (WHERE band = 'high') AS high, CAST(sum(sanction_paise) AS BIGINT) AS sanction_paise, round(CAST(sum(paid_paise) AS DOUBLE) * 100 / nullif(sum(sanction_paise), 0), 4) AS paid_percent FROM mw WHERE ida IS NOT NULL GROUP BY ida ORDER BY high DESC, sanction_paise DESC NULLS LAST, ida LIMIT 20")
def q_overview_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty authorities with the most works of a high score, with percentages of what was sanctioned."""
    m = measured(spark, sf_dir).where("ida is not null").groupBy("ida").agg(F.min("state").alias("state"), F.count(F.lit(1)).alias("works"), F.count_if(F.expr("band = 'high'")).alias("high"), F.sum("sanction_paise").alias("sanction_paise"), F.round(ratio(F.sum("paid_paise") * 100, F.sum("sanction_paise")), 4).alias("paid_percent"))
    return m.orderBy(F.col("high").desc(), F.col("sanction_paise").desc_nulls_last(), "ida").limit(20)


@query(_MW + _REASONS + " SELECT rule, count(DISTINCT work_key) AS works, CAST(sum(points) AS BIGINT) AS points FROM rs WHERE work_key IN (SELECT work_key FROM mw WHERE state = 'MADHUVAN') GROUP BY rule")
def q_entity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a state's works meet."""
    return L.entity_reasons(W.works(spark, sf_dir), q_unpivot_contrib(spark, sf_dir), "state", "MADHUVAN")


_TABLES = ("allocated_limit", "works_recommended", "works_sanctioned", "expenditure", "work_features", "vendor_features", "calamity_features")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INTEGER) AS columns, (SELECT count(*) FROM {t}) AS rows" for t in _TABLES))
def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19: what is loaded."""
    return L.status({t: table(spark, sf_dir, t) for t in _TABLES})


_CASES = "SELECT CAST(event_id AS VARCHAR) AS review_id, CAST(user_id AS VARCHAR) AS record_key, event_type AS status, props AS note, '' AS owner FROM events"


@query(f"SELECT * FROM ({_CASES} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lpad(CAST(event_id AS VARCHAR), 12, '0') DESC) = 1) WHERE status <> 'purchase'")
def q_open_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of each record of a ledger, those that aren't closed, newest first."""
    e = table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("review_id"), F.col("user_id").cast("string").alias("record_key"), F.col("event_type").alias("status"), F.col("props").alias("note"), F.lit("").alias("owner"))
    return open_cases(latest(e, ["record_key"], ["review_id"]), ["purchase"]).withColumn("review_id", F.regexp_replace("review_id", "^0+(?=.)", ""))


# --- Sources and sinks, there and back ---


@query(f"SELECT record_id, cohort, vendor_id, expenditure_date, fund_disbursed_amt, work_status FROM expenditure")
def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments as a CSV file of one piece, read again in blocks by many tasks."""
    columns = ["record_id", "cohort", "vendor_id", "expenditure_date", "fund_disbursed_amt", "work_status"]
    path = shared_path(spark, "trip", ".csv")
    rows = table(spark, sf_dir, "expenditure").select(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")).alias(c) for c in columns])
    write_csv_file(rows, path.removeprefix("file://"))
    digest, n = stream_digest(path.removeprefix("file://")), rows.count()
    back, rejected = read_split_export(spark, path.removeprefix("file://"), columns, 1 << 20)
    counted = back.count()
    if counted != n or not rejected.isEmpty() or stream_digest(path.removeprefix("file://")) != digest:
        raise ContractError(f"{counted} of {n} rows came back")
    return back.select(F.col("record_id").cast("bigint").alias("record_id"), *[F.nullif(F.col(c), F.lit("\\N")).alias(c) for c in columns[1:]])


@query("SELECT vendor_id, vendor_name, payment_row_count, successful_paise, first_payment_date FROM vendor_features")
def q_sqlite_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors in a SQLite file, and back."""
    path = shared_path(spark, "trip", ".sqlite").removeprefix("file://")
    v = table(spark, sf_dir, "vendor_features").select("vendor_id", "vendor_name", "payment_row_count", "successful_paise", "first_payment_date")
    write_sqlite({"vendors": v}, path, [("vendors", ["vendor_id"])])
    return read_sqlite(spark, path, "vendors", "vendor_id string, vendor_name string, payment_row_count bigint, successful_paise bigint, first_payment_date date")


@query("SELECT CAST(row_number() OVER (ORDER BY successful_paise DESC, vendor_id) + 1 AS INTEGER) AS row, vendor_id, CAST(round(successful_paise / 100.0, 2) AS DOUBLE) AS successful_inr FROM vendor_features WHERE successful_paise IS NOT NULL ORDER BY 1 LIMIT 500")
def q_workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five hundred vendors with the highest payments as a sheet, read by the workbook source."""
    path = shared_path(spark, "trip", ".xlsx").removeprefix("file://")
    v = table(spark, sf_dir, "vendor_features").where("successful_paise is not null").select("vendor_id", "successful_paise")
    write_workbook({"vendors": v.orderBy(F.col("successful_paise").desc(), "vendor_id").limit(500)}, path)
    spark.dataSource.register(WorkbookSource)
    rows = spark.read.format("workbook").option("header_row", 1).load(path)
    return rows.select("row", F.get("cells", F.lit(0)).alias("vendor_id"), F.get("cells", F.lit(1)).cast("double").alias("successful_inr"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed daily windows of a stream."""
    return S.run_to_parquet(S.window_counts(S.event_stream(spark, sf_dir)), "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_id FROM events")
def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice, once each."""
    e = S.event_stream(spark, sf_dir)
    return S.run_to_parquet(S.deduplicated(e.unionByName(S.event_stream(spark, sf_dir)), ["event_id"]).select("event_id"), "dedup")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that batches append to, and the latest row of each key."""
    base = shared_path(spark, "ledger")
    events = S.event_stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    stream = S.ledger_upserts(events, f"{base}/rows", ["user_id"], ["event_id"], f"{base}/state")
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return S.ledger_view(spark, f"{base}/rows", ["user_id"], ["event_id"])
