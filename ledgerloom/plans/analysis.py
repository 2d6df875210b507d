"""Queries over texts, rankings and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import PHASE_WORDS, STOP_WORDS, ascii_norm, clipped, dice, divisible, folded_text, jaccard, name_key, numbers_of, ratio, residue_cleaned, rupees, short_hash, tie_break, trigrams_of, unmarked, without_prefix
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import models as M
from ledgerloom.operators import relational as R
from ledgerloom.operators import works as W
from ledgerloom.operators.similar_works import all_similar, best_matches, similar_pairs, word_counts
from ledgerloom.plans.ledger import _FLAGS, _MONTHS, _SCORE, AS_OF, WEIGHTS, _months, _points, flagged
from ledgerloom.plans.sql import using
from ledgerloom.session import staged
from ledgerloom.sources.tables import table

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


_STOP = "['" + "', '".join(STOP_WORDS) + "']"
_WORDS = "list_sort(list_filter(list_distinct(regexp_split_to_array({0}, '\\s+')), lambda x: x <> '' AND NOT list_contains(" + _STOP + ", x)))"
_CUE = "\\b(?:" + "|".join(PHASE_WORDS) + ")\\b"


# --- Texts ---


@query("SELECT word, count(*) AS works FROM (SELECT unnest(" + _WORDS.format("description_normalized") + ") AS word FROM work_features) GROUP BY word")
def q_text_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many works each word occurs."""
    return word_counts(table(spark, sf_dir, "work_features"), "description_normalized")


_BASE = f"WITH base AS (SELECT work_id AS id, concat_ws('|', ida_key, activity_type) AS block, coalesce(description_normalized, '') AS text, sanction_amount_paise AS amount, {_WORDS.format("coalesce(description_normalized, '')")} AS words FROM work_features),"
_PAIRS = f"""
e AS (SELECT id, block, unnest(words) AS word FROM base), c AS (SELECT word, count(*) AS df FROM e GROUP BY word), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM base),
we AS (SELECT word, df, ln(1 + (SELECT n FROM n) / (1 + df)) AS w FROM c),
an AS (SELECT id, block, e.word FROM e JOIN we ON e.word = we.word QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, e.word) <= 3),
po AS (SELECT *, row_number() OVER (PARTITION BY block, word ORDER BY id) AS p FROM an),
ne AS (SELECT DISTINCT a.id AS a, b.id AS b FROM po a JOIN po b ON a.block = b.block AND a.word = b.word AND b.p - a.p BETWEEN 1 AND 150),
nk AS (SELECT a, b FROM ne QUALIFY row_number() OVER (PARTITION BY b ORDER BY a DESC) <= 60),
ex AS (SELECT *, row_number() OVER (PARTITION BY block, text, amount ORDER BY id) AS p FROM base WHERE text <> '' AND amount IS NOT NULL),
pr AS (SELECT a, b FROM nk UNION SELECT a.id, b.id FROM ex a JOIN ex b ON a.block = b.block AND a.text = b.text AND a.amount = b.amount AND b.p - a.p BETWEEN 1 AND 3),
pf AS (SELECT pr.a, pr.b, x.text AS ta, y.text AS tb, x.words AS wa, y.words AS wb, coalesce(x.amount = y.amount, FALSE) AS same_amount FROM pr JOIN base x ON pr.a = x.id JOIN base y ON pr.b = y.id),
u AS (SELECT a, b, sum(w) AS whole, sum(w) FILTER (WHERE list_contains(wa, t.word) AND list_contains(wb, t.word)) AS shared FROM (SELECT a, b, wa, wb, unnest(list_distinct(list_concat(wa, wb))) AS word FROM pf) t JOIN we ON t.word = we.word GROUP BY a, b),
s AS (SELECT pf.*, CASE WHEN ta = tb AND ta <> '' THEN 1.0 WHEN whole > 0 THEN coalesce(shared, 0) / whole ELSE 0.0 END AS sim FROM pf LEFT JOIN u ON pf.a = u.a AND pf.b = u.b),
pg AS (SELECT *, list_sort(list_distinct(regexp_extract_all(ta, '\\b(\\d+)\\b'))) AS na, list_sort(list_distinct(regexp_extract_all(tb, '\\b(\\d+)\\b'))) AS nb FROM s WHERE sim >= 0.88),
k AS (SELECT *, sim >= 0.96 AND same_amount AND (len(na) = 0 OR len(nb) = 0 OR na = nb) AND len(wa) >= 4 AND len(wb) >= 4 AND NOT regexp_matches(ta, '{_CUE}') AND NOT regexp_matches(tb, '{_CUE}') AS high FROM pg)
SELECT a, b, round(sim, 6) AS similarity, same_amount, high FROM k QUALIFY row_number() OVER (PARTITION BY b ORDER BY high DESC, sim DESC, same_amount DESC, a) <= 3"""
_SIMILAR = _BASE + _PAIRS


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "work_features"), "work_id", ["ida_key", "activity_type"], "description_normalized", "sanction_amount_paise")


@query(_SIMILAR)
def q_weighted_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar works of one authority and activity, found by bounded looking back."""
    return _similar(spark, sf_dir)


@query(f"SELECT b AS work_id, max_by(a, (CASE WHEN high THEN 2 ELSE 0 END + similarity, -length(a), a)) AS best, max(similarity) AS similarity, CASE WHEN bool_or(high) THEN 'strong' WHEN max(similarity) >= 0.96 THEN 'moderate' ELSE 'weak' END AS tier FROM ({_SIMILAR}) GROUP BY b")
def q_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work's best earlier match among those of J15 and the tier of its evidence."""
    p = _similar(spark, sf_dir)
    order = F.struct(F.when(F.col("high"), 2).otherwise(0) + F.col("similarity"), -F.length("a"), F.col("a"))
    tier = F.when(F.bool_or("high"), "strong").when(F.max("similarity") >= 0.96, "moderate").otherwise("weak")
    return p.groupBy(F.col("b").alias("work_id")).agg(F.max_by("a", order).alias("best"), F.max("similarity").alias("similarity"), tier.alias("tier"))


_BLOCK = ("work_id", ["ida_key", "activity_type"], "description_normalized", "sanction_amount_paise")


@query()
def q_block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of one authority, activity and text as classes; any two members are a pair."""
    return all_similar(table(spark, sf_dir, "work_features"), *_BLOCK)[0].withColumnRenamed("id", "work_id")


@query()
def q_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All similar pairs of these classes, without bounds."""
    return all_similar(table(spark, sf_dir, "work_features"), *_BLOCK)[1]


@query()
def q_block_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each work's best match among all other works of its authority and activity, and the tier of its evidence."""
    tier = F.when(F.col("high"), "strong").when(F.col("similarity") >= 0.96, "moderate").otherwise("weak").alias("tier")
    return best_matches(table(spark, sf_dir, "work_features"), *_BLOCK).select(F.col("id").alias("work_id"), "best", "similarity", tier)


_TRI = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, CAST(i AS INTEGER), 3)))"


@query(
    using("rec", "san")
    + f", p AS (SELECT s.work_key, r.description AS a, s.description AS b FROM san s JOIN rec r ON s.work_key = r.work_key WHERE r.description <> s.description AND r.description <> '' AND s.description <> ''), t AS (SELECT *, {_TRI.format('a')} AS x, {_TRI.format('b')} AS y FROM p)"
    + " SELECT work_key, round(2.0 * len(list_intersect(x, y)) / nullif(len(x) + len(y), 0), 6) AS dice, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / nullif(len(list_distinct(list_concat(x, y))), 0), 6) AS jaccard FROM t"
)
def q_trigram_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how alike the two descriptions of one work are."""
    r = W.recommended(spark, sf_dir).select("work_key", F.col("description").alias("a"))
    p = W.sanctioned(spark, sf_dir).select("work_key", F.col("description").alias("b")).join(r, "work_key").where("a <> b and a <> '' and b <> ''")
    p = p.withColumn("x", trigrams_of(F.col("a"))).withColumn("y", trigrams_of(F.col("b")))
    return p.select("work_key", F.round(dice(F.col("x"), F.col("y")), 6).alias("dice"), F.round(jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(using("san") + f", d AS (SELECT work_key, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) AS t FROM san) SELECT work_key, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b(\\d+)\\b'))), ' ') AS numbers, regexp_matches(t, '{_CUE}') AS further_part FROM d WHERE t <> ''")
def q_number_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the numbers in a description and whether it announces a further part."""
    d = W.sanctioned(spark, sf_dir).select("work_key", ascii_norm(F.col("description")).alias("t")).where("t <> ''")
    return d.select("work_key", F.array_join(numbers_of(F.col("t")), " ").alias("numbers"), F.col("t").rlike(_CUE).alias("further_part"))


@query(
    "SELECT record_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(mp_name, '[''’.]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), '^(?:(?:shri|sri|shree|smt|shrimati|dr|prof|adv|honble) )+', ''), ' ', '', 'g') AS name_key, trim(regexp_replace(lower(work_description), '[^a-z0-9]+', ' ', 'g')) AS description FROM works_recommended"
)
def q_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01 (ASCII), F02: names without honorifics and plain descriptions."""
    return table(spark, sf_dir, "works_recommended").select("record_id", name_key(F.col("mp_name")).alias("name_key"), ascii_norm(F.col("work_description")).alias("description"))


@query(r"SELECT record_id, nullif(regexp_extract(activity_name, '^WS/\s*MP\s*(\d+)/(\d{4}-\d{4})/(\d+)-(.*)$', 1), '') AS profile, nullif(regexp_extract(activity_name, '^WS/\s*MP\s*(\d+)/(\d{4}-\d{4})/(\d+)-(.*)$', 2), '') AS years, nullif(regexp_extract(activity_name, '^WS/\s*MP\s*(\d+)/(\d{4}-\d{4})/(\d+)-(.*)$', 3), '') AS number, nullif(regexp_extract(activity_name, '^WS/\s*MP\s*(\d+)/(\d{4}-\d{4})/(\d+)-(.*)$', 4), '') AS activity FROM works_recommended")
def q_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the four parts of a work's code; null where it has another form."""
    form = r"^WS/\s*MP\s*(\d+)/(\d{4}-\d{4})/(\d+)-(.*)$"
    parts = {n: F.nullif(F.regexp_extract("activity_name", form, i + 1), F.lit("")) for i, n in enumerate(("profile", "years", "number", "activity"))}
    return table(spark, sf_dir, "works_recommended").select("record_id", *[c.alias(n) for n, c in parts.items()])


_FOLDED = "trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize({0})), '_', ' '), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("SELECT doc_id, " + _FOLDED.format("text") + " AS folded FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[\\x00-\\x7f\\x{0900}-\\x{097f}]*$')")
def q_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the Unicode-aware normal form of English and Hindi texts."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"^[\x00-\x7f\x{0900}-\x{097f}]*$"))
    return d.select("doc_id", folded_text(F.col("text")).alias("folded"))


@query("SELECT doc_id, contains(text, chr(65533)) AS has_replacement, regexp_replace(lower(trim(source)), '^(letter|field)[-_ ]*', '') AS rest, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits, split_part(text, ' ', 1) AS first_word FROM documents WHERE text IS NOT NULL")
def q_text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replacement characters, a prefix taken off, digits and the first word."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents").where(t.isNotNull())
    return d.select("doc_id", F.contains(t, F.lit("\ufffd")).alias("has_replacement"), without_prefix(F.lower(F.trim("source")), ["letter", "field"]).alias("rest"), F.regexp_count(t, F.lit("[0-9]")).cast("bigint").alias("digits"), F.substring_index(t, " ", 1).alias("first_word"))


_HUNDREDTHS = "CAST(((sanction_amount_paise + {0} // 200) // ({0} // 100)) // 100 AS VARCHAR) || '.' || lpad(CAST(((sanction_amount_paise + {0} // 200) // ({0} // 100)) % 100 AS VARCHAR), 2, '0')"
_RUPEES = f"CASE WHEN sanction_amount_paise >= 1000000000 THEN 'INR ' || {_HUNDREDTHS.format(1_000_000_000)} || ' crore' WHEN sanction_amount_paise >= 10000000 THEN 'INR ' || {_HUNDREDTHS.format(10_000_000)} || ' lakh' ELSE 'INR ' || CAST(sanction_amount_paise // 100 AS VARCHAR) END"


@query(f"SELECT work_id, {_RUPEES} AS shown, sanction_amount_paise % 100000000 = 0 AS round_million, abs(sanction_amount_paise - recommended_amount_paise) > 10000 AS apart FROM work_features WHERE sanction_amount_paise >= 0 AND recommended_amount_paise IS NOT NULL")
def q_amount_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """amounts as people write them, round amounts, and amounts that differ."""
    w = table(spark, sf_dir, "work_features").where("sanction_amount_paise >= 0 and recommended_amount_paise is not null")
    s = F.col("sanction_amount_paise")
    return w.select("work_id", rupees(s).alias("shown"), divisible(s, 100_000_000).alias("round_million"), (F.abs(s - F.col("recommended_amount_paise")) > 10_000).alias("apart"))


@query(
    "SELECT record_id, paise, residue FROM (SELECT record_id, CAST(round(x * 100, 0) AS BIGINT) AS paise, CAST(x * 100 - round(x * 100, 0) AS DOUBLE) / 100 AS residue FROM (SELECT record_id, TRY_CAST(fund_disbursed_amt AS DECIMAL(28, 12)) AS x FROM expenditure WHERE regexp_matches(fund_disbursed_amt, '^\\s*-?[0-9]+(\\.[0-9]+)?\\s*$')) WHERE abs(x * 100 - round(x * 100, 0)) <= 0.0001)"
)
def q_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """amounts freed of float noise, and the noise."""
    clean, residue = residue_cleaned(F.col("fund_disbursed_amt"))
    return table(spark, sf_dir, "expenditure").select("record_id", clean.alias("paise"), residue.alias("residue")).where("paise is not null")


@query("SELECT DISTINCT state_name, trim(regexp_replace(replace(lower(strip_accents(state_name)), '&', ' and '), '\\s+', ' ', 'g')) AS place FROM works_recommended WHERE state_name IS NOT NULL")
def q_place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names of places without marks, for matching; each distinct name is folded once."""
    names = table(spark, sf_dir, "works_recommended").where("state_name is not null").select("state_name").distinct()
    return names.select("state_name", unmarked(F.col("state_name")).alias("place"))


@query(using("san") + " SELECT work_key, concat_ws('|', cohort, lower(state), lower(profile)) AS member_key, concat_ws('|', lower(state), lower(ida)) AS authority_key FROM san")
def q_composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys of members and authorities; missing parts are passed over."""
    return W.sanctioned(spark, sf_dir).select("work_key", F.concat_ws("|", "cohort", F.lower("state"), F.lower("profile")).alias("member_key"), F.concat_ws("|", F.lower("state"), F.lower("ida")).alias("authority_key"))


@query("SELECT event_type, count(*) AS rows, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k_total FROM events GROUP BY event_type")
def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: values out of JSON texts."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("p.k").alias("k_total"))


# --- Rankings and evaluation ---

_RANKED = using("full_wk") + f", {_FLAGS}, sc AS (SELECT work_key, {_SCORE} AS score, repeated AS truth FROM f)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("work_key", F.least(F.lit(100), _points()).alias("score"), F.col("repeated").alias("truth"))


@query(_RANKED + " SELECT count(*) FILTER (WHERE score >= 20 AND truth) AS tp, count(*) FILTER (WHERE score >= 20 AND NOT truth) AS fp, count(*) FILTER (WHERE score < 20 AND truth) AS fn, count(*) FILTER (WHERE score < 20 AND NOT truth) AS tn FROM sc")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold against a label."""
    return E.confusion(_scored(spark, sf_dir), F.col("score") >= 20, F.col("truth"))


@query(_RANKED + " SELECT work_key, score, substr(sha256('work|' || work_key), 1, 24) AS row_id, CAST(row_number() OVER (ORDER BY score DESC, substr(sha256('7:' || work_key), 1, 16), work_key) AS INTEGER) AS place FROM sc")
def q_hash_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All works in order, equal scores in a fixed random one, with a short hash as id."""
    s = _scored(spark, sf_dir).select("work_key", "score", tie_break("7", F.col("work_key")).alias("tie"))
    placed = R.ranked(s, [F.col("score").desc(), F.col("tie"), F.col("work_key")], "place")
    return placed.select("work_key", "score", short_hash("work", F.col("work_key")).alias("row_id"), "place")


_SHARES = "(VALUES (CAST(0.05 AS DOUBLE), 5), (0.1, 10), (0.2, 20), (0.3, 30)) AS b(budget, pct)"


@query(
    _RANKED
    + f""", n AS (SELECT count(*) AS n, count(*) FILTER (WHERE score > 0) AS positive FROM sc), k AS (SELECT b.budget, CAST((n.n * b.pct + 99) // 100 AS BIGINT) AS taken, positive FROM n, {_SHARES}),
c AS (SELECT score, count(*) AS c, CAST(sum(count(*)) OVER (ORDER BY score DESC) AS BIGINT) AS upto FROM sc GROUP BY score)
SELECT budget, taken, greatest(taken - positive, 0) AS fillers, score AS edge_score, c AS edge_rows, taken - (upto - c) AS edge_taken, positive FROM k JOIN c ON upto >= taken AND upto - c < taken"""
)
def q_queue_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a score that fill budgets, and the ties at their edge."""
    return E.queue_edges(_scored(spark, sf_dir), "score", [0.05, 0.1, 0.2, 0.3])


_PLACED = using("full_wk") + f", {_FLAGS}, pl AS (SELECT f.*, wk.cohort, row_number() OVER (ORDER BY {_SCORE} DESC, substr(sha256('7:' || f.work_key), 1, 16), f.work_key) AS place, count(*) OVER () AS n FROM f JOIN wk ON f.work_key = wk.work_key), ch AS (SELECT * FROM pl WHERE place <= (n * 10 + 99) // 100)"


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    f = flagged(spark, sf_dir, ["cohort"]).withColumn("score", F.least(F.lit(100), _points())).withColumn("tie", tie_break("7", F.col("work_key")))
    placed = staged(R.ranked(f, [F.col("score").desc(), F.col("tie"), F.col("work_key")], "place"), "placed")
    return placed, -(-placed.count() * 10 // 100)


@query(_PLACED + " SELECT cohort, count(*) AS selected, round(count(*) / CAST(any_value((n * 10 + 99) // 100) AS DOUBLE), 6) AS share FROM ch GROUP BY cohort")
def q_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohorts of the first tenth of all works."""
    placed, size = _placed(spark, sf_dir)
    return E.queue_mix(placed, "place", size, "cohort").withColumn("share", F.round("share", 6))


@query(_PLACED + " " + " UNION ALL ".join(f"SELECT '{k}' AS screen, count(*) FILTER (WHERE place <= (n * 10 + 99) // 100) AS selected, count(*) AS population FROM pl WHERE {k} HAVING count(*) > 0" for k in WEIGHTS))
def q_queue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each screen's works the first tenth holds."""
    placed, size = _placed(spark, sf_dir)
    return E.queue_coverage(placed, "place", size, list(WEIGHTS))


@query(_RANKED + " SELECT work_key, score, truth FROM sc")
def q_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined after scoring, one to one."""
    s = _scored(spark, sf_dir)
    return E.labelled(s.select("work_key", "score"), s.select("work_key", "truth"), "work_key", "truth")


@query()
def q_unsupervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many works with a high peer ratio the isolation scores and the density noise recover.

    Each row counts: rows that repeat a work's id are scored and labelled by themselves."""
    w = staged(R.own_keys(_measures(spark, sf_dir), "work_id", [F.col(c) for c in ("r", "s", "cost_peer_ratio", "d")]), "measures")
    truth = w.select("work_id", F.coalesce((F.col("cost_peer_ratio") >= 3) & ~F.isnan("cost_peer_ratio"), F.lit(False)).alias("truth"))
    forest = E.labelled(staged(_isolated(w), "scores"), truth, "work_id", "truth")
    found = E.recovery_at(forest, "work_id", "score", "truth", [0.05, 0.1, 0.2, 0.3]).select(F.lit("isolation").alias("model"), "budget", "taken", "recovered", "recovery")
    noise = E.labelled(staged(_dense(w), "clusters"), truth, "work_id", "truth")
    noise = noise.agg(F.lit("density").alias("model"), F.round(F.count_if(F.expr("cluster = -1")) / F.count(F.lit(1)), 6).alias("budget"), F.count_if(F.expr("cluster = -1")).alias("taken"), F.count_if(F.expr("cluster = -1 and truth")).alias("recovered"), F.count_if("truth").alias("t"))
    return found.unionByName(noise.withColumn("recovery", F.round(F.col("recovered") / F.greatest(F.col("t"), F.lit(1)), 6)).drop("t"))


@query(
    _RANKED
    + """, r AS (SELECT sc.*, t.seed, row_number() OVER (PARTITION BY t.seed ORDER BY score DESC, substr(sha256(t.seed || ':' || work_key), 1, 16), work_key) AS place, count(*) OVER (PARTITION BY t.seed) AS n FROM sc, (VALUES ('1'), ('2'), ('3')) AS t(seed))
SELECT seed, b.budget, count(*) AS taken, count(*) FILTER (WHERE score > 0) AS positive, count(*) FILTER (WHERE score > 0 AND truth) AS recovered FROM r JOIN (VALUES (CAST(0.05 AS DOUBLE), 5), (0.1, 10), (0.2, 20), (0.3, 30)) AS b(budget, pct) ON place <= (n * b.pct + 99) // 100 GROUP BY 1, 2"""
)
def q_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What budgets take and recover, for three tie seeds."""
    return E.budget_table(_scored(spark, sf_dir), "work_key", "score", "truth", [0.05, 0.1, 0.2, 0.3], ["1", "2", "3"])


@query()
def q_budget_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for 20 tie seeds."""
    return E.budget_table(_scored(spark, sf_dir), "work_key", "score", "truth", [0.05, 0.1, 0.2, 0.3], [str(s) for s in range(1, 21)])


@query()
def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two arms over authorities drawn again and again."""
    f = flagged(spark, sf_dir).join(W.works(spark, sf_dir).select("work_key", "ida"), "work_key").where("ida is not null")
    return E.paired_bootstrap(f.select("ida", (F.col("slow") | F.col("march")).cast("int").alias("a"), (F.col("slow") | F.col("repeated")).cast("int").alias("b")), "ida", "a", "b")


_ORDERED = using("san") + ", d AS (SELECT recommendation_date AS d, count(*) AS n FROM san WHERE recommendation_date IS NOT NULL GROUP BY 1), u AS (SELECT d, sum(n) OVER (ORDER BY d) AS u FROM d), c AS (SELECT min(d) AS cut FROM u WHERE u >= (SELECT floor(sum(n) * 0.7) FROM d))"


@query(_ORDERED + " SELECT CASE WHEN recommendation_date <= (SELECT cut FROM c) THEN 'train' ELSE 'test' END AS part, count(*) AS works, min(recommendation_date) AS first_day, max(recommendation_date) AS last_day FROM san WHERE recommendation_date IS NOT NULL GROUP BY 1")
def q_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and test works, whole days on one side."""
    s = W.sanctioned(spark, sf_dir).where("recommendation_date is not null")
    cut = E.cut_date(s, "recommendation_date", 0.7)
    part = F.when(F.col("recommendation_date") <= F.lit(cut), "train").otherwise("test").alias("part")
    return s.groupBy(part).agg(F.count(F.lit(1)).alias("works"), F.min("recommendation_date").alias("first_day"), F.max("recommendation_date").alias("last_day"))


_FOLDS = _MONTHS + f""", l AS (SELECT month, paise AS actual, row_number() OVER (ORDER BY month DESC) AS back FROM m WHERE month < '{AS_OF[:7]}' QUALIFY back <= 36),
x AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS i, lag(actual) OVER (ORDER BY month) AS "last", avg(actual) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3, coalesce(lead(month) OVER (ORDER BY month), '{AS_OF[:7]}') AS after, count(*) OVER () AS n FROM l),
fo AS (SELECT month, actual, "last", round(mean3, 3) AS mean3, CASE WHEN back <= 3 THEN 'test' ELSE 'validation' END AS split FROM x WHERE n >= 15 AND i >= 6 AND NOT EXISTS (SELECT 1 FROM x WHERE after <> strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')))"""


@query(_FOLDS + " SELECT * FROM fo")
def q_forecast_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling forecasts of the next month from earlier ones."""
    return E.forecast_folds(_months(spark, sf_dir), "month", "paise", AS_OF[:7])


@query(_FOLDS + """, e AS (SELECT 0 AS rank, 'last' AS method, split, abs("last" - actual) AS err FROM fo UNION ALL SELECT 1, 'mean3', split, abs(mean3 - actual) FROM fo), g AS (SELECT rank, method, round(avg(err) FILTER (WHERE split = 'validation'), 3) AS validation_mae, round(avg(err) FILTER (WHERE split = 'test'), 3) AS test_mae FROM e GROUP BY 1, 2) SELECT method, validation_mae, test_mae, row_number() OVER (ORDER BY validation_mae, rank) = 1 AS chosen FROM g""")
def q_forecast_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method with the smaller validation error."""
    return E.chosen_forecast(E.forecast_folds(_months(spark, sf_dir), "month", "paise", AS_OF[:7]))


# --- Numeric features ---

_NUM = ["score", "recommended_paise", "sanction_paise", "paid_paise", "pending_paise", "delay_days", "payment_rows", "vendors", "months"]


@query(
    using("full_wk")
    + f", {_FLAGS}, nf AS (SELECT {_SCORE} AS score, recommended_paise, sanction_paise, paid_paise, pending_paise, sanction_date - recommendation_date AS delay_days, payment_rows, vendors, months FROM full_wk JOIN f USING (work_key)) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS rows, round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM nf WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]
    )
)
def q_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of nine columns on the rows complete for each pair."""
    f = flagged(spark, sf_dir, ["recommended_paise", "sanction_paise", "paid_paise", "pending_paise", "sanction_date", "recommendation_date", "payment_rows", "vendors", "months"])
    rows = f.withColumn("score", F.least(F.lit(100), _points())).withColumn("delay_days", F.date_diff("sanction_date", "recommendation_date"))
    return E.rank_correlations(rows, _NUM)


@query("SELECT bround_a AS amount_class, bround_b AS ratio_class, count(*) AS rows FROM (SELECT round_even(ln(1 + coalesce(sanction_amount_paise, 0) / 100.0), 1) AS bround_a, round_even(CASE WHEN isnan(cost_peer_ratio) THEN NULL ELSE cost_peer_ratio END, 1) AS bround_b FROM work_features) GROUP BY 1, 2")
def q_weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal rounded rows with their number."""
    r = F.when(~F.isnan("cost_peer_ratio"), F.col("cost_peer_ratio"))
    a = F.bround(F.log1p(F.coalesce("sanction_amount_paise", F.lit(0)) / 100.0), 1)
    return table(spark, sf_dir, "work_features").groupBy(a.alias("amount_class"), F.bround(r, 1).alias("ratio_class")).agg(F.count(F.lit(1)).alias("rows"))


@query("WITH v AS (SELECT work_id, CASE WHEN cost_peer_ratio IS NULL OR isnan(cost_peer_ratio) THEN NULL ELSE cost_peer_ratio END AS r FROM work_features), f AS (SELECT work_id, coalesce(r, (SELECT median(r) FROM v)) AS r, CAST(r IS NULL AS INTEGER) AS missing FROM v) SELECT work_id, missing, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 4) AS z FROM f")
def q_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians for missing values, then standard scores."""
    f = M.imputed(table(spark, sf_dir, "work_features").select("work_id", "cost_peer_ratio"), ["cost_peer_ratio"])
    return M.standardised(f, ["cost_peer_ratio"]).select("work_id", F.col("cost_peer_ratio_missing").alias("missing"), F.round("cost_peer_ratio", 4).alias("z"))


_CLIP = "least(1.0, greatest(0.0, {0}))"


@query(
    "SELECT work_id, round(30 * " + _CLIP.format("((sanction_date - recommendation_date) - 45) / 320.0") + f", 6) AS delay_points, round(CASE WHEN sanction_date IS NULL THEN 20 * " + _CLIP.format(f"((DATE '{AS_OF}' - recommendation_date) - 180) / 550.0") + " ELSE 0.0 END, 6) AS aging_points,"
    + " round(CASE WHEN r > 2 THEN 25 * " + _CLIP.format("(ln(r) - 0.5) / 1.5") + " ELSE 0.0 END, 6) AS cost_points FROM (SELECT *, CASE WHEN isnan(cost_peer_ratio) THEN NULL ELSE cost_peer_ratio END AS r FROM work_features) WHERE recommendation_date IS NOT NULL"
)
def q_clipped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous scores within bounds for delay, age and cost; those of duplicates are q_duplicate_points."""
    w = table(spark, sf_dir, "work_features").where("recommendation_date is not null").withColumn("r", F.when(~F.isnan("cost_peer_ratio"), F.col("cost_peer_ratio")))
    age = F.date_diff(F.lit(AS_OF).cast("date"), "recommendation_date")
    return w.select(
        "work_id",
        F.round(30 * clipped(F.date_diff("sanction_date", "recommendation_date"), 45, 365), 6).alias("delay_points"),
        F.round(F.when(F.col("sanction_date").isNull(), 20 * clipped(age, 180, 730)).otherwise(0.0), 6).alias("aging_points"),
        F.round(F.when(F.col("r") > 2, 25 * clipped(F.log("r"), 0.5, 2)).otherwise(0.0), 6).alias("cost_points"),
    )


@query(f"SELECT b AS work_id, round(max(CASE WHEN same_amount THEN 25 * least(1.0, greatest(0.0, (similarity - 0.8) / 0.2)) ELSE 0.0 END), 4) AS duplicate_points FROM ({_SIMILAR}) GROUP BY b")
def q_duplicate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each work's best earlier pair of the same amount."""
    points = F.when(F.col("same_amount"), 25 * clipped(F.col("similarity"), 0.8, 1)).otherwise(0.0)
    return _similar(spark, sf_dir).groupBy(F.col("b").alias("work_id")).agg(F.round(F.max(points), 4).alias("duplicate_points"))


@query("SELECT mp_profile_id, count(*) AS consents, round(sum(consent_amount), 2) AS consented, max(mp_allocated_limit) AS allocated, coalesce(sum(consent_amount) > 0.1 * max(mp_allocated_limit), FALSE) AS above_tenth FROM calamity_features GROUP BY mp_profile_id")
def q_entity_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sums against a limit."""
    c = table(spark, sf_dir, "calamity_features")
    limit = F.max("mp_allocated_limit")
    return c.groupBy("mp_profile_id").agg(F.count(F.lit(1)).alias("consents"), F.round(F.sum("consent_amount"), 2).alias("consented"), limit.alias("allocated"), F.coalesce(F.sum("consent_amount") > 0.1 * limit, F.lit(False)).alias("above_tenth"))


@query(
    using("full_wk")
    + f""" SELECT work_key, coalesce(NOT is_sanctioned AND DATE '{AS_OF}' - recommendation_date > 45, FALSE) AS waiting, coalesce(is_sanctioned AND sanction_date - recommendation_date > 45, FALSE) AS slow,
  coalesce(is_sanctioned AND stage <> 'Work Completed' AND sanction_date + INTERVAL 1 YEAR < DATE '{AS_OF}', FALSE) AS open_year, coalesce(is_sanctioned AND success_rows = 0 AND sanction_date + INTERVAL 3 MONTH < DATE '{AS_OF}', FALSE) AS unpaid_quarter,
  coalesce(is_sanctioned AND stage <> 'Work Completed' AND sanction_date + INTERVAL 18 MONTH < DATE '{AS_OF}', FALSE) AS open_18_months, coalesce(success_rows > 0 AND paid_paise - sanction_paise > 100, FALSE) AS over_paid,
  coalesce(paid_paise + pending_paise - sanction_paise > 100, FALSE) AS over_billed, any_repeat AS repeated FROM full_wk"""
)
def q_case_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight flags of a case from its dates and payments. Payments are summed with conditions instead of
    gathered in an array of structs, so a work with very many is no large row."""
    w = W.works_with_payments(spark, sf_dir, repeats=True)
    today, sure = F.lit(AS_OF).cast("date"), lambda c: F.coalesce(c, F.lit(False))
    open_for = lambda months: sure(F.col("is_sanctioned") & (F.col("stage") != "Work Completed") & (F.add_months("sanction_date", months) < today))
    return w.select(
        "work_key",
        sure(~F.col("is_sanctioned") & (F.date_diff(today, "recommendation_date") > 45)).alias("waiting"),
        sure(F.col("is_sanctioned") & (F.date_diff("sanction_date", "recommendation_date") > 45)).alias("slow"),
        open_for(12).alias("open_year"),
        sure(F.col("is_sanctioned") & (F.col("success_rows") == 0) & (F.add_months("sanction_date", 3) < today)).alias("unpaid_quarter"),
        open_for(18).alias("open_18_months"),
        sure((F.col("success_rows") > 0) & (F.col("paid_paise") - F.col("sanction_paise") > 100)).alias("over_paid"),
        sure(F.col("paid_paise") + F.col("pending_paise") - F.col("sanction_paise") > 100).alias("over_billed"),
        F.col("any_repeat").alias("repeated"),
    )


@query(
    using("san", "pay") + ", p AS (SELECT p.work_key, min(paid_on) FILTER (WHERE is_success) AS first_day, count(*) FILTER (WHERE paid_on < s.sanction_date) AS before_sanction, bool_and(is_success) AS all_settled, max(paise) AS largest FROM pay p JOIN san s ON p.work_key = s.work_key GROUP BY 1) SELECT * FROM p"
)
def q_filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates with conditions over a work's payments."""
    s = W.sanctioned(spark, sf_dir).select("work_key", "sanction_date")
    p = W.payments(spark, sf_dir).join(s, "work_key")
    return p.groupBy("work_key").agg(F.min(F.when(F.col("is_success"), F.col("paid_on"))).alias("first_day"), F.count_if(F.col("paid_on") < F.col("sanction_date")).alias("before_sanction"), F.bool_and("is_success").alias("all_settled"), F.max("paise").alias("largest"))


@query(using("full_wk") + ", g AS (SELECT state, count(*) AS works, count(*) FILTER (WHERE any_repeat) AS hits FROM full_wk WHERE state IS NOT NULL GROUP BY state) SELECT state, CAST(least(4, floor(CAST(hits AS DOUBLE) / works / 0.02)) AS INTEGER) AS shade FROM g")
def q_map_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five shades of a share for a map."""
    g = W.works_with_payments(spark, sf_dir, repeats=True).where("state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("works"), F.count_if("any_repeat").alias("hits"))
    return g.select("state", F.least(F.lit(4), F.floor(ratio(F.col("hits"), F.col("works")) / 0.02)).cast("int").alias("shade"))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the models see of each work: log amounts, the peer ratio and the days until the sanction."""
    return table(spark, sf_dir, "work_features").select("work_id", F.log1p(F.col("recommended_amount_paise") / 100.0).alias("r"), F.log1p(F.col("sanction_amount_paise") / 100.0).alias("s"), "cost_peer_ratio", F.date_diff("sanction_date", "recommendation_date").cast("double").alias("d"))


def _isolated(works: DataFrame) -> DataFrame:
    scores = M.isolation_scores(works, "work_id", ["r", "s", "cost_peer_ratio", "d"])
    return scores.select("work_id", F.round("score", 6).alias("score"))


def _dense(works: DataFrame) -> DataFrame:
    return M.density_clusters(works, "work_id", ["r", "s", "d"], 0.9, 50)


@query()
def q_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How early each work is isolated by random splits."""
    return _isolated(_measures(spark, sf_dir))


@query()
def q_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of amounts."""
    return _dense(_measures(spark, sf_dir))
