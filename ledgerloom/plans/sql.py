"""SQL for DuckDB of the typed tables, as common table expressions that the queries' SQL begins with."""

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
KEY = r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^([0-9]+)\.0+$', '\1'), '^0+([0-9]+)$', '\1')"
AMOUNT = r"^[0-9]+(\.[0-9]{1,2}|\.[0-9]{2}(0*|0000[0-9]*|00010*|9999[0-9]*))?$"


def strip(c: str) -> str:
    return STRIP.format(c)


def blank(c: str) -> str:
    return f"nullif({strip(c)}, '')"


def given(c: str) -> str:
    return f"coalesce({strip(c)} NOT IN ('', 'NA'), FALSE)"


def paise(c: str) -> str:
    return f"CASE WHEN regexp_matches({strip(c)}, '{AMOUNT}') THEN CAST(round(CAST({strip(c)} AS DOUBLE) * 100) AS BIGINT) END"


def day(c: str) -> str:
    return f"CASE WHEN regexp_matches({strip(c)}, '^[0-9]{{2}}-[A-Za-z]{{3}}-[0-9]{{4}}$') THEN CAST(try_strptime({strip(c)}, '%d-%b-%Y') AS DATE) END"


def fy(d: str) -> str:
    return f"(CAST(year({d} - INTERVAL 3 MONTH) AS VARCHAR) || '-' || CAST(year({d} - INTERVAL 3 MONTH) + 1 AS VARCHAR))"


def _export(name: str) -> str:
    key = KEY.format("work_recommendation_dtl_id")
    return rf"""
SELECT cohort || ':' || {key} AS work_key, record_id, cohort, upper({blank("state_name")}) AS state, upper({blank("ida_name")}) AS ida,
  {strip("work_description")} AS description, {paise("recommended_amount")} AS recommended_paise, {paise("sanction_amount")} AS sanction_paise,
  {day("recommendation_date")} AS recommendation_date, {day("sanction_date")} AS sanction_date, {blank("work_stage")} AS stage,
  nullif(regexp_extract(activity_name, '^WS/ *MP(\d+)/', 1), '') AS profile,
  nullif(trim(regexp_replace(activity_name, '^WS/ *MP\d+/\d{{4}}-\d{{4}}/\d+-', '')), '') AS activity
FROM {name} WHERE {given("work_recommendation_dtl_id")}
QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY record_id) = 1"""


_SHARED = ["record_id", "cohort", "state", "ida", "description", "recommended_paise", "sanction_paise", "recommendation_date", "sanction_date", "stage", "profile", "activity"]
_KINDS = ["cohort", "work_recommendation_dtl_id", "vendor_id", "vendor_name", "ia_name", "work_status", "work_id", "expenditure_date", "fund_disbursed_amt"]

CTES = {
    "rec": _export("works_recommended"),
    "san": _export("works_sanctioned"),
    "wk": f"""
SELECT coalesce(s.work_key, r.work_key) AS work_key, {", ".join(f"coalesce(s.{c}, r.{c}) AS {c}" for c in _SHARED)},
  s.work_key IS NOT NULL AS is_sanctioned, r.work_key IS NOT NULL AS is_recommended, {fy("coalesce(s.sanction_date, r.sanction_date)")} AS sanction_fy
FROM san s FULL OUTER JOIN rec r ON s.work_key = r.work_key""",
    "pay": f"""
SELECT record_id, cohort, CASE WHEN {given("work_recommendation_dtl_id")} THEN cohort || ':' || {KEY.format("work_recommendation_dtl_id")} END AS work_key,
  CASE WHEN {given("vendor_id")} THEN upper(regexp_replace(vendor_id, '\\s+', '', 'g')) END AS vendor, {blank("vendor_name")} AS vendor_name, {blank("ia_name")} AS agency,
  upper({blank("state_name")}) AS state, upper({blank("ida_name")}) AS ida, {day("expenditure_date")} AS paid_on, {paise("fund_disbursed_amt")} AS paise,
  coalesce(work_status = 'Payment Success', FALSE) AS is_success,
  record_id > min(record_id) OVER (PARTITION BY {", ".join(_KINDS)}) AS is_repeat
FROM expenditure""",
    "led": """
SELECT work_key, count(*) AS payment_rows, count(*) FILTER (WHERE is_success) AS success_rows,
  CAST(coalesce(sum(paise) FILTER (WHERE is_success), 0) AS BIGINT) AS paid_paise, CAST(coalesce(sum(paise) FILTER (WHERE NOT is_success), 0) AS BIGINT) AS pending_paise,
  count(DISTINCT vendor) AS vendors, min(paid_on) AS first_payment, max(paid_on) AS last_payment,
  min(paid_on) FILTER (WHERE is_success) AS first_success, max(paid_on) FILTER (WHERE is_success) AS last_success,
  CAST(coalesce(sum(paise) FILTER (WHERE is_success AND month(paid_on) = 3), 0) AS BIGINT) AS march_paise,
  count(*) FILTER (WHERE is_repeat) AS repeat_rows, bool_or(is_repeat) AS any_repeat, count(DISTINCT strftime(paid_on, '%Y-%m')) AS months
FROM pay WHERE work_key IS NOT NULL GROUP BY work_key""",
    "full_wk": """
SELECT wk.*, coalesce(payment_rows, 0) AS payment_rows, coalesce(success_rows, 0) AS success_rows, coalesce(paid_paise, 0) AS paid_paise,
  coalesce(pending_paise, 0) AS pending_paise, coalesce(vendors, 0) AS vendors, first_payment, last_payment, first_success, last_success,
  coalesce(march_paise, 0) AS march_paise, coalesce(repeat_rows, 0) AS repeat_rows, coalesce(any_repeat, FALSE) AS any_repeat, coalesce(months, 0) AS months,
  CASE WHEN success_rows > 0 AND sanction_paise > 0 THEN CAST(paid_paise AS DOUBLE) / sanction_paise END AS paid_ratio
FROM wk LEFT JOIN led ON wk.work_key = led.work_key""",
}
_NEEDS = {"wk": ["rec", "san"], "led": ["pay"], "full_wk": ["rec", "san", "wk", "pay", "led"]}


def using(*names: str) -> str:
    """``WITH`` these tables and what they need, ready for more tables or the query itself."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*_NEEDS.get(name, []), name) if n not in wanted]
    order = [n for n in CTES if n in wanted]
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order)
