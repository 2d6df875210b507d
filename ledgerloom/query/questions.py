"""Questions in plain English, compiled to one query without a language model.

A question is read once from left to right. At each place the longest phrase of a lexicon becomes a mark (a measure, a
grouping, a filter, a rank, a number and so on); other words only keep their distance. What the marks say together is
looked up in small tables: which measure is meant, one figure or a ranking, which way, and how many rows. Values reach
the query as bound parameters; text of the question never becomes SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.query.listing import resolved_names

LONGEST_QUESTION, MOST_ROWS, USUAL_ROWS = 300, 50, 10
#: Shares and means of a group say something from so many works on.
SUPPORT = 20


@dataclass(frozen=True)
class Measure:
    """What can be asked for: SQL over works, kind of value, whether more is better (None: neither), the column it needs."""

    sql: str
    kind: str = "count"
    more_is_better: bool | None = None
    needs: str | None = None
    over_payments: str | None = None


def _counted(column: str, more_is_better: bool | None = False) -> Measure:
    return Measure(f"count_if({column})", "count", more_is_better, column)


#: The last one is meant if a question names a group or a filter, but no measure.
MEASURES = {
    "sanction_paise": Measure("sum(sanction_paise)", "money"),
    "paid_paise": Measure("sum(paid_paise)", "money", over_payments="sum(CASE WHEN is_success THEN paise ELSE 0 END)"),
    "pending_paise": Measure("sum(pending_paise)", "money", over_payments="sum(CASE WHEN is_success THEN 0 ELSE paise END)"),
    "mean_sanction": Measure("avg(sanction_paise)", "mean"),
    "mean_score": Measure("avg(score)", "mean", False, "score"),
    "paid_share": Measure("sum(paid_paise) / nullif(sum(sanction_paise), 0)", "share", True),
    "completed_share": Measure("count_if(is_completed) / nullif(count_if(is_sanctioned), 0)", "share", True, "is_completed"),
    "high_score": Measure("count_if(band IN ('high', 'critical'))", "count", False, "band"),
    "sanctioned": _counted("is_sanctioned", None),
    "completed": _counted("is_completed", True),
    "open_long": _counted("open_over_year"),
    "unpaid": _counted("unpaid_3_months"),
    "slow_sanction": _counted("slow"),
    "not_sanctioned": _counted("pending_45_days"),
    "over_paid": _counted("over_paid"),
    "over_completed": _counted("completion_over_sanction"),
    "march": _counted("march"),
    "repeats": _counted("any_repeat"),
    "completed_unpaid": _counted("completed_unpaid"),
    "dear": _counted("cost_outlier"),
    "alike": _counted("has_similar"),
    "works": Measure("count(*)", over_payments="count(DISTINCT work_key)"),
}
#: Phrases of measures; ``a|b`` are alternatives for one word.
SAID = {
    "sanction_paise": "sanction|sanctioned|sanctions amount|amounts|value|money|funds; funds|money|amount|amounts sanctioned; value of sanctions",
    "paid_paise": "paid; payments|payment; spent|spending|spend; settled|settlement|settlements; disbursed|disbursement|disbursements; expenditure; money|funds|amount paid|spent|disbursed",
    "pending_paise": "pending|unsettled|outstanding payments|payment|amount|amounts|money; payments|payment pending|outstanding|in progress; unsettled; pending",
    "mean_sanction": "average|mean|typical cost|amount|value|sanction",
    "mean_score": "priority|review score|scores",
    "paid_share": "settled|paid to|against|of sanction|sanctioned|sanctions; utilisation|utilization; spend|payment|spending ratio|rate",
    "high_score": "high|critical priority; high|critical score|scores; high risk; flagged works|projects; need|needs|needing review|attention",
    "sanctioned": "sanctioned works|projects; works|projects sanctioned; sanctioned|approved",
    "completed": "completed|finished works|projects; works|projects completed|finished; completed|finished|completions",
    "open_long": "delays|delay|delayed|overdue|late; open over|beyond|after a|one year; unfinished after a|one year; stuck|stalled",
    "unpaid": "no|without payment|payments|spending; unpaid|untouched; never paid",
    "slow_sanction": "sanction|approval delay|delays; slow|late sanction|sanctions|approval|approvals; delayed sanction|sanctions|approval",
    "not_sanctioned": "awaiting|waiting sanction|approval; awaiting|waiting for sanction|approval; not|never|yet sanctioned|approved; pending recommendations|recommendation|sanction|sanctions|approval",
    "over_paid": "overpaid|overspent; paid|payments|payment|spent over|above|beyond|exceeding sanction|sanctions|sanctioned; paid more than sanctioned",
    "over_completed": "completion|completed cost|amount|costs|amounts over|above|beyond sanction; completion|completed over|above|beyond sanction; cost overrun|overruns",
    "march": "march rush|spending|payments; year end rush|spending; rush",
    "repeats": "repeat|repeated|duplicate|duplicated|double payment|payments; paid twice",
    "dear": "cost outliers|outlier; unusually|unusual costly|expensive|high cost|costs; outliers; costly|expensive works|projects",
    "alike": "similar|duplicate|duplicated|alike works|projects|descriptions; near duplicates; duplicates",
    "works": "works|work; projects|project; recommendations",
}
#: What two measures said together mean, and what a measure means beside a word for a share or a mean.
TOGETHER = {frozenset({"completed", "unpaid"}): "completed_unpaid", frozenset({"completed", "sanctioned"}): "completed"}
AS_SHARE = {"paid_paise": "paid_share", "sanction_paise": "paid_share", "completed": "completed_share", "completed_unpaid": "completed_unpaid"}
AS_MEAN = {"sanction_paise": "mean_sanction", "sanctioned": "mean_sanction", "high_score": "mean_score", "mean_score": "mean_score"}
#: Columns that works can be grouped by (``vendor`` and ``month``: payments), and the words for them.
GROUPED = {
    "ida": "district|districts authority|authorities; district|districts; authority|authorities; agency|agencies",
    "profile": "member|members of parliament; member|members; mp|mps; parliamentarian|parliamentarians",
    "activity": "kind|kinds|type|types of work|works; activity|activities; category|categories; sector|sectors",
    "sanction_fy": "financial|fiscal|sanction year|years; year|years",
    "cohort": "cohort|cohorts; chamber|chambers; house|houses",
    "band": "priority|score band|bands; band|bands",
    "vendor": "vendor|vendors; contractor|contractors; supplier|suppliers; payee|payees",
    "state": "state|states; region|regions",
    "month": "month|months|monthly",
}
COHORTS = {
    ("lok_sabha",): "lok sabha; lower house|chamber",
    ("rs_sitting",): "rajya sabha sitting; sitting members|member|mps; sitting",
    ("rs_retired",): "rajya sabha retired; retired members|member|mps; former members|mps; retired",
    ("rs_sitting", "rs_retired"): "rajya sabha; upper house|chamber",
}
RANKS = {
    "many": "top|highest|most|largest|biggest|greatest|leading|maximum|max",
    "few": "bottom|lowest|least|fewest|smallest|minimum|min",
    "bad": "worst|poorest|weakest",
    "good": "best|strongest|healthiest",
}
#: Whether a ranking begins at the large end, by the sense of its word and by whether more of the measure is better.
LARGE_FIRST = {
    ("many", True): True, ("many", False): True, ("many", None): True,
    ("few", True): False, ("few", False): False, ("few", None): False,
    ("bad", True): False, ("bad", False): True, ("bad", None): True,
    ("good", True): True, ("good", False): False, ("good", None): False,
}
OTHERS = {
    "ask": "which|what|who|list|show|compare|rank|ranking|give",
    "count": "how many|much; number|total|sum|count of; total|overall|altogether",
    "share": "ratio|rate|share|percentage|percent|proportion",
    "mean": "average|mean|typical",
    "place": "first|last",
    "by": "by|per|each|every|across",
    "fiscal": "fy; financial|fiscal year",
    "blame": "corrupt|corruption|fraud|fraudulent|guilty|criminal|criminals|scam|scams|bribe|bribes|bribery|thief|thieves|steal|stole|stolen|cheat|cheats|crook|crooks",
    "future": "predict|predicts|predicted|prediction|predictions; forecast|forecasts; will; next month|year; future; going to; tomorrow",
}
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)} | {"fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50}
SPANS = {"day", "days", "week", "weeks", "month", "months", "year", "years"}
#: One figure (not a ranking) without a group, by: is there a filter, a word for counting, a word for ranking, another
#: word that asks for a list.
ONE_FIGURE = {(True, True, False, False), (True, True, True, False), (True, True, False, True), (True, True, True, True), (True, False, False, False), (False, True, False, False), (False, True, False, True)}


@dataclass(frozen=True)
class Mark:
    """A phrase's meaning: its kind and value, the place of its first word and how many words it has."""

    kind: str
    value: object
    at: int
    words: int


@dataclass(frozen=True)
class Refusal:
    """Why a question has no answer."""

    question: str
    reason: str


@dataclass(frozen=True)
class Choice:
    """Several entities of that name: ``names`` has their keys and names, so one can be asked for."""

    question: str
    names: DataFrame


@dataclass(frozen=True)
class Intent:
    """What a question asks for."""

    measure: str
    group: str | None
    filters: dict[str, list[str]] = field(default_factory=dict)
    descending: bool = True
    limit: int = USUAL_ROWS
    notes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Answer:
    """The compiled query with its parameters and result."""

    question: str
    interpretation: str
    sql: str
    params: dict[str, str]
    columns: list[tuple[str, str]]
    rows: DataFrame
    notes: tuple[str, ...]

    def summary(self) -> str:
        """A sentence about the first row; ``None found`` for a ranking without rows."""
        row = self.rows.first()
        if row is None:
            return "None found"
        return f"{row['name']} comes first with {row['value']}" if "name" in self.rows.columns else f"{row['value']} over {row['works']} works"


def plain(text: str) -> str:
    """Lower case, only letters, digits and single blanks."""
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def _phrases(said: str) -> Iterable[tuple[str, ...]]:
    """All word sequences that a text of alternatives stands for."""
    for phrase in said.split(";"):
        grown: list[tuple[str, ...]] = [()]
        for word in phrase.split():
            grown = [(*before, choice) for before in grown for choice in word.split("|")]
        yield from grown


def _lexicon() -> dict[tuple[str, ...], list[tuple[str, object]]]:
    tables = [("measure", SAID), ("group", GROUPED), ("cohort", COHORTS), ("rank", RANKS)]
    out: dict[tuple[str, ...], list[tuple[str, object]]] = {}
    for kind, table in [*tables, *((k, {True: said}) for k, said in OTHERS.items())]:
        for value, said in table.items():
            for phrase in _phrases(said):
                out.setdefault(phrase, []).append((kind, value))
    for word, number in NUMBERS.items():
        out.setdefault((word,), []).append(("number", number))
    return out


LEXICON = _lexicon()
LONGEST_PHRASE = max(map(len, LEXICON))


def marks(question: str, states: Sequence[str]) -> list[Mark]:
    """The marks of a question. A state's name is a phrase like any other; a number with a unit of time is a span, two
    numbers that follow each other as years are a fiscal year (``None`` if they don't)."""
    words = re.findall("[a-z0-9]+", question.lower())
    hyphened = {m.group() for m in re.finditer(r"\d+\s*[-/–]\s*\d+", question)}
    lexicon = dict(LEXICON)
    for state in sorted(states, reverse=True):
        lexicon[tuple(plain(state).split())] = [("state", state)]
    longest = max([LONGEST_PHRASE, *(len(p) for p in lexicon)])
    out: list[Mark] = []
    at = 0
    while at < len(words):
        if words[at].isdigit():
            after = words[at + 1] if at + 1 < len(words) else ""
            paired = len(words[at]) == 4 and words[at].startswith("20") and after.isdigit() and (len(after) == 2 or (len(after) == 4 and after.startswith("20")))
            joined = any(re.fullmatch(rf"{words[at]}\s*[-/–]\s*{after}", h) for h in hyphened)
            if paired and (joined or (out and out[-1].kind == "fiscal" and out[-1].at + out[-1].words == at)):
                first = int(words[at])
                follows = (first + 1) % 100 == int(after) % 100 and (len(after) == 2 or int(after) == first + 1)
                out.append(Mark("year", f"{first}-{first + 1}" if follows else None, at, 2))
                at += 2
                continue
        size = next((n for n in range(min(longest, len(words) - at), 0, -1) if tuple(words[at : at + n]) in lexicon), 0)
        meant = lexicon.get(tuple(words[at : at + size]), []) if size else []
        if not size and words[at].isdigit() and len(words[at]) <= 3:
            meant, size = [("number", int(words[at]))], 1
        if meant and meant[0][0] == "number" and at + 1 < len(words) and words[at + 1] in SPANS:
            meant, size = [("span", None)], 2
        out += [Mark(kind, value, at, size) for kind, value in meant]
        at += max(1, size)
    return out


def _measure(found: list[Mark]) -> str | None:
    """The measure that is meant: combinations first, then the longest phrase, the earlier of equals; ``works`` last."""
    said = [m for m in found if m.kind == "measure"]
    kinds = {m.kind for m in found}
    named = {m.value for m in said}
    best = next((whole for parts, whole in TOGETHER.items() if parts <= named), None)
    if best is None:
        ranked = sorted(said, key=lambda m: (m.value == "works", -m.words, m.at))
        best = ranked[0].value if ranked else None
    if "share" in kinds:
        best = AS_SHARE.get(best, best)
    if "mean" in kinds:
        best = AS_MEAN.get(best, best)
    return best


def _group(found: list[Mark]) -> str | None:
    """The grouping: what stands after ``by`` and the like, else what is named first."""
    groups = [m for m in found if m.kind == "group"]
    ends = {m.at + m.words for m in found if m.kind == "by"}
    first = sorted(groups, key=lambda m: (m.at not in ends, m.at))
    return first[0].value if first else None


def _rows(found: list[Mark]) -> int:
    """Rows asked for: a number right after a word for ranking, or before a group with one word at most in between."""
    ranks = {m.at + m.words for m in found if m.kind in ("rank", "place")}
    groups = {m.at for m in found if m.kind == "group"}
    asked = [m.value for m in found if m.kind == "number" and (m.at in ranks or m.at + 1 in groups or m.at + 2 in groups)]
    return max(1, min(MOST_ROWS, asked[0])) if asked else USUAL_ROWS


def understood(question: str, states: Sequence[str], columns: Iterable[str] | None = None) -> Intent | Refusal:
    """The intent of a question, or why it is refused. ``columns``: those the works have (None: all that are needed)."""
    if not question.strip():
        return Refusal(question, "nothing was asked")
    if len(question) > LONGEST_QUESTION:
        return Refusal(question, f"a question has {LONGEST_QUESTION} characters at most")
    found = marks(question, states)
    kinds = {m.kind for m in found}
    for kind, reason in (("blame", "the records show payments and dates, not guilt"), ("future", "the records say nothing about the future")):
        if kind in kinds:
            return Refusal(question, reason)
    years = [m.value for m in found if m.kind == "year"]
    if None in years:
        return Refusal(question, "a fiscal year is two years that follow each other")
    filters: dict[str, list[str]] = {"sanction_fy": years[:1]} if years else {}
    filters |= {k: [m.value] for k in ("state",) for m in found[::-1] if m.kind == k}
    filters |= {"cohort": list(m.value) for m in found[::-1] if m.kind == "cohort"}
    # "Financial year" before a year names no group.
    begins = {m.at for m in found if m.kind == "year"}
    measure, group = _measure(found), _group([m for m in found if not (m.kind == "group" and m.at + m.words in begins)])
    if measure is None and not (filters or group):
        return Refusal(question, "no measure was recognised")
    measure = measure or "works"
    if group == "state" and "state" in filters:
        group = "ida"
    senses = [m.value for m in found if m.kind == "rank"]
    if group is None and (bool(filters), "count" in kinds, bool(senses), "ask" in kinds) not in ONE_FIGURE:
        group = "state"
    about = MEASURES[measure]
    if group in ("vendor", "month"):
        if about.over_payments is None or (group == "month" and measure == "works"):
            return Refusal(question, f"a {group} is known by its payments alone")
        if set(filters) - ({"state"} if group == "month" else set()):
            return Refusal(question, "vendors are known without filters, months for all or for one state")
    elif columns is not None and about.needs and about.needs not in columns:
        return Refusal(question, f"these works have no {about.needs}")
    sense = next((s for s in ("good", "bad", "many", "few") if s in senses), "many")
    averaged = "mean" in kinds and about.kind not in ("mean", "share")
    return Intent(measure, group, filters, LARGE_FIRST[sense, about.more_is_better], _rows(found), ("totals are shown, no averages",) if averaged else ())


def compiled(intent: Intent) -> tuple[str, dict[str, str]]:
    """SQL text over ``works`` (or ``payments``) and its parameters. Only fixed fragments become SQL."""
    about = MEASURES[intent.measure]
    source, value = ("payments", about.over_payments) if intent.group in ("vendor", "month") else ("works", about.sql)
    bound = {f"{column}_{i}": v for column, values in sorted(intent.filters.items()) for i, v in enumerate(values)}
    tests = [f"{column} IN ({', '.join(f':{column}_{i}' for i in range(len(values)))})" for column, values in sorted(intent.filters.items())]
    said = f"count(*) AS works, {value} AS value FROM {source}"
    if intent.group is None:
        return f"SELECT {said}" + (f" WHERE {' AND '.join(tests)}" if tests else ""), bound
    name = "date_format(paid_on, 'yyyy-MM')" if intent.group == "month" else intent.group
    kept = ""
    if about.kind in ("share", "mean"):
        kept = f" HAVING count(*) >= {SUPPORT}"
    elif about.kind == "count" and about.needs not in (None, "is_sanctioned") and intent.descending:
        kept = f" HAVING {value} > 0"
    way = "DESC NULLS LAST" if intent.descending else "ASC NULLS FIRST"
    return f"SELECT {name} AS name, {said} WHERE {' AND '.join([*tests, f'{name} IS NOT NULL'])} GROUP BY {name}{kept} ORDER BY value {way}, works DESC, name LIMIT {intent.limit}", bound


def states_in(question: str, states: DataFrame) -> list[str]:
    """The states of a one-column table whose names stand in a question: found where the table lies, so only as many
    come back as a question has places for. Of names that differ in punctuation alone the smallest stands for all."""
    name = F.col(states.columns[0])
    form = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    hit = states.select(form.alias("form"), name.alias("name")).where((F.length("form") > 0) & F.lit(f" {plain(question)} ").contains(F.concat(F.lit(" "), F.col("form"), F.lit(" "))))
    return [r["name"] for r in hit.groupBy("form").agg(F.min("name").alias("name")).collect()]


def asked(question: str, works: DataFrame, payments: DataFrame, states: DataFrame | None = None, names: DataFrame | None = None) -> Answer | Choice | Refusal:
    """Answer a question from a table of works with payments and the payments' ledger.

    ``states``: a table of state names (default: those of the works). ``names``: ``kind, key, name, phrase`` of entities
    of which one may be named instead of a group; ``kind`` is the works' column. Several of one name are a choice.
    """
    if not question.strip() or len(question) > LONGEST_QUESTION:
        return understood(question, [])
    intent = understood(question, states_in(question, works.select("state") if states is None else states), works.columns)
    if isinstance(intent, Refusal) and intent.reason != "no measure was recognised":
        return intent
    if names is not None:
        hits = resolved_names(names, plain(question))
        few = hits.take(2)
        if len(few) > 1:
            return Choice(question, hits)
        if few and (isinstance(intent, Refusal) or intent.group not in ("vendor", "month", few[0]["kind"])):
            before = Intent("works", None) if isinstance(intent, Refusal) else intent
            kinds = {m.kind for m in marks(question, [])}
            intent = Intent(before.measure, None if not kinds & {"group", "rank"} else before.group, before.filters | {few[0]["kind"]: [few[0]["key"]]}, before.descending, before.limit, before.notes)
    if isinstance(intent, Refusal):
        return intent
    sql, params = compiled(intent)
    source = "payments" if intent.group in ("vendor", "month") else "works"
    rows = works.sparkSession.sql(sql.replace(f"FROM {source}", f"FROM {{{source}}}"), args=params, **{source: payments if source == "payments" else works})
    said = f"{intent.measure} by {intent.group or 'all'}" + "".join(f", {k} = {' or '.join(v)}" for k, v in sorted(intent.filters.items()))
    columns = ([("name", "text")] if intent.group else []) + [("works", "count"), ("value", MEASURES[intent.measure].kind)]
    return Answer(question, said, sql, params, columns, rows, intent.notes)
