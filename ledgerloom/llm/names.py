"""Problem 1: variant spellings of names typed by people.

Names are reduced to tokens; tokens have phonetic codes. Spellings that share a code (and whatever else must agree)
are compared: tokens by Jaro-Winkler similarity and a table of nicknames, initials with the tokens they may stand for.
A pair is the same person beyond doubt (strong), perhaps (weak), or not. Strong pairs are joined by connected
components; then a spelling that says little, such as initials or a pet name, joins the one component that it fits,
and none if it fits several.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.schemas import extended
from ledgerloom.operators.graph import components
from ledgerloom.session import staged

#: Words before and after a name that aren't part of it.
TITLES = {"shri", "sri", "shree", "smt", "shrimati", "kumari", "km", "dr", "prof", "adv", "honble", "mr", "mrs", "ms", "er", "col", "maj", "gen", "sardar"}
AFTER = {"ji", "mp", "exmp", "ex", "saheb", "sahib"}
#: Honours that are also written on to the end of a name.
GLUED = ("ji", "rao")
#: Words that introduce another name of the same person.
ALSO = {"urf", "alias", "aka", "@"}
#: Second names so common that sharing one says nothing.
COMMON = {"kumar", "kumari", "lal", "devi", "prasad", "singh", "ram", "bai", "bhai", "chandra", "nath"}
#: Nickname table. Household names of northern India that stand for any given name, by common knowledge,
#: without regard to any data; and endings that make a short form of a name.
PET_NAMES = set(
    "babbu babli babloo bachchu bholu bhola billu bindu bittu chhotu chinku chinki chintu chunnu dabbu debu dimpu dolly gabbu gappu ghantu golu gopu guddi guddu gudiya jaggu jittu "
    "kaku kallu kuku lakku lalli lallu lalu laddu mannu mintu mithu mittu monu montu munna munni munnu nannu nanhe nikku nikki pappi pappu pinku pinki pintu puttu rabbu raju ramu "
    "rinku rinki rocky sanju santu sonu sona tillu tinku tipu tinu titu tittu toni tunnu vicky".split()
)
SHORT_ENDINGS = ("u", "i", "o", "a", "ji", "bhai", "da", "ya", "hu", "ku", "bai", "behn", "ben", "babu", "amma", "anna", "appa")

STRONG, WEAK = 2, 1
#: Points of weak pairs that rest on slips alone.
SLIPS = (7,)
#: Letters by which the spelling that asks may fall short of the fullest one of its component.
LEEWAY = 3


def _plain(name: str) -> str:
    text = unicodedata.normalize("NFKD", name)
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    return text.replace("0", "o").replace("1", "l").replace("'", "").replace("’", "")


@functools.lru_cache(maxsize=100_000)
def parsed(name: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """``(tokens, initials, common, other names)`` of a name as typed.

    Hyphens join, full stops and commas divide; titles and honours go; what follows ``urf``, ``alias`` or ``@`` is
    another name.
    """
    text = re.sub(r"[\s,(]+m\.\s*p\.?\)?\s*$", "", _plain(name))
    text = re.sub(r"-\s*", "", text.replace("@", " @ "))
    words = re.sub(r"[^a-z@]+", " ", text).split()
    while words and (words[0] in TITLES):
        words.pop(0)
    while len(words) > 1 and words[-1] in AFTER:
        words.pop()
    tokens, initials, common, other = [], [], [], []
    for i, word in enumerate(words):
        if word in ALSO:
            continue
        if i and words[i - 1] in ALSO:
            other.append(word)
            continue
        word = next((word[: -len(e)] for e in GLUED if word.endswith(e) and len(word) >= len(e) + 6), word)
        if len(word) == 1:
            initials.append(word)
        elif word in COMMON:
            common.append(word)
        elif word not in TITLES and not (word in AFTER and i):
            tokens.append(word)
    return tuple(tokens), tuple(initials), tuple(common), tuple(other)


_FOLDS = [(a, b) for a, b in zip("ee ea oo aa au ou ai ei ck ph bh gh dh th kh jh sh ch w y q x v z".split(), "i i u a o u e e k p b g d t k j s c b i k ks b j".split(), strict=True)]


@functools.lru_cache(maxsize=100_000)
def folded(token: str) -> str:
    """A token with sounds that are written in several ways reduced to one, and doubled letters to single ones."""
    for a, b in _FOLDS:
        token = token.replace(a, b)
    token = re.sub(r"c(?![h])", "k", token)
    return re.sub(r"(.)\1+", r"\1", token)


@functools.lru_cache(maxsize=100_000)
def code(token: str) -> str:
    """Phonetic code: the folded token without vowels after the first letter."""
    f = folded(token)
    return f[:1] + re.sub(r"[aeiou]", "", f[1:])


@functools.lru_cache(maxsize=20_000)
def codes(token: str) -> list[str]:
    """The code, and the codes with one letter left out: a slip in one consonant leaves one of them the same."""
    c = code(token)
    return [c, *{c[:i] + "_" + c[i + 1 :] for i in range(len(c))}, "_" + c, *{c[:i] + "_" + c[i:] for i in range(1, len(c) + 1)}]


@functools.lru_cache(maxsize=100_000)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity; 1 for equal texts, 0 if nothing matches or one is empty."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [b[j] for j in range(len(b)) if used[j]]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


#: The household names as they are folded, without the vowels at their ends.
PETS = {re.sub(r"[aeiou]+$", "", folded(p)) for p in PET_NAMES}
#: Jaro-Winkler similarity from which a token counts as a spelling of a household name, and the most letters it may have.
LIKE_PET, LONGEST_PET = 0.88, 7


@functools.lru_cache(maxsize=100_000)
def household(token: str) -> bool:
    """Whether a token is a household name, whatever vowels it ends in, or a spelling near to one."""
    if len(token) > LONGEST_PET:
        return False
    return re.sub(r"[aeiou]+$", "", folded(token)) in PETS or any(p[0] == token[0] and jaro_winkler(token, p) >= LIKE_PET for p in PET_NAMES)


#: Bits for each letter in :func:`_letters`; longer texts, and those with other signs, are counted letter by letter.
_MOST, _PLAIN = 32, re.compile("[a-z]*").fullmatch


@functools.lru_cache(maxsize=300_000)
def _letters(text: str) -> int:
    """The letters of a token: for each a run of as many bits as the token has of it, in a field of its own; or -1."""
    if len(text) > _MOST or not _PLAIN(text):
        return -1
    out = 0
    for c in set(text):
        out |= ((1 << text.count(c)) - 1) << (ord(c) - 97) * _MOST
    return out


def _spread(a: str, b: str) -> int:
    """Letters in one text beyond those of the other, counted both ways; an edit changes this by two at most."""
    x, y = _letters(a), _letters(b)
    if x >= 0 and y >= 0:
        return (x ^ y).bit_count()
    return sum(abs(a.count(c) - b.count(c)) for c in set(a + b))


def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two texts; ``most + 1`` if more."""
    apart = _spread(a, b)
    if (abs(len(a) - len(b)) + apart) // 2 > most:  # the letters that one text has beyond the other's
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


@functools.lru_cache(maxsize=300_000)
def token_match(a: str, b: str) -> float:
    """1 for the same token give or take one slip, 0.5 for perhaps the same (two slips), 0 otherwise."""
    x, y = folded(a), folded(b)
    if x == y:
        return 1.0
    short = min(len(x), len(y))
    if short < 3 or abs(len(x) - len(y)) > 3:
        return 0.0
    apart = _spread(x, y)
    if apart > 6 and _spread(a, b) > 4:
        return 0.0
    # The most that the similarity can be with so many letters in common, in whatever order.
    shared = (len(x) + len(y) - apart) / 2
    jaro = (shared / len(x) + shared / len(y) + 1) / 3
    prefix = next((k for k in range(min(4, short)) if x[k] != y[k]), min(4, short))
    if jaro + 0.1 * prefix * (1 - jaro) < 0.8 - 1e-9:
        return 0.0
    near = jaro_winkler(x, y)
    if near < 0.8:
        return 0.0
    slips = edits(x, y, 2)
    slips = slips if slips == 1 else min(slips, edits(a, b, 2))
    if slips == 1 and short >= 4 and near >= 0.86:
        return 1.0
    common = next((k for k in range(short) if x[k] != y[k]), short)
    if slips == 2 and short - common <= 4 and len(x) - common > 1 and len(y) - common > 1:
        return 0.0  # another ending is another name of the same family, no slip
    if slips == 2:
        return 0.5 if short >= 5 and near >= 0.85 else 0.0
    return 0.5 if short >= 8 and near >= 0.9 and edits(x, y, 3) == 3 else 0.0


@functools.lru_cache(maxsize=100_000)
def nickname_of(short: str, full: str) -> bool:
    """Whether ``short`` may be a short form of ``full``: its beginning, with or without one of the table's endings, or
    its end; four letters at least without an ending."""
    if len(short) >= len(full) + 2 or len(full) < 5:
        return False
    x, y = folded(short), folded(full)
    if len(short) >= 4 and (y.endswith(x) or full.endswith(short)) and short != full:
        return True
    for ending in ("", *SHORT_ENDINGS):
        stem = short[: len(short) - len(ending)] if ending and short.endswith(ending) else (short if not ending else "")
        if len(stem) >= (2 if ending else 4) and (full.startswith(stem) or (len(folded(stem)) >= 2 and y.startswith(folded(stem)))):
            return True
    return False


def _joined_match(a: list[str], b: list[str]) -> bool:
    """Tokens that were run together or torn apart: some order of one side reads like some order of the other."""
    if not a or not b or len(a) + len(b) < 3 or len(a) > 4 or len(b) > 4:
        return False
    if abs(sum(map(len, a)) - sum(map(len, b))) > 3:
        return False
    if _spread(folded("".join(a)), folded("".join(b))) > 8 and _spread("".join(a), "".join(b)) > 6:
        return False
    whole = [folded("".join(p)) for p in itertools.permutations(b)]
    return any(edits(folded("".join(p)), w, 2) <= (2 if len(w) >= 10 else 1) for p in itertools.permutations(a) for w in whole)


def _mendable(two: tuple[str, ...], one: tuple[str, ...]) -> bool:
    """Whether two tokens of one side together are about as long as one of the other; else nothing is to mend."""
    return any(abs(len(x) + len(y) - len(o)) < 3 for x, y in itertools.combinations(two, 2) for o in one)


def _mended(tokens: tuple[str, ...], letters: tuple[str, ...], other: tuple[str, ...]) -> tuple[str, ...]:
    """Tokens where two neighbours that together make one of the other side are joined, and one that is two neighbours
    of the other side is divided."""
    out, i = [], 0
    while i < len(tokens):
        pair = tokens[i] + tokens[i + 1] if i + 1 < len(tokens) else ""
        if pair and any(abs(len(pair) - len(o)) < 3 and token_match(pair, o) == 1 and token_match(tokens[i], o) < 1 and token_match(tokens[i + 1], o) < 1 for o in other):
            out.append(pair)
            i += 2
            continue
        split = next(((a, b) for a, b in itertools.permutations(other, 2) if len(a) > 2 and len(b) > 2 and abs(len(a) + len(b) - len(tokens[i])) < 3 and token_match(tokens[i], a + b) == 1), None)
        out += split or (tokens[i],)
        i += 1
    return tuple(out)


#: Letters that a token's first letter may become when it is folded stand for one another here.
_HEADS = str.maketrans("aeiouycqxvwz", "aaaaaakkkbbj")


@functools.lru_cache(maxsize=100_000)
def _outline(name: str) -> tuple | None:
    """What :func:`_hopeless` looks at; nothing for names without tokens, with another name, or with odd signs."""
    tokens, initials, common, other = parsed(name)
    facts = [(t, f := folded(t), len(f), _letters(f), _letters(t), t[0].translate(_HEADS), t[-2:], f[-2:], household(t)) for t in tokens]
    if not tokens or other or any(x[3] < 0 or x[4] < 0 for x in facts):
        return None
    return tokens, initials, common, facts, {w[0] for w in (*initials, *common)}, len(tokens) + len(common) + len(initials)


def _hopeless(one: str, two: str) -> bool:
    """Whether :func:`compared` is sure to say 0: one token at most matches, and nothing else speaks for the pair. Where
    this is not plain, it is false."""
    a, b = _outline(one), _outline(two)
    if a is None or b is None:
        return False
    (ta, ia, ca, fa, heads_a, na), (tb, ib, cb, fb, heads_b, nb) = a, b
    fits = []
    for x in fa:
        n, bag, raw = x[2:5]
        for y in fb:
            # As in token_match, which is asked only where letters leave it open.
            if x[1] == y[1] or (-4 < n - y[2] < 4 and ((bag ^ y[3]).bit_count() <= 6 or (raw ^ y[4]).bit_count() <= 4) and token_match(x[0], y[0])):
                fits.append((x, y))
    if len(fits) > 1:
        return False
    left, right = (fa, fb) if not fits else ([x for x in fa if x is not fits[0][0]], [y for y in fb if y is not fits[0][1]])
    if fits:
        # A second token is wanting, so a letter, a household name or a short form must stand for it.
        if ia or ib:
            if (ca and cb) or any(h in heads_b for h in ia) or any(h in heads_a for h in ib) or any(y[0][0] in ia for y in right) or any(x[0][0] in ib for x in left):
                return False
        else:
            for x in left:
                if x[8]:
                    return False
                for y in right:
                    if y[8] or ((x[5] == y[5] or x[6] == y[6] or x[7] == y[7]) and (nickname_of(x[0], y[0]) or nickname_of(y[0], x[0]))):
                        return False
            if any(y[8] for y in right):
                return False
    if len(ta) + len(tb) > 2:
        if (_mendable(ta, tb) or _mendable(tb, ta)) and (_mended(ta, ia, tb) != ta or _mended(tb, ib, ta) != tb):
            return False
        if len(left) + len(right) > 2 and _joined_match([x[0] for x in left], [y[0] for y in right]):
            return False
    return na == nb or not _joined_match([*ta, *ca, *ia], [*tb, *cb, *ib])


def compared(one: str, two: str) -> tuple[int, int]:
    """``(STRONG, WEAK or 0, points)`` for two names as typed; points rank the weak ones."""
    return (0, 0) if _hopeless(one, two) else _compared(one, two)


def _compared(one: str, two: str) -> tuple[int, int]:
    (ta, ia, ca, oa), (tb, ib, cb, ob) = parsed(one), parsed(two)
    if set(ta) != set(tb) and (_mendable(ta, tb) or _mendable(tb, ta)):
        ta, tb = _mended(ta, ia, tb), _mended(tb, ib, ta)
    left, right = list(ta), list(tb)
    same, perhaps = 0, 0
    for level in (1.0, 0.5):
        for x in list(left):
            fit = [t for t in right if token_match(x, t) >= level]
            if fit:
                y = fit[0] if len(fit) == 1 else max(fit, key=lambda t: (token_match(x, t), jaro_winkler(x, t)))
                left.remove(x)
                right.remove(y)
                long = min(len(x), len(y)) >= 4  # a scrap of a torn name is no token of its own
                same += level == 1.0 and long
                perhaps += level < 1.0
    if left and right and _joined_match(left, right):
        same += max(1, min(len(left), len(right)))
        if len(left) + len(right) >= 3 and min(len(left), len(right)) == 1:
            same += 1
        left, right = [], []
    elif (left or right) and len(ta) + len(ca) + len(ia) != len(tb) + len(cb) + len(ib) and _joined_match([*ta, *ca, *ia], [*tb, *cb, *ib]):
        return STRONG, 9
    if not (same or perhaps) and ta and tb:
        return 0, 0
    common_clash = bool(ca and cb and not any(token_match(x, y) for x in ca for y in cb))
    # Initials stand for tokens (or common names) of the other side.
    unmet = 0
    met = 0
    pool_a, pool_b = [*left, *ca, *ia], [*right, *cb, *ib]
    for initials, pool, rest in ((ia, pool_b, right), (ib, pool_a, left)):
        for letter in initials:
            hit = next((t for t in pool if t[0] == letter), None)
            if hit is None:
                unmet += 1
            else:
                met += 1
                pool.remove(hit)
                if hit in rest:
                    rest.remove(hit)
    # Other names and nicknames.
    shared_other = bool(set(oa) & (set(ob) | set(tb))) or bool(set(ob) & set(ta))
    pet = nick = 0
    bare = False
    for mine, theirs, known in ((left, right, oa), (right, left, ob)):
        for x in list(mine):
            if household(x) or any(token_match(x, p) for p in (ob if mine is left else oa)):
                mine.remove(x)
                pet += 1
                if theirs:
                    theirs.pop(0)
                bare = not mine  # the household name stands for all but the family's name
    for mine, theirs in ((left, right), (right, left)):
        for x in list(mine):
            y = next((t for t in theirs if nickname_of(x, t)), None)
            if y is not None and x in mine:
                mine.remove(x)
                theirs.remove(y)
                nick += 1
    if not (ta and tb):
        # One side is all initials: they must be those of the other side.
        return (WEAK, 1) if met >= 2 and not unmet and not (left or right) else (0, 0)
    if unmet == 1 and same and (met or (ca and cb and not common_clash)) and len(left) + len(right) == 1:
        return WEAK, 1  # the letter may be that of a household name
    if unmet:
        return 0, 0
    if left and right:
        return (WEAK, 4) if same >= 2 else (0, 0)
    if same >= 2 and not common_clash:
        return STRONG, 9
    if same >= 1 and shared_other:
        return STRONG, 8
    if same + perhaps >= 2:
        return WEAK, 7
    if same and nick:
        return WEAK, 6
    if same and met:
        return WEAK, 5 if not common_clash else 4
    if same and pet and (bare or not (left or right)):
        return WEAK, 3
    if perhaps and met and not left and not right:
        return WEAK, 2
    return 0, 0


def detail(name: str) -> int:
    """How much a name says: letters of its whole tokens, so initials and household names count for less."""
    tokens, _, common, _ = parsed(name)
    return sum(len(t) for t in tokens if not household(t)) + sum(map(len, common)) // 2


def canonical(name: str) -> str:
    """The same text for spellings that differ in order, case, marks, titles and punctuation only; null-like names give
    an empty text."""
    tokens, initials, common, other = parsed(name)
    return " ".join(sorted([*tokens, *initials, *common])) + ("".join(f" @{o}" for o in sorted(other)))


#: Rows of either side of a block that one task pairs; a fuller block is divided among tasks, and all its pairs still meet.
HOT = 2000


def _spellings(profiles: DataFrame, agree: list[str]) -> DataFrame:
    """``id, name, canonical, detail`` and the columns that must agree, one row for each spelling of a profile."""
    schema = extended(profiles.select("id", "name", *agree).schema, "canonical string, detail int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n or "" for n in batch.column("name").to_pylist()]
            added = [pa.array([canonical(n) for n in names], pa.string()), pa.array([detail(n) for n in names], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "canonical", "detail"])

    return profiles.select("id", "name", *agree).mapInArrow(run, schema).where("canonical <> ''")


def initial_keys(name: str) -> set[str]:
    """First letters, sorted, that a name and any other which it meets by initials alone have in common.

    A name of initials has its letters, with or without those of common names. Any other has those of its tokens and
    initials, with or without those of common and household names and of initials that repeat one of these words.
    """
    tokens, initials, common, _ = parsed(name)
    sure, perhaps = list(initials), [w[0] for w in common]
    if tokens:
        words = {w[0] for w in (*tokens, *common)}
        sure = [w[0] for w in tokens if not household(w)] + [w for w in initials if w not in words]
        perhaps += [w[0] for w in tokens if household(w)] + [w for w in initials if w in words]
    chosen = (c for n in range(len(perhaps) + 1) for c in itertools.combinations(perhaps, n))
    return {"#" + "".join(sorted([*sure, *c])) for c in chosen}


def _keyed(nodes: DataFrame, agree: list[str]) -> DataFrame:
    """A row for each code of each token that another node also has: ``key``, whether it is a code and no row of
    initials (``plain``), whether it holds ``anywhere``, and how many rows and ``seekers`` the block has."""
    schema = extended(nodes.select("node", "name", *agree).schema, "key string, code string, plain boolean, bare boolean, seeks boolean, anywhere boolean")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, whole, plain, bares, seeks, anywhere = [], [], [], [], [], [], []
            first = batch.column(agree[0]).to_pylist()
            for i, name in enumerate(batch.column("name").to_pylist()):
                tokens = parsed(name)[0]
                lost, bare = first[i] is None, not tokens
                words = {code(w): w for w in (*tokens, *(a + b for a, b in itertools.pairwise(tokens)))}  # names torn apart too
                found = {(c, "" if c == own else own) for own, w in words.items() for c in codes(w)}
                found.update((c, "") for c in initial_keys(name))
                for c, own in sorted(found):
                    for where in (False, True):
                        if where or not lost:
                            rows.append(i)
                            keys.append(c if where else f"{first[i]}|{c}")
                            whole.append(own)
                            plain.append(c[0] != "#")
                            bares.append(bare)
                            seeks.append(lost if where else bare and c[0] == "#")
                            anywhere.append(where)
            at = pa.array(rows, pa.int64())
            added = [pa.array(keys, pa.string()), pa.array(whole, pa.string()), *[pa.array(x, pa.bool_()) for x in (plain, bares, seeks, anywhere)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("node", "name", *agree)], *added], names)

    # A row makes many: rows are spread by number, as their few bytes would put them into one task.
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("node", "name", *agree).repartition(spread).mapInArrow(run, schema)
    crowd = keyed.groupBy("anywhere", "plain", "key").agg(F.count(F.lit(1)).alias("crowd"), F.count_if("seeks").alias("seekers"))
    # Codes within a place pair all rows; elsewhere only rows that seek meet the others.
    crowd = crowd.where("crowd > 1 and (seekers > 0 or (plain and not anywhere))")
    return keyed.join(crowd, ["anywhere", "plain", "key"])


def _met(left: DataFrame, right: DataFrame, lefts: str, agree: list[str]) -> DataFrame:
    """The rows of both sides that share a key, as columns ``a_...`` and ``b_...``.

    A block with more than HOT rows on a side (``lefts`` counts the left ones, ``crowd`` the right ones) is cut into
    parts on either side; each part of one side meets each part of the other under a key of its own.
    """
    parts = {"a": F.ceil(F.col(lefts) / HOT), "b": F.ceil(F.col("crowd") / HOT)}

    def side(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        own = F.pmod(F.xxhash64("node"), parts[mine])
        ends = lambda other: (own, other) if mine == "a" else (other, own)
        cells = F.transform(F.sequence(F.lit(0).cast("bigint"), parts[theirs] - 1), lambda other: F.concat_ws("|", F.col("key"), *[x.cast("string") for x in ends(other)]))
        keys = F.when((parts["a"] > 1) | (parts["b"] > 1), cells).otherwise(F.array("key"))
        return df.select(F.explode(keys).alias("key"), *[F.col(c).alias(f"{mine}_{c}") for c in ("node", "name", *agree)])

    return side(left, "a", "b").join(side(right, "b", "a"), "key")


def _compared_pairs(nodes: DataFrame, agree: list[str]) -> DataFrame:
    """``a, b, kind, points``: the pairs of nodes that may be one person."""
    keyed = staged(_keyed(nodes, agree), "keys")
    fits = F.lit(True)
    for c in agree:
        fits &= F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull() | (F.col(f"a_{c}") == F.col(f"b_{c}"))
    # Within a block of one place all meet, but pairs of spellings that are only known by their initials meet the rest.
    # Equal codes meet under the code itself, not again under each of their keys with a consonant left out.
    fresh = "a_code = '' or a_code <> b_code"
    here, plain = keyed.where(~F.col("anywhere")), F.col("plain")
    near = _met(here.where(plain), here.where(plain), "crowd", [*agree, "code"]).where("a_node < b_node").where(fresh).drop("a_code", "b_code")
    bare = _met(here.where("seeks"), here, "seekers", agree).where("a_node <> b_node")
    far = keyed.where("anywhere")
    lost = _met(far.where("seeks"), far, "seekers", [*agree, "code", "plain", "bare"]).where("a_node <> b_node and (a_plain or a_bare or b_bare)").where(fresh).drop("a_code", "b_code", "a_plain", "b_plain", "a_bare", "b_bare")
    columns = [F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")]
    columns += [F.when(F.col("a_node") < F.col("b_node"), F.col(f"{x}_name")).otherwise(F.col(f"{y}_name")).alias(f"name_{x}") for x, y in (("a", "b"), ("b", "a"))]
    columns += [(F.col(f"a_{agree[0]}").isNull() | F.col(f"b_{agree[0]}").isNull()).alias("lost")]
    pairs = near.unionByName(bare).unionByName(lost).where(fits).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [compared(x, y) for x, y in zip(batch.column("name_a").to_pylist(), batch.column("name_b").to_pylist(), strict=True)]
            kind = np.array([k for k, _ in said], dtype=np.int32)
            kind = np.where(np.asarray(batch.column("lost").to_pylist(), dtype=bool), np.minimum(kind, WEAK), kind)
            points = pa.array([p for _, p in said], pa.int32())
            made = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(kind, pa.int32()), points], ["a", "b", "kind", "points"])
            yield made.filter(pa.array(kind > 0))

    # Pairs are compared where they meet, without a shuffle; few are left, and of these some have met more than once.
    return pairs.mapInArrow(run, "a bigint, b bigint, kind int, points int").distinct()


def link_names(rows: DataFrame, key: str, name: str, agree: list[str]) -> DataFrame:
    """``(id, person)`` for every id that has a name: the ids of one person share ``person``, their smallest id.

    ``agree`` are columns of which two ids of one person can't have different values; null fits anything, and the first
    (a place) also makes the blocks. Letter case and blanks in them don't matter. Rows are first reduced to one for
    each id and spelling, so an id with very many rows is nothing special. Null ids and names without letters are left
    out; a repeated row, a name in other order or case changes nothing; an empty table gives no rows. Ids with several
    spellings are one person by themselves.
    """
    clean = [F.max(F.upper(F.nullif(F.trim(F.col(c)), F.lit("")))).alias(f"g{i}") for i, c in enumerate(agree)]
    groups = [f"g{i}" for i in range(len(agree))]
    named = rows.where(F.col(key).isNotNull() & F.col(name).isNotNull())
    places = named.groupBy(F.col(key).cast("bigint").alias("id")).agg(*clean)
    spelled = named.groupBy(F.col(key).cast("bigint").alias("id"), F.regexp_replace(F.lower(name), r"[\s.]+", " ").alias("low")).agg(F.min(name).alias("name")).join(places, "id")
    spellings = staged(_spellings(spelled, groups), "spellings")
    nodes = spellings.groupBy("canonical", *groups).agg(F.min("id").alias("node"), F.min("name").alias("name"), F.max("detail").alias("detail"))
    # The ids of a node; an id with several spellings ties its nodes together.
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in groups]
    ties = spellings.alias("s").join(nodes.alias("n"), [F.col("n.canonical") == F.col("s.canonical"), *same]).select("s.id", "n.node").distinct()
    pairs = staged(_compared_pairs(nodes, groups), "pairs")
    edges = pairs.where(F.col("kind") == STRONG).select("a", "b").unionByName(ties.select(F.col("id").alias("a"), F.col("node").alias("b")))
    edges = staged(edges, "edges")
    about = staged(nodes.groupBy("node").agg(F.max("detail").alias("detail"), *[F.max(c).alias(c) for c in groups]), "nodes")
    weak = pairs.where(F.col("kind") == WEAK)
    roots = staged(components(edges, "a", "b"), "roots")
    while True:  # each round leaves fewer components than the one before
        size = about.join(roots, "node").groupBy("root").agg(F.max("detail").alias("detail"), F.count(F.lit(1)).alias("nodes"), *[F.max(c).alias(c) for c in groups])
        end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        said = lambda c: about.select(F.col("node").alias(c), F.col("detail").alias(f"said_{c}"))
        between = weak.join(end("a"), "a").join(end("b"), "b").where("ra <> rb").join(said("a"), "a").join(said("b"), "b")
        known = lambda c: size.select(F.col("root").alias(c), F.col(groups[0]).isNotNull().alias(f"placed_{c}"), F.col("detail").alias(f"d{c}"), F.col("nodes").alias(f"n{c}"), *[F.col(g).alias(f"{g}{c}") for g in groups])  # noqa: B023, E731
        fits = [F.coalesce(F.col(f"{g}ra") == F.col(f"{g}rb"), F.lit(True)) for g in groups]
        between = between.join(known("ra"), "ra").join(known("rb"), "rb").where(reduce(Column.__and__, fits))
        # The spelling without a place, or that says less, asks; but not if its component knows more than it says.
        low = F.struct("placed_ra", "said_a", "ra") < F.struct("placed_rb", "said_b", "rb")
        open_a = (~F.col("placed_ra") & F.col("placed_rb")) | (F.col("said_a") >= F.col("dra") - LEEWAY)
        open_b = (~F.col("placed_rb") & F.col("placed_ra")) | (F.col("said_b") >= F.col("drb") - LEEWAY)
        between = between.where(F.when(low, open_a).otherwise(open_b))
        # A slip isn't made again and again: what several spellings agree on is no slip of another name.
        slip = F.col("points").isin(*SLIPS) & (F.col("nra") > 2) & (F.col("nrb") > 2)
        between = between.where(~slip)
        asked = between.select(F.when(low, F.col("ra")).otherwise(F.col("rb")).alias("who"), F.when(low, F.col("rb")).otherwise(F.col("ra")).alias("of"), "points")
        asked = asked.groupBy("who", "of").agg(F.max("points").alias("points"))
        best = asked.groupBy("who", "points").agg(F.count_distinct("of").alias("ways"), F.min("of").alias("of")).groupBy("who").agg(F.max_by(F.struct("ways", "of"), "points").alias("one"))
        chosen = staged(best.where("one.ways = 1").select(F.col("who").alias("a"), F.col("one.of").alias("b")), "chosen")
        if chosen.isEmpty():
            break
        joined = components(chosen, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("new"))
        roots = staged(roots.join(joined, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
    return roots.join(spellings.select(F.col("id").alias("node")).distinct(), "node").select(F.col("node").alias("id"), F.col("root").alias("person"))


def person_pairs(linked: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of ids of one person, a < b; as many as the result is defined to have."""
    one, two = linked.select("person", F.col("id").alias("a")), linked.select("person", F.col("id").alias("b"))
    return one.join(two, "person").where("a < b").select("a", "b")
