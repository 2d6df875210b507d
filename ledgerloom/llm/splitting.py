"""Problem 8: splitting oversized items at natural boundaries (recursive bisection).

A text above the limit is cut at the strongest boundary near its middle; halves that exceed the limit minus the
overlap are cut again, and at last every piece but the first is extended backwards by the overlap. Sizes are in
tokens of the text's own token sequence, so a piece is a run of tokens and neighbours share exactly the tokens of the
overlap (up to three more where a token's border falls inside a character).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.schemas import extended
from ledgerloom.llm.tokens import KINDS, NONE, Places, places, token_ids, vocabulary_path

#: Around the middle of a segment, the part of it in which the strongest boundary is looked for.
NEAR = 0.5
#: A border may have to move by so many tokens to lie between characters.
SLACK = 3


def cuts(at: Places, first: int, last: int, most: int, least: int = 1) -> list[int]:
    """Borders that divide tokens ``[first, last)`` into segments of at most ``most`` tokens, by bisection, and of at
    least ``least`` where the segment that is cut has twice as many.

    The boundary is the strongest in the middle half, the nearest to the middle among equals (the left one of two);
    without any there, the one nearest to the middle in the whole segment; in a text without blanks, the border
    between characters nearest to the middle. A segment without such a border is left whole: that takes a limit
    below the tokens of one character.
    """
    out: list[int] = []
    stack = [(first, last)]
    while stack:
        a, b = stack.pop()
        size = b - a
        if size <= most:
            if b != last:
                out.append(b)
            continue
        middle, reach = a + size / 2, max(1, int(size * NEAR / 2))
        edge = max(1, min(least, size // 2))
        low, high = max(a + edge, int(middle) - reach), min(b - edge + 1, int(middle) + reach + 1)
        cut = next((c for of in at.ranked[:NONE:-1] if (c := _nearest(of, middle, low, high)) is not None), None)
        if cut is None:  # far from the middle, nearness counts more than strength
            low, high = a + edge, b - edge + 1
            cut = _nearest(at.natural, middle, low, high)
        if cut is None:
            cut = _nearest(at.ranked[NONE], middle, low, high)
        if cut is None:
            cut = _nearest(at.between, middle, a + 1, b)
        if cut is None:
            if b != last:
                out.append(b)
            continue
        stack += [(cut, b), (a, cut)]
    return out


def _nearest(borders: list[int], middle: float, low: int, high: int) -> int | None:
    """The border in ``[low, high)`` nearest to the middle, the left one of two; None if there is none."""
    i = bisect_left(borders, middle)
    left = borders[i - 1] if i and low <= borders[i - 1] < high else None
    right = borders[i] if i < len(borders) and low <= borders[i] < high else None
    if left is None or right is None:
        return right if left is None else left
    return left if middle - left <= right - middle else right


def full_cuts(at: Places, most: int) -> list[int]:
    """Borders that divide all tokens into segments as near to ``most`` as natural boundaries allow.

    Each segment ends at the strongest boundary in the last sixteenth of its room, the last one among equals; without
    any there at the last one before, and without any at all at the last border between characters.
    """
    n, a, out = len(at.byte) - 1, 0, []
    while n - a > most:
        high = a + most + 1
        low = max(a + 1, high - max(1, most // 16))
        for begin in (low, a + 1):
            kind = np.where(at.whole[begin:high], at.kind[begin:high], -1)
            if begin == a + 1:
                kind = np.minimum(kind, NONE + 1)
            if kind.max(initial=-1) > NONE:
                break
        best = kind.max(initial=-1)
        a = begin + int(np.flatnonzero(kind == best)[-1]) if best >= 0 else high - 1
        out.append(a)
    return out


def pieces(text: str, most: int, overlap: int, path: str, at: Places | None = None) -> list[tuple[int, int, int, int, int]]:
    """``(char_start, char_end, tokens, shared, kind)`` of each piece in order; one piece if the text is within the limit.

    ``shared`` counts the tokens a piece has in common with the one before, ``kind`` is the boundary at its end. The
    overlap must leave room: ``overlap + SLACK < most``; where it leaves so little that a piece is shorter than the
    overlap, neighbours share the whole piece. A text without tokens has no pieces.
    """
    if not 0 <= overlap < most - SLACK:
        raise ValueError(f"an overlap of {overlap} doesn't fit into pieces of {most}")
    at = at or places(text, path)
    n = len(at.byte) - 1
    if n == 0:
        return []
    ends = [n] if n <= most else [*cuts(at, 0, n, most - overlap - (SLACK if overlap else 0), overlap + 1), n]
    out, begin = [], 0
    for end in ends:
        start = begin
        if begin and overlap:
            start = max(0, begin - overlap)
            while not at.whole[start]:
                start -= 1
        out.append((int(at.char[start]), int(at.char[end]), end - start, begin - start, int(at.kind[end])))
        begin = end
    return out


def split_texts(df: DataFrame, key: str, text: str, limits: list[tuple[int, int, int]], path: str | None = None) -> DataFrame:
    """Numbered pieces of the texts above each limit ``(limit_id, max_tokens, overlap_tokens)``.

    Columns ``limit_id, key, piece_no, pieces, char_start, char_end, tokens, shared_tokens, cut_at, text``. Offsets
    count code points. Null and empty texts and texts within a limit have no pieces there; a repeated text is split
    wherever it stands. Whole texts are used whatever their length. A text is tokenized once for all limits; there is
    no shuffle.
    """
    path = path or vocabulary_path()
    names = ["limit_id", "piece_no", "pieces", "char_start", "char_end", "tokens", "shared_tokens"]
    schema = extended(df.select(key).schema, ", ".join(f"{name} int" for name in names) + ", cut_at string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, cells, kinds, out = batch.column(1).to_pylist(), [], [], [], []
            for i, t in enumerate(texts):
                ids = token_ids(t, path)
                n = len(ids)
                if n <= min((m for _, m, _ in limits), default=n):
                    continue
                at = places(t, path, ids)
                for limit, most, overlap in limits:
                    if n <= most:
                        continue
                    made = pieces(t, most, overlap, path, at)
                    for no, (a, b, tokens, shared, kind) in enumerate(made):
                        rows.append(i)
                        cells.append((limit, no, len(made), a, b, tokens, shared))
                        kinds.append("end" if no == len(made) - 1 else KINDS[kind])
                        out.append(t[a:b])
            columns = np.array(cells, dtype=np.int32).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(columns[:, j]) for j in range(len(names))], pa.array(kinds, pa.string()), pa.array(out, pa.string())],
                [key, *names, "cut_at", "text"],
            )

    # A token has a byte at least, so texts of no more bytes than the lowest limit needn't be tokenized.
    perhaps = df.select(key, df[text].alias("__text")).where(F.octet_length("__text") > min((m for _, m, _ in limits), default=0))
    return perhaps.mapInArrow(run, schema)
