"""Tokens of a public byte-level vocabulary, with their places and the natural boundaries between them."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.functions.schemas import extended

#: File of the vocabulary (ranks of byte pairs) in the installed package of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

NONE, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
KINDS = ["none", "word", "sentence", "line", "paragraph"]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed package keeps a vocabulary; any other path may be given to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a vocabulary file and the byte length of each token; read once in a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_count(text: str, path: str) -> int:
    """Tokens of a text; strings of special tokens are ordinary text."""
    return len(token_ids(text, path))


#: Longest text that is handed to the encoder at once; longer ones go in parts cut where the encoder splits anyway.
PART = 1 << 20


def token_ids(text: str, path: str) -> np.ndarray:
    """The tokens of a text."""
    encoder, _ = encoding(path)
    if len(text) <= PART:
        return encoder.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PART)
        if end < len(text):
            # A line's end that neither follows nor precedes white space always divides tokens.
            cut = max((i for i in range(end - 1, max(at, end - 65536), -1) if text[i] == "\n" and not text[i - 1].isspace() and not text[i + 1].isspace()), default=None)
            end = end if cut is None else cut
        parts.append(encoder.encode_to_numpy(text[at:end], disallowed_special=()))
        at = end
    return np.concatenate(parts)


@dataclass(frozen=True)
class Places:
    """Token borders of a text. Border i lies before token i; there is one more border than tokens.

    ``byte`` and ``char`` are its offsets, ``whole`` tells whether it lies between characters, ``kind`` the strongest
    natural boundary there: a paragraph's, line's, sentence's or word's end (the white space may lie on either side).
    """

    byte: np.ndarray
    char: np.ndarray
    whole: np.ndarray
    kind: np.ndarray

    @functools.cached_property
    def ranked(self) -> list[list[int]]:
        """For each kind from NONE on the borders between characters that are of it, in order."""
        kinds = np.where(self.whole, self.kind, -1)
        return [np.flatnonzero(kinds == k).tolist() for k in range(len(KINDS))]

    @functools.cached_property
    def natural(self) -> list[int]:
        """All borders between characters that are natural boundaries, in order."""
        return np.flatnonzero(self.whole & (self.kind > NONE)).tolist()

    @functools.cached_property
    def between(self) -> list[int]:
        """All borders between characters, in order."""
        return np.flatnonzero(self.whole).tolist()


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FULL_STOP = np.zeros(256, dtype=bool)
FULL_STOP[[ord(c) for c in ".!?"]] = True
CLOSING = np.zeros(256, dtype=bool)
CLOSING[[ord(c) for c in "\"')]"]] = True


def places(text: str, path: str, ids: np.ndarray | None = None) -> Places:
    """Tokens of a text (``ids`` if they are known) and what lies between them."""
    ids = token_ids(text, path) if ids is None else ids
    _, lengths = encoding(path)
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    n = len(data)
    border = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(lengths[ids], out=border[1:])
    if n == len(text):  # only ASCII: every byte is a character
        char, whole = border, np.ones(len(border), dtype=bool)
    else:
        lead = (data & 0xC0) != 0x80
        chars = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(lead, out=chars[1:])
        char, whole = chars[border], np.append(lead, True)[border]
    kind = np.zeros(len(border), dtype=np.int8)
    blanks = np.flatnonzero(SPACE[data])
    if not len(blanks):
        return Places(border, char, whole, kind)
    # Runs of white space: where they begin and end, how many line breaks they hold, and what they end.
    gaps = np.flatnonzero(np.diff(blanks) != 1)
    begins, ends = blanks[np.append(0, gaps + 1)], blanks[np.append(gaps, len(blanks) - 1)] + 1
    newlines = np.flatnonzero(data == 10)
    breaks = np.searchsorted(newlines, ends) - np.searchsorted(newlines, begins)
    # A sentence ends before a run of white space if the last letter is a full stop, a danda or a mark like them.
    last = begins - 1
    last = np.where((last > 0) & CLOSING[data[last]], last - 1, last)
    stop = (last >= 0) & FULL_STOP[data[last]]
    if n != len(text):
        stop |= (last >= 2) & (data[last] >= 0xA4) & (data[last] <= 0xA5) & (data[last - 1] == 0xA5) & (data[last - 2] == 0xE0)
    strength = np.where(breaks > 1, PARAGRAPH, np.where(breaks == 1, LINE, np.where(stop, SENTENCE, WORD))).astype(np.int8)
    # A border belongs to the run that it lies in, at, or right behind.
    run = np.searchsorted(begins, border, side="right") - 1
    touches = (run >= 0) & (border <= ends[run])
    kind[touches] = strength[run[touches]]
    return Places(border, char, whole, kind)


def with_token_counts(df: DataFrame, text: str, keep: list[str], path: str) -> DataFrame:
    """Columns ``keep`` and ``tokens``; null and empty texts have none. One pass over the texts, no shuffle."""
    schema = extended(df.select(*keep).schema, "tokens int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(token_ids(t, path)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int32())], [*keep, "tokens"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)
