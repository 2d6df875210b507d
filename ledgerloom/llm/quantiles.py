"""Problem 3: percentiles of very large numeric columns (relative-rank compactors).

A sketch is a stack of compactors. A value on level h stands for 2**h values. A full compactor sorts its buffer,
keeps the part next to the protected tail as it is, and promotes every second value of the rest. The protected part
grows with the number of compactions, so the error of a rank is a fraction of its distance from that tail. Two
sketches are kept, one for each tail: low percentiles are read from one, high ones from the other.

Sketches of partitions or days merge: levels are concatenated and compacted where they are full. They travel as rows
of arrays; rows that still fit into the lowest level are merged by copying alone, without an object for each group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.schemas import extended

#: Size of a section; the relative error of a rank falls with it.
SECTION = 64
#: Sections of a new compactor, and the least size of a section.
SECTIONS, LEAST = 3, 4
#: Batches of a partition that are merged at once, and the values a partition holds back at most.
FAN_IN, MOST_HELD = 32, 1 << 20


def relative_error(section: int = SECTION) -> float:
    """The stated error of a rank, as a fraction of the rank's distance from the protected tail.

    Three standard deviations of the published a-priori estimate, doubled since merges come in any order.
    """
    return 3 * math.sqrt(0.0512 / SECTIONS) / section * 2


def capacity(section: int = SECTION, compactions: int = 0) -> tuple[int, int]:
    """``(values a compactor holds, size of a section)`` after so many compactions: sections double in number
    whenever the compactions outgrow them, and shrink by the square root of two."""
    size, sections = float(section), SECTIONS
    while compactions >= 1 << (sections - 1) and size / math.sqrt(2) >= LEAST:
        size, sections = size / math.sqrt(2), sections * 2
    even = max(LEAST, 2 * round(size / 2))
    return 2 * even * sections, even


class Sketch:
    """A relative-error quantile sketch; ``high`` protects the upper tail, else the lower one.

    Values must be finite numbers or infinities, never NaN. Coins are hashes of the values that are compacted, so
    they fall apart for groups, partitions and days, and the same input in the same order gives the same sketch.
    """

    def __init__(self, high: bool, section: int = SECTION) -> None:
        self.high, self.section, self.n = high, section, 0
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.done: list[int] = [0]

    def add(self, values: np.ndarray) -> Sketch:
        """Take in values of weight one."""
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        return self._settle()

    def merge(self, n: int, levels: list[np.ndarray], done: list[int]) -> Sketch:
        """Take in another sketch, given by its parts."""
        self.n += n
        for h, (values, count) in enumerate(zip(levels, done, strict=True)):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
                self.done.append(0)
            self.levels[h] = np.concatenate([self.levels[h], values])
            self.done[h] = max(self.done[h], count)
        return self._settle()

    def _settle(self) -> Sketch:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= capacity(self.section, self.done[h])[0]:
                self._compact(h)
            h += 1
        return self

    def _compact(self, h: int) -> None:
        holds, size = capacity(self.section, self.done[h])
        rows = np.sort(self.levels[h])
        if not self.high:
            rows = rows[::-1]  # the protected tail comes last
        trailing = (~self.done[h] & (self.done[h] + 1)).bit_length()  # 1 + trailing ones of the count
        keep = max(holds // 2, holds - trailing * size)
        cut = max(2, len(rows) - keep) & ~1
        coin = (zlib.crc32(rows[:cut].tobytes(), h) * 0x9E3779B1 >> 31) & 1
        if h + 1 == len(self.levels):
            self.levels.append(np.zeros(0))
            self.done.append(0)
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], rows[coin:cut:2]])
        self.levels[h] = rows[cut:]
        self.done[h] += 1

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """For each share q the smallest kept value whose estimated rank reaches ceil(q n); None if empty."""
        if not self.n:
            return [None] * len(shares)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, dtype=np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        want = [max(1, math.ceil(round(q * self.n, 9))) for q in shares]
        at = np.minimum(np.searchsorted(ranks, want), len(ranks) - 1)
        return values[order][at].tolist()


ADDED = "n bigint, high boolean, vals array<double>, sizes array<int>, done array<int>"


def _merged_rows(keys: list[str], table: pa.Table, section: int) -> pa.RecordBatch:
    """Merge the rows of a key, which lie next to each other; runs that fit into a lowest level are only copied."""
    count = table.num_rows
    encoded = [table.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in [*keys, "high"]]
    encoded = [np.where(np.isnan(e), -1, e) if e.dtype.kind == "f" else e for e in encoded]
    fresh = np.ones(count, dtype=bool)
    fresh[1:] = np.any([e[1:] != e[:-1] for e in encoded], axis=0)
    begins = np.flatnonzero(fresh)
    stops = np.append(begins[1:], count)
    vals, sizes, done = (table.column(c).combine_chunks() for c in ("vals", "sizes", "done"))
    v_off, s_off = np.asarray(vals.offsets), np.asarray(sizes.offsets)
    v, s, d = vals.flatten().to_numpy(), sizes.flatten().to_numpy(), done.flatten().to_numpy()
    v_off, s_off = v_off - v_off[0], s_off - s_off[0]
    n, high = table.column("n").to_numpy(), table.column("high").to_numpy(zero_copy_only=False)
    flat = np.diff(s_off) == 1
    room = capacity(section)[0]
    total = np.add.reduceat(n, begins)
    easy = np.logical_and.reduceat(flat, begins) & (v_off[stops] - v_off[begins] < room)
    out_v, out_s, out_d = [], [], []
    for i in range(len(begins)):
        a, b = begins[i], stops[i]
        if easy[i]:
            out_v.append(v[v_off[a] : v_off[b]])
            out_s.append([v_off[b] - v_off[a]])
            out_d.append([0])
            continue
        sketch = Sketch(bool(high[a]), section)
        for r in range(a, b):
            cuts = np.cumsum(s[s_off[r] : s_off[r + 1]])[:-1]
            sketch.merge(int(n[r]), np.split(v[v_off[r] : v_off[r + 1]], cuts), d[s_off[r] : s_off[r + 1]].tolist())
        out_v.append(np.concatenate(sketch.levels))
        out_s.append([len(x) for x in sketch.levels])
        out_d.append(sketch.done)

    def lists(parts: list, kind: pa.DataType) -> pa.Array:
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))

    first = table.take(pa.array(begins))
    columns = [first.column(k).combine_chunks() for k in keys]
    columns += [pa.array(total, pa.int64()), first.column("high").combine_chunks(), lists(out_v, pa.float64()), lists(out_s, pa.int32()), lists(out_d, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [*keys, "n", "high", "vals", "sizes", "done"])


def _schema_of(df: DataFrame, keys: list[str]):
    return extended(df.select(*keys).schema, ADDED)


def _sorted_runs(keys: list[str], batches: Iterator[pa.RecordBatch], section: int) -> Iterator[pa.RecordBatch]:
    """Merge the runs of a partition sorted by key. The last run of a batch waits for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        piece = piece if rest is None else pa.concat_tables([rest.select(piece.column_names), piece.cast(rest.select(piece.column_names).schema)])
        made = _merged_rows(keys, piece, section)
        if made.num_rows > 1:
            yield made.slice(0, made.num_rows - 1)
        rest = pa.Table.from_batches([made.slice(made.num_rows - 1)])
    if rest is not None:
        yield from rest.to_batches()


def merge_sketches(sketches: DataFrame, keys: list[str], section: int = SECTION) -> DataFrame:
    """One row for each key and tail, of any number of sketch rows (of partitions or days). Null is a key like others."""
    keyed = sketches.select(*keys, "n", "high", "vals", "sizes", "done")
    placed = keyed.repartition(*keys, "high").sortWithinPartitions(*keys, "high")
    return placed.mapInArrow(lambda batches: _sorted_runs(keys, batches, section), _schema_of(sketches, keys))


def sketch_values(df: DataFrame, keys: list[str], value: str, section: int = SECTION) -> DataFrame:
    """Sketch rows ``(keys, n, high, vals, sizes, done)`` of ``value`` for each key; nulls and NaN are left out.

    A partition is sketched where it lies, its batches are merged as they come, so a key that holds most rows sends
    only sketches over the network. A key without any usable value has no row.
    """
    schema = _schema_of(df, keys)

    def merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return _merged_rows(keys, pa.Table.from_batches(parts).sort_by([(k, "ascending") for k in (*keys, "high")]), section)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for made in sketched(batches):
            pending.append(made)
            if len(pending) >= FAN_IN:
                one = merged(pending)
                if len(one.column("vals").values) > MOST_HELD:  # many keys with few values each: nothing to gain
                    yield one
                    pending = []
                else:
                    pending = [one]
        if pending:
            yield merged(pending)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table.sort_by([(k, "ascending") for k in keys])
            rows = table.num_rows
            ones = np.arange(rows + 1, dtype=np.int32)
            one = pa.ListArray.from_arrays(pa.array(ones), pa.array(np.ones(rows, dtype=np.int32)))
            none = pa.ListArray.from_arrays(pa.array(ones), pa.array(np.zeros(rows, dtype=np.int32)))
            values = pa.ListArray.from_arrays(pa.array(ones), table.column("__v").combine_chunks())
            for high in (False, True):
                full = pa.table(
                    [*[table.column(k) for k in keys], pa.array(np.ones(rows, dtype=np.int64)), pa.array(np.full(rows, high)), values, one, none],
                    names=[*keys, "n", "high", "vals", "sizes", "done"],
                )
                yield _merged_rows(keys, full, section)

    usable = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    return usable.mapInArrow(run, schema)


def read_quantiles(sketches: DataFrame, keys: list[str], shares: list[float], section: int = SECTION) -> DataFrame:
    """``(keys, n, share, estimate, rank_error)`` of merged sketches, one row for each share.

    Shares up to one half are read from the sketch of the lower tail, others from that of the upper tail.
    ``rank_error`` states by what fraction of n the estimate's rank may be off (three standard deviations): zero
    while nothing was compacted, else the relative error times the distance from the protected tail.
    """
    schema = extended(sketches.select(*keys).schema, "n bigint, share double, estimate double, rank_error double")
    error = relative_error(section)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            highs, ns = batch.column("high").to_pylist(), batch.column("n").to_pylist()
            vals, sizes = batch.column("vals"), batch.column("sizes").to_pylist()
            rows, out = [], []
            for i, high in enumerate(highs):
                mine = [q for q in shares if (q > 0.5) == high]
                sketch = Sketch(high, section)
                sketch.n, sketch.levels = ns[i], np.split(vals[i].values.to_numpy(), np.cumsum(sizes[i])[:-1])
                exact = len(sizes[i]) == 1
                for q, x in zip(mine, sketch.quantiles(mine), strict=True):
                    rows.append(i)
                    out.append((ns[i], q, x, 0.0 if exact else error * (1 - q if high else q)))
            columns = [pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *columns], [*keys, "n", "share", "estimate", "rank_error"])

    return sketches.mapInArrow(run, schema)


def daily_sketches(works: DataFrame, fields: list[str], keys: list[str], day: str) -> DataFrame:
    """Sketches for each field, group and day; columns ``field``, ``keys``, ``day`` and the sketch."""
    long = works.select(*keys, F.to_date(day).alias("day"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])))
    return merge_sketches(sketch_values(long, ["field", *keys, "day"], "value"), ["field", *keys, "day"])


def from_days(daily: DataFrame, keys: list[str], shares: list[float], fan_in: int = 64) -> DataFrame:
    """Percentiles of each field and group, put together from the sketches of single days.

    Days are first merged in ``fan_in`` parts of a group and those parts then, so no task takes all days of a hot
    group at once.
    """
    part = F.pmod(F.xxhash64("day"), F.lit(fan_in)).cast("int").alias("part")
    halves = merge_sketches(daily.select("field", *keys, part, "n", "high", "vals", "sizes", "done"), ["field", *keys, "part"])
    return read_quantiles(merge_sketches(halves, ["field", *keys]), ["field", *keys], shares)
