"""Record files cut at every size of block against Python's own reader."""

import csv
import io
import random

import pytest

from ledgerloom.operators import delimited as D
from ledgerloom.sources import files, records


def sample(rng, rows=40):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(["a", "b"])
    for i in range(rows):
        writer.writerow([i, "".join(rng.choice(['"', ",", "\n", "x", "é", "\r\n", ""]) for _ in range(rng.randrange(6)))])
    return out.getvalue().encode()


def test_records_do_not_depend_on_blocks(spark, tmp_path):
    rng = random.Random(2)
    for n, block in enumerate((1, 3, 7, 64, 1 << 20)):
        data = records.BOM * (n % 2) + sample(rng)
        data = data[:-1] if n == 2 else data
        (tmp_path / f"{n}.csv").write_bytes(data)
        want = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))[1:]
        rows, bad = records.read_split_export(spark, str(tmp_path / f"{n}.csv"), ["a", "b"], block)
        got = rows.orderBy("source_record").collect()
        assert [r["source_record"] for r in got] == list(range(1, 41)) and bad.count() == 0
        assert [[r["a"], r["b"]] for r in got] == want


def test_broken_records_are_told_apart(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'a,b\n1,2\n3\n\n4,x"y\n"5",6\n7,"open')
    rows, bad = records.read_split_export(spark, str(path), ["a", "b"], 5)
    assert [(r["source_record"], r["a"], r["b"]) for r in rows.orderBy("source_record").collect()] == [(1, "1", "2"), (5, "5", "6")]
    assert [(r["source_record"], r["reason"], r["byte_at"]) for r in bad.orderBy("source_record").collect()] == [(2, "column_count", 8), (4, "quoting", 14), (6, "quoting", 30)]
    with pytest.raises(files.ContractError):
        records.read_split_export(spark, str(path), ["a", "c"])
    (tmp_path / "empty.csv").write_bytes(b"")
    assert records.read_records(spark, str(tmp_path / "empty.csv")).where("raw_line <> ''").count() == 0


def test_maps_of_blocks_compose():
    data = sample(random.Random(9), 200)
    whole, last = D.record_ends(data)
    for block in (5, 100, 1000):
        state, ends = D.START, 0
        for i in range(0, len(data), block):
            state, n, _ = D.block_map(data[i : i + block])[state]
            ends += n
        assert (ends, state) == (len(whole), last)


def test_digest(tmp_path):
    (tmp_path / "f").write_bytes(b"abc" * 1000)
    assert records.stream_digest(str(tmp_path / "f"), 7) == files.file_digest(str(tmp_path / "f"))
