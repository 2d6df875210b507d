import sqlite3
import tarfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.query import reviews as V
from ledgerloom.query.listing import BadRequest
from ledgerloom.sources import exports as X
from ledgerloom.sources import files


def frame(spark):
    rows = [("=1+1", 150, 2.5, "2024-01-02", True), ('q "z", w\nnext', None, None, None, None)]
    return spark.createDataFrame(rows, "name string, paid_paise bigint, x double, d string, ok boolean").withColumn("d", F.to_date("d"))


def test_csv_file(spark, tmp_path):
    X.write_csv_file(frame(spark), str(tmp_path / "a.csv"), safe=True, crlf=True)
    data = (tmp_path / "a.csv").read_bytes()
    assert data == '﻿name,paid_paise,x,d,ok\r\n\'=1+1,150,2.5,2024-01-02,True\r\n"q ""z"", w\nnext",,,,\r\n'.encode()
    X.write_csv_file(frame(spark).limit(0), str(tmp_path / "a.csv"))
    assert (tmp_path / "a.csv").read_text("utf-8-sig") == "name,paid_paise,x,d,ok\n" and len(list(tmp_path.iterdir())) == 1


def test_workbook(spark, tmp_path):
    X.write_workbook({"one & two": frame(spark), "none": frame(spark).limit(0)}, str(tmp_path / "b.xlsx"))
    rows = list(files.workbook_rows((tmp_path / "b.xlsx").read_bytes()))
    assert rows[0] == (1, ["name", "paid_inr", "x", "d", "ok"]) and rows[1] == (2, ["=1+1", "1.5", "2.5", "2024-01-02", "True"])
    assert rows[2] == (3, ['q "z", w\nnext'])
    assert [X._column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.sqlite")
    X.write_sqlite({"t": frame(spark)}, path, [("t", ["name", "d"])])
    assert sqlite3.connect(path).execute("select count(*), sum(paid_paise) from t").fetchone() == (2, 150)
    back = X.read_sqlite(spark, path, "t", "name string, paid_paise bigint, x double, d date, ok boolean")
    assert sorted(back.collect(), key=str) == sorted(frame(spark).collect(), key=str)


def test_report(spark, tmp_path):
    X.write_report([("Rows", frame(spark).select("name", "d").orderBy("paid_paise")), ("Text", "plain")], str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text()
    assert "## Rows\n\n| name | d |\n|-|-|\n" in text and "| =1+1 | 2024-01-02 |" in text and text.endswith("## Text\n\nplain")
    assert X.markdown_table(frame(spark).select("x"), 1).endswith("(1 of 2 rows)\n")


def test_bundle(tmp_path):
    folder = tmp_path / "f"
    (folder / "sub").mkdir(parents=True)
    (folder / "a").write_text("small")
    (folder / "sub" / "big").write_text("x" * 100)
    said = X.pack(folder, tmp_path / "b.tar.gz", 50)
    assert list(said["files"]) == ["a"] and said["omitted"] == {"sub/big": 100} and X.bundle_problem(tmp_path / "b.tar.gz") is None
    with tarfile.open(tmp_path / "bad.tar.gz", "w:gz") as tar:
        tar.add(folder / "a", "a")
    assert X.bundle_problem(tmp_path / "bad.tar.gz") == "no bundle.json"


def test_reviews(spark, tmp_path):
    records = spark.createDataFrame([("w:1",), ("w:2",)], "record_key string")
    book = V.ReviewLedger(spark, str(tmp_path / "r"), records, "v1", ["cleared", "escalate"], ["open", "closed"])
    good = {"key": "w:1", "note": " seen ", "outcome": "cleared", "version": "v1"}
    first = book.add(good)
    second = book.add(good | {"status": "closed", "due_date": "2026-02-28", "owner": "a"})
    assert second > first and book.history("w:1").count() == 2
    row = book.current().first()
    assert (row["review_id"], row["status"], row["note"], str(row["due_date"])) == (second, "closed", "seen", "2026-02-28")
    book.add(good | {"key": "w:2"})
    assert [r["record_key"] for r in V.open_cases(book.current(), ["closed"]).collect()] == ["w:2"]
    assert V.open_cases(book.current(), [], "SEEN").count() == 2 and V.open_cases(book.current(), [], "nowhere").count() == 0
    for bad in ({"note": " "}, {"note": "x" * 3001}, {"outcome": "?"}, {"key": "w:3"}, {"key": "k" * 101}, {"owner": "o" * 121}, {"due_date": "2026-02-30"}, {"due_date": "soon"}, {"status": "?"}, {"note": None}):
        with pytest.raises(BadRequest):
            book.add(good | bad)
    with pytest.raises(V.Conflict):
        book.add(good | {"version": "v0"})
    assert Path(tmp_path / "r").exists() and book.history().count() == 3
