import io
import json
import os
import zipfile
from pathlib import Path

import pytest

from ledgerloom import release as R
from ledgerloom.sources import files as S


def test_csv_scan_numbers_rows_and_keeps_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿x,y\n"1\n2",\n3,"q ""z"", w"\n'.encode())
    (tmp_path / "b.csv").write_text("x,y\n7,8\n")
    got = S.read_cohorts(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}, ["x", "y"]).orderBy("cohort", "source_record").collect()
    assert [(r["cohort"], r["source_record"], r["x"], r["y"]) for r in got] == [("a", 1, "1\n2", ""), ("a", 2, "3", 'q "z", w'), ("b", 1, "7", "8")]
    with pytest.raises(S.ContractError):
        S.read_export(spark, str(tmp_path / "b.csv"), ["x", "z"])


def test_contract(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("x,y\n7,8\n")
    df, digest = S.read_export(spark, str(path), ["x", "y"]), S.file_digest(str(path))
    assert S.checked_source(spark, str(path), 1, digest, df) is df
    with pytest.raises(S.ContractError):
        S.checked_source(spark, str(path), 2, digest, df)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1", float("nan"), None), ("b", 1.5, "2024-01-02")], "a string, v double, d string").selectExpr("a", "v", "cast(d as date) as d")
    S.write_csv(df.coalesce(1), str(tmp_path / "c"), safe=True)
    text = "".join(p.read_text() for p in Path(tmp_path / "c").glob("part*"))
    assert text.splitlines() == ["a,v,d", "'=1,NaN,", "b,1.5,2024-01-02"]
    S.write_json(df.coalesce(1), str(tmp_path / "j"))
    rows = [json.loads(x) for p in Path(tmp_path / "j").glob("part*") for x in p.read_text().splitlines()]
    assert rows == [{"a": "=1", "v": None, "d": None}, {"a": "b", "v": 1.5, "d": "2024-01-02"}]
    assert S.document_json({"b": float("inf"), "a": [1.0]}) == '{"a": [1.0], "b": null}'


def book():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5.50</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>Grand Total</t></is></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_workbook_and_control_total(spark, tmp_path):
    assert list(S.workbook_rows(book())) == [(1, ["one", None, "5.50"]), (3, ["Grand Total", None, "7"])]
    (tmp_path / "b.xlsx").write_bytes(book())
    spark.dataSource.register(S.WorkbookSource)
    rows = spark.read.format("workbook").load(str(tmp_path / "b.xlsx"))
    assert [(r["row"], r["cells"][0]) for r in rows.orderBy("row").collect()] == [(1, "one"), (3, "Grand Total")]
    r = S.control_total(rows.selectExpr("cells[0] as label", "cells[2] as amount"), "label", "amount").first()
    assert (float(r["reported"]), float(r["visible"]), float(r["difference"])) == (7.0, 5.5, 1.5)


def test_release(tmp_path, spark):
    for name in ("r1", "r2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.txt").write_text(name)
        R.seal(tmp_path / name, ["t.txt"])
    R.activate(tmp_path, "r1")
    R.activate(tmp_path, "r2")
    assert R.current(tmp_path).name == "r2" and R.problem(tmp_path / "r1") is None
    (tmp_path / "r1" / "t.txt").write_text("changed")
    assert "changed" in R.problem(tmp_path / "r1")
    with pytest.raises(R.ReleaseError):
        R.activate(tmp_path, "r1")
    with pytest.raises(R.ReleaseError):
        R.seal(tmp_path / "r2", ["absent"])
    pointer = json.loads((tmp_path / R.POINTER).read_text())
    (tmp_path / R.POINTER).write_text(json.dumps(pointer | {"release": os.path.join("..", "elsewhere")}))
    with pytest.raises(R.ReleaseError):
        R.current(tmp_path)
    with R.locked(tmp_path / "lock"), pytest.raises(R.ReleaseError), R.locked(tmp_path / "lock"):
        pass
    a, b = spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), spark.createDataFrame([("x", 2), (None, 1)], "v string, k int")
    assert R.content_hash(a) == R.content_hash(b.repartition(3)) != R.content_hash(a.limit(1))
