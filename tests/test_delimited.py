import random

import pyarrow as pa
from pyspark.sql import Row

from ledgerloom.operators.delimited import parsed_lines, record_ends, rejected_rows, states_before, tokenized


def plain_parse(s):
    """Field by field; None where a field is neither quoted nor free of quotes and line breaks."""
    fields, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(s):
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + s[i], i + 1
            fields.append(text)
        else:
            j = i
            while j < len(s) and s[j] != ",":
                if s[j] in '"\r\n':
                    return None
                j += 1
            fields.append(s[i:j])
            i = j
        if i == len(s):
            return fields
        if s[i] != ",":
            return None
        i += 1


def test_tokenizer_equals_a_plain_parser():
    rng = random.Random(5)
    for _ in range(150):
        lines = ["".join(rng.choice('a",\n"é,b') for _ in range(rng.choice([0, 1, 3, 8, 30, 900]))) for _ in range(rng.choice([0, 1, 5, 40]))]
        made = tokenized(pa.array(lines, pa.string()))
        assert made.column(0).to_pylist() == [plain_parse(x) for x in lines]


def test_chunks_of_any_length_give_the_same_states():
    import numpy as np

    symbols = np.random.default_rng(3).integers(0, 5, 1000).astype("uint8")
    assert all((states_before(symbols, k) == states_before(symbols, 4096)).all() for k in (1, 2, 7, 64))


def test_null_empty_and_very_long_records():
    long = '"' + "x" * 300_000 + '""y",z'
    made = tokenized(pa.array([None, "", long]))
    assert made.column(0).to_pylist() == [[""], [""], ["x" * 300_000 + '"y', "z"]]


def test_error_offsets():
    made = tokenized(pa.array(['"ab"c,d', 'ab"c', '"abc', "a\nb"]))
    assert made.column(1).to_pylist() == [4, 2, 4, 1]


def test_records_of_a_raw_file():
    assert record_ends(b'a,b\n"x\ny",2\nz')[0].tolist() == [3, 11]


def test_reasons(spark):
    pay = "1,2,V1,n,i,s,st,ida,mp,w,{},{}"
    lines = [
        (1, "06_expenditure.csv", pay.format("01-Jan-2024", "10.00")), (2, "06_expenditure.csv", pay.format("31-Feb-2024", "10")), (3, "06_expenditure.csv", pay.format("01-jan-2024", "1.00000001 ")),
        (4, "06_expenditure.csv", "a,b"), (5, "06_expenditure.csv", 'a"b' + "," * 11), (6, "01_allocated_limit.csv", "m,s,c,h,n,t,a,b,NA"), (7, "01_allocated_limit.csv", "m,s,c,h,n,t,a,b,-1"),
        (8, "01_allocated_limit.csv", ""), (9, "06_expenditure.csv", pay.format("", "10")), (10, "06_expenditure.csv", None), (11, None, "x"), (12, "06_expenditure.csv", pay.format("01-Jan-2024", "1.001")),
    ]
    df = spark.createDataFrame([Row(line_id=a, source_file=b, cohort="c", raw_line=c, loaded_at=None, fields="clash") for a, b, c in lines], "line_id bigint, source_file string, cohort string, raw_line string, loaded_at timestamp, fields string")
    found = {r["line_id"]: r["reason"] for r in parsed_lines(df).collect()}
    assert found == {1: None, 2: "value", 3: None, 4: "column_count", 5: "quoting", 6: None, 7: "value", 8: "column_count", 9: "value", 10: "column_count", 11: None, 12: "value"}
    empty = df.limit(0)
    pays = spark.createDataFrame([(1, "01-Jan-2024", None), (2, None, "5"), (3, "01-Jan-2024", "5")], "record_id bigint, expenditure_date string, fund_disbursed_amt string")
    allots = spark.createDataFrame([(1, None), (2, "x"), (3, " 7 ")], "record_id bigint, allocated_amt string")
    assert sorted((r[0], r[1]) for r in rejected_rows(empty, pays, allots).collect()) == [("allocated_limit", 2), ("expenditure", 1), ("expenditure", 2)]
