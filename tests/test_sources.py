import datetime

import pytest

from ledgerloom.operators.errors import error_report
from ledgerloom.sources.lines import (
    load_and_prepare_data,
    load_raw_df,
    read_error_report,
    report_name,
    with_line_id,
    write_error_report,
)

HEAD = "REF,DATE,DETAIL,NET,TC,VAT,SUPPLIER,NOMINAL,DEPARTMENT,NOTE\n"
BODY = (
    'R1,2024-03-01,"Nails, 2kg",10.5,T1,2.1,"Hard ""Ware""",Tools,STORE,x\n'
    "R2,2024-03-02,12345,abc,T1,NA,null,,STORE,\n"
    "R3,not a date,Rope,3,T0,0,Dock,Tools,None,y\n"
)


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(HEAD + BODY)
    return str(path)


def test_columns_by_name_types_and_missing_values(spark, csv):
    rows = {r.REF: r for r in load_raw_df(spark, csv).collect()}
    assert rows["R1"].DETAIL == "Nails, 2kg" and rows["R1"].SUPPLIER == 'Hard "Ware"'
    assert rows["R1"].DATE == datetime.date(2024, 3, 1) and rows["R1"].NET == 10.5
    assert rows["R2"].DETAIL == "12345" and rows["R2"].NET is None and rows["R2"].VAT is None
    assert rows["R2"].SUPPLIER is None and rows["R2"].NOMINAL is None and rows["R2"].NOTE is None
    assert rows["R3"].DATE is None and rows["R3"].DEPARTMENT is None


def test_missing_columns_are_named(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("DATE,REF,DETAIL\n1,2,3\n")
    with pytest.raises(ValueError, match="NET, TC, VAT, SUPPLIER, NOMINAL, DEPARTMENT"):
        load_raw_df(spark, str(path))


@pytest.mark.parametrize("chunk", [2, 1000])
def test_line_ids_are_unique_and_stable(spark, chunk):
    columns = ["DATE", "REF", "DETAIL", "NET", "TC", "VAT", "SUPPLIER", "NOMINAL", "DEPARTMENT"]
    rows = [("d", "1", "same", "1", "t", "1", "s", "n", "d")] * 7 + [
        ("d", str(i), "other", None, "t", "1", "s", None, "d") for i in range(5)
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    first = sorted(r.line_id for r in with_line_id(df.repartition(1), chunk=chunk).collect())
    again = sorted(r.line_id for r in with_line_id(df.repartition(5), chunk=chunk).collect())
    assert first == again and len(set(first)) == 12


def test_load_and_prepare(spark, csv):
    df, vocabulary = load_and_prepare_data(spark, csv)
    assert df.count() == 3 and "model_text" in df.columns
    assert vocabulary == {"nominal": ["Tools"], "department": ["STORE"], "tax_code": ["T0", "T1"]}


def test_error_report_round_trip(spark, tmp_path):
    names = "detail supplier true_nominal pred_nominal true_department pred_department true_tc pred_tc".split()
    rows = [('say "hi", ok', "s", "A", "B", "D", "D", "T", "T"), ("fine", "s", "A", "A", "D", "D", "T", "T")]
    preds = spark.createDataFrame(rows, names)
    path = write_error_report(error_report(preds), str(tmp_path), "Vote (k=5).v1")
    assert path.endswith(report_name("Vote (k=5).v1")) and "(" not in path and "." not in path.split("/")[-1]
    back = read_error_report(spark, path)
    assert back.columns == names and [tuple(r) for r in back.collect()] == rows[:1]


def test_extended_report_has_confidence_as_json(spark):
    names = "detail supplier true_nominal pred_nominal true_department pred_department true_tc pred_tc".split()
    schema = ", ".join(f"{n} string" for n in names) + ", confidence map<string,double>, reasoning string"
    preds = spark.createDataFrame(
        [("a", "s", "A", "", "D", "D", "T", "T", {"nominal": 0.5}, "why"),
         ("b", "s", "A", "", "D", "D", "T", "T", None, "")], schema)
    got = {r.detail: r.confidence for r in error_report(preds).collect()}
    assert got == {"a": '{"nominal":0.5}', "b": "{}"}
