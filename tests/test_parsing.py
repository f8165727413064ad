import json


from ledgerloom.functions.parsing import parse_json_response, parse_line_response

GOOD = {"nominal": "N", "department": "D", "tax_code": "T", "nominal_confidence": 0.5,
        "department_confidence": 0, "tax_code_confidence": 1.0, "reasoning": "  because "}


def read(spark, responses):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "i int, response string")
    return parse_json_response(df).orderBy("i").collect()


def test_json(spark):
    def changed(**kw):
        return json.dumps({k: v for k, v in {**GOOD, **kw}.items() if v != "drop"})

    rows = read(spark, [json.dumps(GOOD), changed(extra=1), changed(tax_code="drop"), changed(nominal_confidence=1.2),
                        changed(department_confidence=-0.1), changed(reasoning=None), "not json", None, "[1]", '"text"',
                        changed(nominal_confidence="high"), json.dumps(GOOD)[:-3],
                        changed(nominal=12), changed(nominal_confidence="0.9")])
    assert [r.reason for r in rows] == [
        "ok", "ok", "missing:tax_code", "range:nominal_confidence", "range:department_confidence",
        "missing:reasoning", "not_json", "not_json", "not_json", "not_json", "missing:nominal_confidence", "not_json",
        "missing:nominal", "ok"]
    assert rows[-1].nominal_confidence == 0.9
    assert rows[0].valid and rows[0].nominal == "N" and rows[0].reasoning == "because" and rows[0].department_confidence == 0
    assert not rows[3].valid and rows[3].nominal is None and rows[3].reasoning == ""


def test_lines(spark):
    texts = ["NOMINAL: a\nDEPARTMENT: b\nTC: c", "  NOMINAL:x \r\nNOMINAL: y", "", None, "TC:1\nTC: TC: 2\nnominal: no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = [tuple(r.p) for r in df.select("i", parse_line_response("t").alias("p")).orderBy("i").collect()]
    assert rows == [("a", "b", "c"), ("y", "", ""), ("", "", ""), ("", "", ""), ("", "", "2")]
