"""Lengths keep all their places through solving, signatures and texts."""

import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.operators import families as fam
from tessera.operators import records
from tessera.operators import stages as st
from tessera.operators import structured
from tessera.operators.ordinals import first_of_repeated


def statuses(spark, rows):
    lines = [(i, json.dumps({"input_id": f"r{i}", "family": f, "params": p, "expected_answer": a})) for i, (f, p, a) in enumerate(rows)]
    return {r.line: r for r in structured.statuses(spark.createDataFrame(lines, "line long, value string")).collect()}


def rectangle(w, h, a, b):
    return {"width": w, "height": h, "notch_w": a, "notch_h": b}


def area(w, h, a, b):
    x, y, c, d = (Fraction(repr(v)) if isinstance(v, float) else Fraction(v) for v in (w, h, a, b))
    return x * y - c * d


def test_lengths_of_many_places(spark):
    rng = random.Random(3)
    sizes = [(0.1234567, 0.7654321, 0.0500001, 0.3), (1e-9, 2e-9, 5e-10, 1e-9), (3, 4, 1.0000001, 2), (1e-05, 3e-05, 4.2e-06, 1e-05), (12.5, 6, 5, 2.5), (10.0, 8, 4, 3), (1e6, 1e6, 500000.25, 500000.5)]
    sizes += [tuple(round(rng.uniform(lo, hi), k) for lo, hi in ((5, 9), (5, 9), (2, 4), (2, 4))) for k in (1, 3, 7, 11, 15) for _ in range(4)]
    got = statuses(spark, [("composite_rectilinear", rectangle(*s), str(area(*s))) for s in sizes])
    for i, s in enumerate(sizes):
        assert got[i].answer_exact == str(area(*s)), (s, got[i])
        assert got[i].status == "emitted" or abs(got[i].answer_decimal) < 1e-15
    made = {r.problem_id: r for r in structured.emitted_records(structured.statuses(spark.createDataFrame([(0, json.dumps({"input_id": "a", "family": "composite_rectilinear", "params": rectangle(*sizes[0]), "expected_answer": str(area(*sizes[0]))}))], "line long, value string"))).select("*", records.invalid_reason().alias("bad")).collect()}
    assert made["a"].bad is None and json.loads(made["a"].params)["width"] == 0.1234567


def test_other_families(spark):
    got = statuses(spark, [("inscribed_circle", {"k": 4, "side": 0.1234567}, "0.1234567**2*(1 - pi/4)"), ("nested_polygons", {"n": 4, "m": 3, "side_outer": 1.0000001, "side_inner": 0.6}, "1.0000001**2 - 0.09*sqrt(3)"), ("nested_polygons", {"n": 7, "m": 5, "side_outer": 0.0000003, "side_inner": 0.0000001}, "1")])
    assert got[0].status == got[1].status == "emitted"
    assert got[0].answer_exact == "15241556774899/1000000000000000 - 15241556774899*pi/4000000000000000".replace("15241556774899/1000000000000000", str(Fraction("0.1234567") ** 2)).replace("15241556774899*pi/4000000000000000", f"{(Fraction('0.1234567') ** 2 / 4).numerator}*pi/{(Fraction('0.1234567') ** 2 / 4).denominator}")
    assert got[1].answer_exact == f"{(Fraction('1.0000001') ** 2)} - 9*sqrt(3)/100"
    assert "cot(pi/7)" in got[2].answer_exact and got[2].status == "answer_mismatch"


def test_what_has_too_many_digits_says_so(spark):
    bad = [rectangle(1e-20, 1, 1, 1), rectangle(1e17, 1e17, 0.5, 0.5), rectangle(12345678901234567890, 1, 1, 1), rectangle(1e300, 1, 1, 1), rectangle(1e9, 5, 1, 1e-9)]
    got = statuses(spark, [("composite_rectilinear", p, "1") for p in bad])
    assert [(r.status, r.reason) for r in got.values()] == [("input_error", f"params: more than {exact.DIGITS} digits before and behind the point")] * len(bad)


@pytest.mark.parametrize(("text", "want"), [("10", "10"), ("0.1234567", "0.1234567"), ("0.000000000000000001", "0.000000000000000001"), ("2.50", "2.5"), ("-0.5", "-0.5"), ("100000", "100000")])
def test_texts_of_lengths(spark, text, want):
    assert spark.range(1).select(fam.number_text(F.lit(text).cast(exact.LENGTH)).alias("t")).first().t == want


def test_signatures_round_as_asked(spark):
    df = spark.sql("SELECT 4L AS k, explode(array(0.1234567BD, 0.1234568BD, 0.12345674BD)) AS side")
    got = [[r.signature for r in st.sign(df, fam.CIRCLE, p).collect()] for p in (6, 7, 8)]
    assert len(set(got[0])) == 1 and len(set(got[1])) == 2 and len(set(got[2])) == 3


def test_rows_of_a_form_are_checked_once(spark):
    """Lines that differ in ids and sources only are one form; lines that look alike with their fields' borders moved are not."""
    rows = spark.createDataFrame([(None, "composite_rectilinear", "{}", "1")] * 3 + [(None, "composite_rectilinear{", "}", "1"), (None, None, "{}", "1"), (None, "", "{}", "1"), ("bad", None, None, None)], "_a string, family string, params string, expected_answer string")
    rows = rows.withColumn("form", F.to_json(F.struct("family", "params", "expected_answer")))
    found = structured._forms(rows).collect()
    assert sorted(r._b for r in found) == ["family must be a string", "params must have exactly the keys height, notch_h, notch_w, width", "unknown family ", "unknown family composite_rectilinear{"]
    row = {"family": "composite_rectilinear", "params": rectangle(4, 4, 1, 1), "expected_answer": "15"}
    lines = [(i, json.dumps(row | {"input_id": f"r{i}", "source": {"url": f"u{i}"}})) for i in range(5)]
    lines += [(8, json.dumps(row | {"input_id": "r9", "expected_answer": None})), (9, json.dumps(row | {"input_id": "r9", "family": None})), (10, json.dumps(row | {"input_id": "r9", "params": rectangle(4, 4, 1, "x")}))]
    got = {r.line: r for r in structured.statuses(spark.createDataFrame(lines, "line long, value string")).collect()}
    assert [got[i].status for i in range(5)] == ["emitted"] + ["duplicate"] * 4 and [got[i].source_url for i in range(5)] == [f"u{i}" for i in range(5)]
    assert [got[i].reason for i in (8, 9, 10)] == ["expected_answer must be a non-empty string", "family must be a string", "params: notch_h must be a number"]


def test_keys_of_one_row_are_not_joined(spark):
    df = spark.createDataFrame([("a", 3, True), ("a", 2, True), ("a", 1, False), ("b", 1, True), (None, 1, True), ("c", 1, False), ("c", 2, False)], "k string, v int, ok boolean")
    got = {(r.k, r.v): r.least for r in first_of_repeated(df, "k", F.col("v"), F.col("ok"), "least").collect()}
    assert got == {("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("b", 1): None, (None, 1): None, ("c", 1): None, ("c", 2): None}
