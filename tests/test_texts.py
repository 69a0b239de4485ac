"""Numbers as text, and canonical texts of any JSON value, against plain restatements."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical, numbers
from tessera.operators import records
from tessera.operators import stages as st


def test_doubles_have_their_shortest_text(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, 0.1, 1e7, 1e-7, 123456789.125, 1e15, 1e16, 9999999999999998.0, 1e17, 1e-4, 1e-5, 9.999e-5, 2.0**-44, 1e23, 2e-3, 5e-324, 1.7976931348623157e308, 4.35, 100.0, 1234.5, 2.2250738585072014e-308, 1.5e300, 0.30000000000000004]
    values += [x for _ in range(3000) if (x := struct.unpack("<d", rng.randbytes(8))[0]) == x and abs(x) != float("inf")]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 19) for _ in range(3000)] + [round(rng.uniform(0, 1e6), rng.randint(0, 9)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(-v,) for v in values[:30]], "x double")
    wrong = [(r.x, r.t) for r in df.select("x", numbers.text(F.col("x")).alias("t")).collect() if r.t != repr(r.x)]
    assert not wrong, wrong[:9]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(numbers.text(F.col("x")).alias("t")).collect()
    assert [r.t for r in odd] == [None, "NaN"]


def test_a_manifest_line_equals_a_plain_one(spark):
    df = spark.createDataFrame([(x,) for x in (1e-7, 0.1, 12.5, 1e7, 123456789012345680.0)], "answer_decimal double")
    made = records.record(df, problem_id=F.lit("é \"q\""), family=F.lit("f"), category=F.lit(1), stem=F.lit("s"), answer_decimal=F.col("answer_decimal"), origin=F.lit("generated"))
    for r in records.to_line(made).collect():
        plain = json.loads(r.value)
        assert json.dumps(plain, ensure_ascii=False, sort_keys=True) == r.value


def restated(value, precision=6):
    if isinstance(value, bool):
        return ["b", value]
    if isinstance(value, (int, float)):
        return ["n", format(round(float(value), precision) + 0.0, f".{precision}f")]
    if isinstance(value, str):
        return ["s", value]
    return ["z", None] if value is None else ["l", [restated(v, precision) for v in value]]


def any_value(rng, depth):
    k = rng.random()
    if depth and k < 0.4:
        return [any_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([True, False, None, 0, -0.0, 5e-7, 2.5e-6, 1.0000005, 10**40 + 7, -(2**70), 1e22, 0.1, "", "é\n\"\\ ", "1", rng.randint(-9, 9), rng.uniform(-1e9, 1e9)])


def test_canonical_texts():
    rng = random.Random(2)
    for _ in range(400):
        params = {rng.choice("abcdeé") * rng.randint(1, 3): any_value(rng, 4) for _ in range(rng.randint(0, 5))}
        for ascii_ in (True, False):
            text = json.dumps(params, ensure_ascii=ascii_, indent=rng.choice([None, 1]))
            want = json.dumps([[k, restated(json.loads(json.dumps(v)))] for k, v in sorted(params.items())], ensure_ascii=False, separators=(",", ":"))
            assert canonical.canonical(text, 6) == want
    deep = "[" * 3000 + "1" + "]" * 3000
    assert canonical.canonical(deep, 0) == '["l",[' * 3000 + '["n","1"]' + "]]" * 3000


@pytest.mark.parametrize("text", ["", " ", "[1,]", "[,1]", "{\"a\" 1}", "1 2", "[1", "nan", "NaN", "1e999", "[}", "]", "{\"a\":1,\"a\":2}", "{\"a\":{}}", "[{}]", "01", "+1", "'a'", "\"\x01\"", "[1 2]", "{1:2}", "{\"a\":1,}", "tru", "\"a", "{\"a\":}", "[1]]"])
def test_what_cant_be_signed(text):
    with pytest.raises(canonical.Unsigned):
        canonical.canonical(text, 6)


def test_signed_values(spark):
    nested = "[" * 50 + "1234567890123456789012345678901234567890" + "]" * 50
    rows = [(1, nested), (2, '{"b": 1, "a": [2.5]}'), (3, '{"a": {"b": 1}}'), (4, None), (5, "x"), (6, nested), (7, '{"a": [2.5000000001], "b": 1.0}')]
    got = {r.i: r for r in st.signed_values(spark.createDataFrame(rows, "i int, v string"), "v", F.lit("f")).collect()}
    want = json.dumps(restated(json.loads(nested)), separators=(",", ":"))
    assert got[1].signature == got[6].signature == hashlib.sha256(("f\0" + want).encode()).hexdigest()
    assert got[2].signature == got[7].signature and got[2].unsigned is None
    assert all((r.signature is None) != (r.unsigned is None) for r in got.values()) and [i for i in sorted(got) if got[i].signature is None] == [3, 4, 5]
