"""Exact numbers: equal values have equal texts, and one side of exact and error is null."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers as ans
from tessera.functions import field
from tessera.plans import more_queries, queries  # noqa: F401  the first registers with the second

CASES = {
    "1/(1+sqrt(2))": "sqrt(2) - 1", "sqrt(3+2*sqrt(2))": "sqrt(2) + 1", "2**65": "36893488147419103232", "E": "E", "cbrt(2)": "cbrt(2)", "sqrt(10007**2*2)": "10007*sqrt(2)",
    "sqrt(10+2*sqrt(6)+2*sqrt(10)+2*sqrt(15))": "sqrt(2) + sqrt(3) + sqrt(5)", "1/(1+cbrt(2))": "cbrt(4)/3 + 1/3 - cbrt(2)/3", "(pi**2-1)/(pi**2+3*pi+2)": "(pi - 1)/(pi + 2)",
    "sqrt(1+sqrt(2))**2": "sqrt(2) + 1", "sqrt(2+sqrt(2))*sqrt(2-sqrt(2))": "sqrt(2)", "sin(pi/6)": "1/2", "cos(pi/8)": "sqrt(sqrt(2) + 2)/2", "tan(pi/3)": "sqrt(3)", "sin(1+2*pi)": "sin(1)", "cos(-1)": "cos(1)",
    "8**(2/3)": "4", "2**(1/2)*3**(1/3)": "72**(1/6)", "E**2*E**-1": "E", "E**sqrt(2)*E**sqrt(2)": "(E**(sqrt(2)))**2", "3/(2*pi)": "3/(2*pi)", "sqrt(4+3*sqrt(2))": "2**(1/4) + 8**(1/4)",
    "sqrt(pi**2+12*pi+36)": "pi + 6", "(E**2-pi**2)/(E+pi)": "E - pi", "1/(sqrt(2)+sqrt(3)+sqrt(5))": "sqrt(2)/4 + sqrt(3)/6 - sqrt(30)/12", "cbrt(-8)": "-2", "0.1+0.2": "3/10", "1e400/1e399": "10", "sqrt(8*pi**2)": "2*sqrt(2)*pi",
    "sqrt(1000000007**2*3)": "1000000007*sqrt(3)", "sqrt(4+4*sqrt(2))-2*sqrt(1+sqrt(2))": "0", "Abs(1-sqrt(2))": "sqrt(2) - 1", "sin(6*pi/7)": "sin(pi/7)", "cos(5*pi/14)": "sin(pi/7)",
}


@pytest.mark.parametrize("text", CASES)
def test_texts(text):
    v = ans.parse_plain(text)
    assert v.text() == CASES[text]
    assert ans.parse_plain(v.text()).text() == v.text()


@pytest.mark.parametrize("text", ["1/0", "1/(sqrt(8)-2*sqrt(2))", "sqrt(1-sqrt(2))", "(-2)**0.5", "9**9**9", "1e999999999", "10**400", "tan(pi/2)", "0**-1", "(-8)**(1/3)"])
def test_errors(text):
    with pytest.raises((ans.AnswerError, OverflowError)):
        ans.parse_plain(text).number


def expression(rng, depth):
    k = rng.random()
    if not depth or k < 0.25:
        return rng.choice(["1", "2", "3", "5", "6", "7/2", "pi", "sqrt(2)", "sqrt(3)", "sqrt(6)", "sqrt(12)", "E", "cbrt(2)", "1/3"])
    if k < 0.6:
        return f"({expression(rng, depth - 1)}){rng.choice('+-*')}({expression(rng, depth - 1)})"
    if k < 0.8:
        return f"({expression(rng, depth - 1)})/({expression(rng, depth - 1)})"
    return f"sqrt(({expression(rng, depth - 1)})**2)" if k < 0.9 else f"({expression(rng, depth - 1)})**{rng.choice('23')}"


def test_equal_values_have_equal_texts():
    rng = random.Random(11)
    seen = 0
    while seen < 150:
        x, y = expression(rng, 3), expression(rng, 2)
        try:
            v, w = ans.parse_plain(x), ans.parse_plain(y)
            if not w.over:
                continue
        except ans.AnswerError:
            continue
        seen += 1
        same = [ans.parse_plain(t).text() for t in (f"(({x})*({y}))/({y})", f"({x})+({y})-({y})", v.text())]
        assert same == [v.text()] * 3, (x, y)
        plain = eval(x, {"pi": math.pi, "E": math.e, "sqrt": math.sqrt, "cbrt": math.cbrt})  # a text made above
        assert v.number == pytest.approx(plain, rel=1e-9, abs=1e-9)


def test_factors():
    for n in (1, 2, 97, 2**61 - 1, 10007**2 * 2, 1000003 * 1000033, 999999000001 * 3, 2**40 * 3**5):
        got = field.factors(n)
        assert math.prod(p**k for p, k in got.items()) == n and all(field._is_prime(p) for p in got)


def test_doubles_of_rationals_are_nearest():
    for q in (Fraction(1, 3), Fraction(-(10**40), 7), Fraction(2**70 + 1, 2**17), Fraction(1, 10**400), Fraction(3, 2**1075)):
        decimals, _ = field._evaluated(field.Sum({field.ONE: q}), 60)
        assert field.Value.of(q).number == float(decimals)
    a, b = field.Value.of(Fraction(3, 4)), ans.parse_plain("sqrt(2) + pi - 1/3")
    assert (a * b).text() == (b * a).text() == "3*pi/4 + 3*sqrt(2)/4 - 1/4"


def test_texts_of_one_file_are_parsed_in_many_tasks(spark):
    """A small file of many texts is one task to read; parsing isn't."""
    said = spark.range(0, 400, 1, 1).select(F.concat("id", F.lit("/7")).alias("text"))
    tasks = ans.dealt_texts(said, "text").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > spark.sparkContext.defaultParallelism
    for name in ("answer_parse_plain", "answer_parse_latex"):
        assert "REPARTITION_BY_NUM" in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_a_sine_of_a_large_angle():
    assert ans.parse_plain("sin(10**22)").number == pytest.approx(math.sin(10**22), rel=1e-12)


def test_each_text_has_one_side(spark):
    texts = [*CASES, "1/0", "x", "", None, "sqrt(-1)", "9**9**9", "sin(1)*cos(2)", "pi**sqrt(2)", "(1+cbrt(2)+sqrt(3))**-1", "__import__('os')", "(" * 5000, "1e-400", "2**-1100"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = ans.with_fields(df, "text", "a").select("i", "text", "a.*").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.exact is None) != (r.error is None) and (r.value is None) == (r.exact is None), r
