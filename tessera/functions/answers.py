"""Answer texts: plain arithmetic and a LaTeX subset, parsed by hand and evaluated exactly.

A value is a number of functions.field: equal values of roots, pi and e have one text, and a text that isn't one finite
real constant has an error. No text is ever evaluated as code.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.field import BITS, PI, E, NotExact, Sum, Value

#: The names that an answer may use.
NAMES = ("sqrt", "cbrt", "pi", "E", "Rational", "Abs", "sin", "cos", "tan")
_TOKEN = re.compile(r"\s*(?:([0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)|([A-Za-z_][A-Za-z_0-9]*)|(\*\*|[-+*/^(),]))")


#: A text that isn't one finite real constant.
AnswerError = NotExact


class _Parser:
    """expression = term (+|- term)*; term = factor (*|/ factor)*; factor = sign* power; power = atom (^ factor)?"""

    def __init__(self, text: str, implicit: bool = False):
        self.tokens, at, self.implicit = [], 0, implicit
        text = text.strip()
        unknown = set()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise AnswerError(f"{text[at:].strip()[:1]!r} is not allowed")
            number, name, op = m.groups()
            if name and name not in NAMES:
                unknown.add(name)
            self.tokens.append(("n", number) if number else ("a", name) if name else ("o", "**" if op == "^" else op))
            at = m.end()
        if unknown:
            raise AnswerError(f"unknown symbols {sorted(unknown)}")
        if not self.tokens:
            raise AnswerError("nothing to parse")
        self.at = 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "o" and self.tokens[self.at][1] in ops

    def take(self, op: str) -> None:
        if not self.peek(op):
            raise AnswerError(f"{op!r} is missing")
        self.at += 1

    def whole(self) -> Value:
        out = self.sum()
        if self.at < len(self.tokens):
            raise AnswerError(f"{self.tokens[self.at][1]!r} is out of place")
        return out

    def sum(self) -> Value:
        out = self.product()
        while self.peek("+", "-"):
            minus = self.tokens[self.at][1] == "-"
            self.at += 1
            other = self.product()
            out = out + (-other if minus else other)
        return out

    def product(self) -> Value:
        out = self.signed()
        while True:
            if self.peek("*", "/"):
                over = self.tokens[self.at][1] == "/"
                self.at += 1
                other = self.signed()
                out = out * (other.inverse() if over else other)
            elif self.implicit and self.at < len(self.tokens) and (self.tokens[self.at][0] != "o" or self.peek("(")):
                out = out * self.power()
            else:
                return out

    def signed(self) -> Value:
        if self.peek("-", "+"):
            minus = self.tokens[self.at][1] == "-"
            self.at += 1
            out = self.signed()
            return -out if minus else out
        return self.power()

    def power(self) -> Value:
        base = self.atom()
        if self.peek("**"):
            self.at += 1
            return base.power(self.signed())
        return base

    def arguments(self) -> list[Value]:
        self.take("(")
        out = [self.sum()]
        while self.peek(","):
            self.at += 1
            out.append(self.sum())
        self.take(")")
        return out

    def atom(self) -> Value:
        if self.at >= len(self.tokens):
            raise AnswerError("the text ends too early")
        kind, said = self.tokens[self.at]
        if kind == "o":
            self.take("(")
            out = self.sum()
            self.take(")")
            return out
        self.at += 1
        if kind == "n":
            if abs(int(said.lower().partition("e")[2] or 0)) > BITS or len(said) > BITS:
                raise AnswerError("a number has too many digits")
            return Value.of(Fraction(int(said) if said.isdigit() else said))
        if said in ("pi", "E"):
            return Value(Sum({((), ((PI if said == "pi" else E, Fraction(1)),)): Fraction(1)}))
        x = self.arguments()
        if said == "Rational":
            if len(x) not in (1, 2):
                raise AnswerError("Rational takes one or two numbers")
            return x[0] if len(x) == 1 else x[0] * x[1].inverse()
        if len(x) != 1:
            raise AnswerError(f"{said} takes one argument")
        v = x[0]
        if said == "sqrt":
            return v.root(2)
        if said == "cbrt":
            return -(-v).root(3) if v.number < 0 else v.root(3)
        if said == "Abs":
            return v.magnitude()
        return v.sine() if said == "sin" else v.sine(1) if said == "cos" else v.sine() * v.sine(1).inverse()


def parse_plain(text: str) -> Value:
    """A constant: numbers, + - * / ** ^ ( ) , and the allowed names."""
    return _checked(_Parser(text).whole())


_SPAN = re.compile(r"\\\((.*?)\\\)", re.S)
_UNIT = re.compile(r"^\s*\^\s*\{?\s*\d+\s*\}?\s*$")


def _group(s: str, at: int) -> tuple[str, int]:
    """A braced group or one character from `at` on, and where it ends."""
    while at < len(s) and s[at] == " ":
        at += 1
    if at < len(s) and s[at] == "{":
        depth = 0
        for k in range(at, len(s)):
            depth += {"{": 1, "}": -1}.get(s[k], 0)
            if depth == 0:
                return s[at + 1 : k], k + 1
        raise AnswerError("a brace isn't closed")
    if at >= len(s):
        raise AnswerError("the text ends too early")
    return s[at], at + 1


def latex_to_plain(s: str) -> str:
    out, at = [], 0
    while at < len(s):
        if s.startswith("\\frac", at):
            a, at = _group(s, at + 5)
            b, at = _group(s, at)
            out.append(f"(({latex_to_plain(a)})/({latex_to_plain(b)}))")
        elif s.startswith("\\sqrt", at):
            a, at = _group(s, at + 5)
            out.append(f" sqrt({latex_to_plain(a)})")
        elif m := re.match(r"\\(pi|cdot|times)(?![A-Za-z])", s[at:]):
            out.append(" pi " if m[1] == "pi" else "*")
            at += m.end()
        elif s[at] in "{}":
            out.append("(" if s[at] == "{" else ")")
            at += 1
        elif s[at] == "\\":
            raise AnswerError(f"unresolved LaTeX in {s!r}")
        else:
            out.append(" E " if s[at] == "e" else s[at])
            at += 1
    return "".join(out)


def parse_latex(answer: str) -> Value:
    """A published answer: exactly one mathematical span that isn't a unit's exponent; of an equation the right side, of an approximation the exact form."""
    spans = [s.strip() for s in _SPAN.findall(answer) if s.strip() and not _UNIT.match(s)]
    if len(spans) != 1:
        raise AnswerError("no mathematical span found" if not spans else f"{len(spans)} mathematical spans, ambiguous which is the answer")
    s = spans[0].replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac")
    for noise in ("\\displaystyle", "\\left", "\\right", "\\!", "\\,", "\\;"):
        s = s.replace(noise, " ")
    s = " ".join(s.split()).split("\\approx")[0].rpartition("=")[2]
    return _checked(_Parser(latex_to_plain(s), implicit=True).whole())


def _checked(v: Value) -> Value:
    if not math.isfinite(v.number):
        raise AnswerError("not a finite real number")
    return v


_FIELDS = T.StructType([T.StructField("exact", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())])


def _fields(parse, texts: pd.Series) -> pd.DataFrame:
    """exact and value, or error: of each text one side is null."""
    known: dict = {}
    for t in texts:
        if t not in known:
            try:
                v = parse(t or "")
                known[t] = (v.text(), v.number, None)
            except (NotExact, OverflowError, RecursionError, ZeroDivisionError, ArithmeticError) as e:
                known[t] = (None, None, str(e) or type(e).__name__)
    return pd.DataFrame([known[t] for t in texts], columns=["exact", "value", "error"])


@F.pandas_udf(_FIELDS)
def plain_fields(texts: pd.Series) -> pd.DataFrame:
    return _fields(parse_plain, texts)


@F.pandas_udf(_FIELDS)
def latex_fields(texts: pd.Series) -> pd.DataFrame:
    return _fields(parse_latex, texts)


def dealt_texts(texts: DataFrame, text: str) -> DataFrame:
    """The distinct values of a text column, dealt evenly over four tasks a core.

    A text takes a worker some hundred microseconds and is few bytes: by size all of them would land in the few tasks of their file.
    """
    return texts.select(text).distinct().repartition(4 * max(1, texts.sparkSession.sparkContext.defaultParallelism), text)


def with_fields(df: DataFrame, text: str, name: str, latex: bool = False) -> DataFrame:
    """The rows with a struct (exact, value, error) of the text column: each distinct text is parsed once, wherever its rows are.

    A null text is one that says nothing.
    """
    key = F.coalesce(F.col(text), F.lit(""))
    parse = latex_fields if latex else plain_fields
    texts = dealt_texts(df.select(key.alias("_said")), "_said").select("_said", parse("_said").alias(name))
    return df.withColumn("_key", key).join(texts, F.col("_key") == F.col("_said")).drop("_key", "_said")


def math_spans(text: Column) -> Column:
    """The spans between \\( and \\), trimmed, without blank ones and units' exponents."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\\\((.*?)\\\)"), F.lit(1)), lambda s: F.trim(s))
    return F.filter(spans, lambda s: (s != "") & ~s.rlike(r"^\^\s*\{?\s*[0-9]+\s*\}?$"))


def clean_span(span: Column) -> Column:
    s = F.replace(F.replace(span, F.lit("\\dfrac"), F.lit("\\frac")), F.lit("\\tfrac"), F.lit("\\frac"))
    for noise in ("\\displaystyle", "\\left", "\\right", "\\!", "\\,", "\\;"):
        s = F.replace(s, F.lit(noise), F.lit(" "))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def fill_in(harvested: DataFrame) -> DataFrame:
    """Harvested records with answer_exact and answer_decimal from their original_answer, and a column answer_error.

    What can't be parsed leaves both null, not guessed, and says why; a record without an answer is such a one.
    """
    df = with_fields(harvested, "original_answer", "_parsed", latex=True)
    return df.withColumns({"answer_exact": F.col("_parsed.exact"), "answer_decimal": F.col("_parsed.value"), "answer_error": F.col("_parsed.error")}).drop("_parsed")
