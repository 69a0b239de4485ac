"""Exact answers: sums of a rational times a basis (1, roots, pi, cotangents), as arrays of terms and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import bound

#: A length: 18 places, of which a figure's lengths use DIGITS at most together with those before the point.
LENGTH, DIGITS = "decimal(38,18)", 17
_BIG = "decimal(38,0)"
#: k -> (basis, numerator, denominator) of k / 4 * cot(pi / k), for those k whose cotangent is written with square roots here.
POLYGON = {3: [("sqrt(3)", 1, 4)], 4: [("1", 1, 1)], 6: [("sqrt(3)", 3, 2)], 8: [("1", 2, 1), ("sqrt(2)", 2, 1)], 12: [("1", 6, 1), ("sqrt(3)", 3, 1)]}
#: k -> the same of pi / 4 * cot(pi / k) ** 2.
INCIRCLE = {3: [("pi", 1, 12)], 4: [("pi", 1, 4)], 6: [("pi", 3, 4)], 8: [("pi", 3, 4), ("sqrt(2)*pi", 1, 2)], 12: [("pi", 7, 4), ("sqrt(3)*pi", 1, 1)]}


def places(length: Column) -> Column:
    """How many decimal places a length has, without needless zeros."""
    return F.length(F.regexp_extract(length.cast(LENGTH).cast("string"), r"\.([0-9]*?)0*$", 1))


def too_long(*lengths: Column) -> Column:
    """Whether lengths need more digits over one unit than squares and sums of squares have room for."""
    units = lambda x: F.length(F.regexp_extract(x.cast(LENGTH).cast("string"), r"^-?0*([0-9]*)\.", 1))
    most = lambda of: F.greatest(*map(of, lengths)) if len(lengths) > 1 else of(lengths[0])
    return most(units) + most(places) > DIGITS


def scaled(*lengths: Column) -> tuple[list[Column], Column]:
    """Lengths as whole numbers over one unit, a power of ten: that of the one with the most places. So none loses a digit."""
    most = F.greatest(*map(places, lengths)) if len(lengths) > 1 else places(lengths[0])
    unit = F.rpad(F.lit("1"), most + 1, "0").cast(_BIG)
    return [(x.cast(LENGTH) * unit).cast(_BIG) for x in lengths], unit


def squared(length: Column) -> tuple[Column, Column]:
    """A length's square as a numerator and a denominator."""
    (n,), unit = scaled(length)
    return (n * n).cast(_BIG), (unit * unit).cast(_BIG)


def _steps(a: Column, b: Column) -> Column:
    """As many steps as Euclid's algorithm can need for the smaller number, and one to bring the larger to the front."""
    return F.sequence(F.lit(1), (F.log2(F.least(F.abs(a), F.abs(b)).cast("double") + 1) * 1.45).cast("int") + 3)


def _euclid(a: Column, b: Column, kind: str) -> Column:
    start = F.struct(F.abs(a).cast(kind).alias("x"), F.abs(b).cast(kind).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1).cast(kind)).otherwise(s["y"])).cast(kind).alias("y")))
    return F.aggregate(_steps(a, b), start, step)["x"]


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole decimals by Euclid's steps."""
    return _euclid(a, b, _BIG)


def gcd_long(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers of 64 bits."""
    return _euclid(a, b, "bigint")


def term(basis: Column, num: Column, den: Column) -> Column:
    """A term in lowest terms. A denominator that divides its numerator, as whole lengths give, needs no steps."""
    g = F.when(num % den == 0, F.abs(den)).otherwise(F.greatest(gcd(num, den), F.lit(1).cast(_BIG)))
    of = F.struct(basis.alias("basis"), num.alias("num"), den.alias("den"), g.alias("g"))
    return bound(of, lambda t: F.struct(t["basis"].alias("basis"), (t["num"] / t["g"]).cast(_BIG).alias("num"), (t["den"] / t["g"]).cast(_BIG).alias("den")))


def _terms(table: dict, k: Column, square: tuple[Column, Column], basis: Column, times: Column, sign: int) -> Column:
    """square: a side's square, over its unit's. Side counts that the table lacks have one term, of their own basis over 4."""
    top, unit = square
    make = lambda b, n, d: F.struct(b.alias("basis"), (top * n).cast(_BIG).alias("num"), (unit * d).cast(_BIG).alias("den"))
    out = F.array(make(basis, times, F.lit(4)))
    for own, rows in table.items():
        out = F.when(k == own, F.array(*[make(F.lit(b), F.lit(sign * n), F.lit(d)) for b, n, d in rows])).otherwise(out)
    return out


def polygon_terms(k: Column, side: Column, sign: int = 1) -> Column:
    return _terms(POLYGON, k, squared(side), F.concat(F.lit("cot(pi/"), k.cast("string"), F.lit(")")), k * sign, sign)


def incircle_terms(k: Column, side: Column, sign: int = 1) -> Column:
    return _terms(INCIRCLE, k, squared(side), F.concat(F.lit("pi*cot(pi/"), k.cast("string"), F.lit(")**2")), F.lit(sign), sign)


def notched_terms(width: Column, height: Column, notch_w: Column, notch_h: Column) -> Column:
    """A rectangle less a rectangle."""
    (w, h, a, b), unit = scaled(width, height, notch_w, notch_h)
    return rational_term((w * h).cast(_BIG) - (a * b).cast(_BIG), (unit * unit).cast(_BIG))


def rational_term(num: Column, den: Column) -> Column:
    return F.array(F.struct(F.lit("1").alias("basis"), num.cast(_BIG).alias("num"), den.cast(_BIG).alias("den")))


def summed(*parts: Column) -> Column:
    """One term for each basis that doesn't cancel, in lowest terms and in the order of bases; the rational one last."""
    zero = F.struct(F.lit(0).cast(_BIG).alias("num"), F.lit(1).cast(_BIG).alias("den"))

    def add(s: Column, t: Column) -> Column:
        # denominators are mostly multiples of one another, so the greater one is common to both
        sum_of = lambda num, den: F.struct(num.cast(_BIG).alias("num"), den.cast(_BIG).alias("den"))
        whole = lambda a, b: (a / b).cast(_BIG)
        return (
            F.when(s["den"] == t["den"], sum_of(s["num"] + t["num"], s["den"])).when(t["den"] % s["den"] == 0, sum_of(s["num"] * whole(t["den"], s["den"]) + t["num"], t["den"]))
            .when(s["den"] % t["den"] == 0, sum_of(s["num"] + t["num"] * whole(s["den"], t["den"]), s["den"])).otherwise(sum_of(s["num"] * t["den"] + t["num"] * s["den"], s["den"] * t["den"]))
        )

    def totals(terms: Column) -> Column:
        bases = F.array_sort(F.array_distinct(F.transform(terms, lambda t: t["basis"])))
        total = lambda b: bound(F.aggregate(F.filter(terms, lambda t: t["basis"] == b), zero, add), lambda s: term(b, s["num"], s["den"]))
        return F.filter(F.transform(bases, total), lambda t: t["num"] != 0)

    return bound(bound(F.concat(*parts), totals), lambda found: F.concat(F.filter(found, lambda t: t["basis"] != "1"), F.filter(found, lambda t: t["basis"] == "1")))


def as_text(terms: Column) -> Column:
    """Like `100 - 9*sqrt(3)`: a leading negative term trades places with a later positive one; nothing is `0`."""

    def shown(t: Column) -> Column:
        n, plain = F.abs(t["num"]).cast("string"), t["basis"] == "1"
        top = F.when(plain, n).when(F.abs(t["num"]) == 1, t["basis"]).otherwise(F.concat(n, F.lit("*"), t["basis"]))
        return F.when(t["den"] == 1, top).otherwise(F.concat(top, F.lit("/"), t["den"].cast("string")))

    ordered = F.concat(F.filter(terms, lambda t: t["num"] > 0), F.filter(terms, lambda t: t["num"] < 0))
    text = F.aggregate(ordered, F.lit(""), lambda s, t: F.concat(s, F.when(s == "", F.when(t["num"] < 0, "-").otherwise("")).when(t["num"] < 0, " - ").otherwise(" + "), shown(t)))
    return F.when(F.size(terms) == 0, "0").otherwise(text)
