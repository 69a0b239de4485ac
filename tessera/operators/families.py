"""The four problem families as Column builders: typed parameters, ordered issues, exact answers, figures, and whole spaces.

A family never sees rows. validation, answers and figures are expressions, so a user's family gets the
same generated code as those here; see Family for the contract and register() to add one.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.functions import geometry as G
from tessera.functions import spec as S

GEOMETRY, READABILITY = "geometry", "readability"
SHADED_REGION, SHADED_FIGURE = "Find the area of the shaded region.", "Find the area of the shaded figure."
KINDS = ("integer", "length", "lattice_points")


class ContractError(ValueError):
    """A family that doesn't keep the contract; the message names the family and what is wrong."""


class Issue(NamedTuple):
    """A check: it holds where `when` does. key: the reason without its measurements, by which rejections are counted."""

    severity: str
    when: Column
    reason: Column
    key: Column


def reason_key(reason: Column) -> Column:
    """A reason without its measurements: up to the first parenthesis, without words that hold a digit."""
    words = F.filter(F.split(F.trim(F.split_part(reason, F.lit("("), F.lit(1))), r"\s+"), lambda w: ~w.rlike("[0-9]"))
    return F.array_join(words, " ")


def issue(severity: str, when: Column, reason: Column | str, key: str | None = None) -> Issue:
    """key: stated where the reason is made of a row's values, so that counting needs no text of each row."""
    text = F.lit(reason) if isinstance(reason, str) else reason
    return Issue(severity, when, text, reason_key(text) if key is None else F.lit(key))


def from_verdict(verdict: Column) -> list[Issue]:
    """Checks of a family that only says whether parameters are valid: true, false, or text with the reason.

    False and empty text reject as "unspecified"; null breaks the contract and ends the query.
    """
    text = verdict.cast("string")
    broken = F.raise_error("a family's verdict must be true, false or text").cast("string")
    reason = F.when(text.isNull(), broken).when(text.isin("false", ""), "unspecified").otherwise(text)
    return [issue(READABILITY, text.isNull() | (text != "true"), reason)]


@dataclass(frozen=True)
class Family:
    """name; params: column -> kind (integer, length, lattice_points); the rest take a dict of columns.

    checks: ordered issues. terms and decimal: the exact answer and its value. spec: the figure (functions.spec).
    space: all parameter sets that can be drawn, or None where that isn't known.
    """

    name: str
    params: dict[str, str]
    stem: str
    checks: Callable[[dict[str, Column]], list[Issue]]
    terms: Callable[[dict[str, Column]], Column]
    decimal: Callable[[dict[str, Column]], Column]
    spec: Callable[[dict[str, Column]], Column]
    space: Callable[[SparkSession], DataFrame] | None = None

    def columns(self, df: DataFrame) -> dict[str, Column]:
        return {k: F.col(k) for k in self.params}


def number_text(x: Column) -> Column:
    """A length without needless zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast(exact.LENGTH).cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


# --- nested regular polygons ----------------------------------------------------------------------
def _fill(p: dict) -> Column:
    return G.circumradius(p["m"], p["side_inner"].cast("double")) / G.apothem(p["n"], p["side_outer"].cast("double"))


def inner_fits(p: dict) -> Column:
    """Whether each corner of the inner polygon is left of or on each edge of the outer one.

    The corner nearest to an edge's normal is off it by a whole number of steps of pi / (n m), and over all edges the
    least such number is 0 where n / gcd(n, m) is even, else gcd(n, m): one distance decides, without a loop.
    """
    n, m, so, si = p["n"], p["m"], p["side_outer"].cast("double"), p["side_inner"].cast("double")

    def clear(g: Column) -> Column:
        off = F.when((n / g).cast("long") % 2 == 0, 0).otherwise(g) * F.pi() / (n * m)
        return so * (G.apothem(n, so) - G.circumradius(m, si) * F.cos(off)) >= F.pow(G.circumradius(n, so), 2) * -1e-9

    return G.bound(exact.gcd_long(n, m), clear)


def _nested_checks(p: dict) -> list:
    n, m, so, si = (p[k] for k in ("n", "m", "side_outer", "side_inner"))
    sound = (n >= 3) & (m >= 3) & (so > 0) & (si > 0)
    ratio = F.when(sound, _fill(p))
    fits, small = "inner polygon does not fit with clearance", "inner polygon too small to read"
    tight = F.concat(F.lit(fits + " (fill ratio "), F.format_string("%.3f", ratio), F.lit(" > 0.9)"))
    count = lambda label, x: (F.concat(F.lit(f"{label} side count "), x.cast("string"), F.lit(" outside [3, 12]")), f"{label} side count outside")
    return [
        issue(GEOMETRY, n < 3, *count("outer", n)),
        issue(READABILITY, n > 12, *count("outer", n)),
        issue(GEOMETRY, m < 3, *count("inner", m)),
        issue(READABILITY, m > 12, *count("inner", m)),
        issue(READABILITY, m >= n, F.concat(F.lit("inner side count "), m.cast("string"), F.lit(" is not less than outer "), n.cast("string")), "inner side count is not less than outer"),
        issue(GEOMETRY, (so <= 0) | (si <= 0), "side lengths must be positive"),
        # a ratio of at most 1 fits at any turn; the exact test is for the others
        issue(GEOMETRY, F.when(sound & (ratio > 1), ~inner_fits(p)), tight, fits),
        issue(READABILITY, ratio > 0.9, tight, fits),
        issue(READABILITY, ratio < 0.15, F.concat(F.lit(small + " (fill ratio "), F.format_string("%.3f", ratio), F.lit(" < 0.15)")), small),
    ]


def _sequence(low: int | Column, high: int | Column) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.explode(F.sequence(c(low).cast("long"), c(high).cast("long")))


def _nested_space(spark: SparkSession) -> DataFrame:
    df = spark.range(4, 13).select(F.col("id").alias("n"))
    df = df.select("n", _sequence(3, F.col("n") - 1).alias("m"))
    return df.select("*", _sequence(1, 20).alias("side_outer")).select("*", _sequence(1, 20).alias("side_inner"))


def _sided(k: Column, side: Column) -> Column:
    return G.regular_vertices(k, side.cast("double"))


def _side_labels(points: Column, side: Column, owner: str) -> Column:
    return S.length_labels(points, side.cast("double"), number_text(side), owner)


def _nested_spec(p: dict) -> Column:
    """Both outlines with a label on each side; the side counts are left for the reader to count."""

    def drawn(c: Column) -> Column:
        labels = [_side_labels(c["outer"], p["side_outer"], "outer"), _side_labels(c["inner"], p["side_inner"], "inner")]
        return S.figure(S.polygon("outer", c["outer"], "outline"), S.polygon("inner", c["inner"], "hole"), S.region("difference", "outer", "inner"), labels=labels)

    return G.bound(F.struct(_sided(p["n"], p["side_outer"]).alias("outer"), _sided(p["m"], p["side_inner"]).alias("inner")), drawn)


NESTED = Family(
    "nested_polygons",
    {"n": "integer", "m": "integer", "side_outer": "length", "side_inner": "length"},
    SHADED_REGION,
    _nested_checks,
    lambda p: exact.summed(exact.polygon_terms(p["n"], p["side_outer"]), exact.polygon_terms(p["m"], p["side_inner"], -1)),
    lambda p: G.area_regular(p["n"], p["side_outer"].cast("double")) - G.area_regular(p["m"], p["side_inner"].cast("double")),
    _nested_spec,
    space=_nested_space,
)


# --- a circle inscribed in a regular polygon ------------------------------------------------------
def _circle_checks(p: dict) -> list:
    k, side = p["k"], p["side"]
    ring = F.when((k >= 3) & (side > 0), 1 - F.pi() / (k * F.tan(F.pi() / k)))
    count = (F.concat(F.lit("side count "), k.cast("string"), F.lit(" outside [3, 8]")), "side count outside")
    return [
        issue(GEOMETRY, k < 3, *count),
        issue(READABILITY, k > 8, *count),
        issue(GEOMETRY, side <= 0, "side length must be positive"),
        issue(READABILITY, ring < 0.05, F.concat(F.lit("ring too thin to read (occupies "), F.format_string("%.3f", ring), F.lit(" of the polygon, below 0.05)")), "ring too thin to read"),
    ]


def _circle_spec(p: dict) -> Column:
    zero = F.lit(0.0)
    inside = S.circle("circle", F.array(zero, zero), G.apothem(p["k"], p["side"].cast("double")), "hole")
    return G.bound(_sided(p["k"], p["side"]), lambda outer: S.figure(S.polygon("outer", outer, "outline"), inside, S.region("difference", "outer", "circle"), labels=[_side_labels(outer, p["side"], "outer")]))


CIRCLE = Family(
    "inscribed_circle",
    {"k": "integer", "side": "length"},
    SHADED_REGION,
    _circle_checks,
    lambda p: exact.summed(exact.polygon_terms(p["k"], p["side"]), exact.incircle_terms(p["k"], p["side"], -1)),
    lambda p: G.area_regular(p["k"], p["side"].cast("double")) - F.pi() * F.pow(G.apothem(p["k"], p["side"].cast("double")), 2),
    _circle_spec,
    space=lambda spark: spark.range(3, 9).select(F.col("id").alias("k"), _sequence(1, 20).alias("side")),
)


# --- a rectangle with a corner notch --------------------------------------------------------------
def _composite_checks(p: dict) -> list:
    w, h, a, b = (p[k] for k in ("width", "height", "notch_w", "notch_h"))
    dims = F.concat(number_text(w), F.lit("x"), number_text(h))
    outside = (F.concat(F.lit("outer dimensions "), dims, F.lit(" outside [4, 20]")), "outer dimensions outside")
    inside = F.concat(F.lit("notch "), number_text(a), F.lit("x"), number_text(b), F.lit(" is not strictly inside "), dims)

    def fraction(label: str, part: Column, whole: Column) -> Issue:
        f = F.when(whole > 0, part.cast("double") / whole.cast("double"))
        reason = F.concat(F.lit(f"notch {label} is "), F.format_string("%.2f", f), F.lit(" of the figure, outside [0.25, 0.75]"))
        return issue(READABILITY, ~f.between(0.25, 0.75), reason, f"notch {label} is of the figure, outside")

    return [
        issue(GEOMETRY, (w <= 0) | (h <= 0), *outside),
        issue(READABILITY, ~w.between(4, 20) | ~h.between(4, 20), *outside),
        issue(GEOMETRY, (a <= 0) | (b <= 0), "notch must have positive dimensions"),
        issue(GEOMETRY, (a >= w) | (b >= h), inside, "notch is not strictly inside"),
        fraction("width", a, w),
        fraction("height", b, h),
    ]


def outline(p: dict) -> Column:
    """The six corners, counter-clockwise from the origin."""
    w, h, a, b = (p[k].cast("double") for k in ("width", "height", "notch_w", "notch_h"))
    zero = F.lit(0.0)
    return F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h - b), F.array(w - a, h - b), F.array(w - a, h), F.array(zero, h))


#: Edges of the outline whose labels are withheld: their lengths follow from the others.
WITHHELD = (1, 4)


def _composite_spec(p: dict) -> Column:
    points = outline(p)
    edges = (p["width"], p["height"] - p["notch_h"], p["notch_w"], p["notch_h"], p["width"] - p["notch_w"], p["height"])
    values, texts = F.array(*[x.cast("double") for x in edges]), F.array(*[number_text(x) for x in edges])
    labels = S.length_labels(points, lambda i: F.get(values, i), lambda i: F.get(texts, i), "outline", lambda i: ~i.isin(*WITHHELD))
    return S.figure(S.polygon("outline", points, "outline"), S.region("union", "outline"), labels=[labels])


def _composite_space(spark: SparkSession) -> DataFrame:
    df = spark.range(4, 21).select(F.col("id").alias("width"), _sequence(4, 20).alias("height"))
    return df.select("*", _sequence(1, F.col("width") - 1).alias("notch_w")).select("*", _sequence(1, F.col("height") - 1).alias("notch_h"))


COMPOSITE = Family(
    "composite_rectilinear",
    {"width": "length", "height": "length", "notch_w": "length", "notch_h": "length"},
    SHADED_FIGURE,
    _composite_checks,
    lambda p: exact.summed(exact.notched_terms(p["width"], p["height"], p["notch_w"], p["notch_h"])),
    lambda p: p["width"].cast("double") * p["height"].cast("double") - p["notch_w"].cast("double") * p["notch_h"].cast("double"),
    _composite_spec,
    space=_composite_space,
)


# --- a polygon on lattice points ------------------------------------------------------------------
def _coordinate_checks(p: dict) -> list:
    points = p["points"]
    n = F.size(points)
    count = (F.concat(F.lit("vertex count "), n.cast("string"), F.lit(" outside [3, 4]")), "vertex count outside")
    distinct = F.size(F.array_distinct(points)) == n
    usable = (n >= 3) & distinct
    outside = F.filter(points, lambda q: ~q[0].between(-6, 6) | ~q[1].between(-6, 6))
    first = F.get(outside, F.lit(0))
    shape, shape_key = "vertices are collinear or wind inconsistently (non-convex or self-intersecting)", "vertices are collinear or wind inconsistently"
    area = F.when(usable, G.shoelace(points))
    beyond = F.concat(F.lit("vertex ("), first[0].cast("string"), F.lit(", "), first[1].cast("string"), F.lit(") outside the lattice bounds"))
    return [
        issue(GEOMETRY, n < 3, *count),
        issue(READABILITY, n > 4, *count),
        issue(GEOMETRY, ~distinct, "duplicate vertices", "duplicate vertices"),
        issue(READABILITY, F.size(outside) > 0, beyond, "vertex"),
        issue(GEOMETRY, F.when(usable, ~G.is_simple(points)), shape, shape_key),
        issue(READABILITY, F.when(usable, ~G.is_convex(points)), shape, shape_key),
        issue(READABILITY, area < 6.0, F.concat(F.lit("area "), F.format_string("%.1f", area), F.lit(" is below the readable minimum of 6.0")), "area is below the readable minimum of"),
    ]


#: Corners of a lattice polygon whose labels are drawn; the others are read off the axes.
LABELLED = 2


def _coordinate_spec(p: dict) -> Column:
    points = F.transform(p["points"], lambda q: F.array(q[0].cast("double"), q[1].cast("double")))
    text = lambda q: F.concat(F.lit("("), q[0].cast("string"), F.lit(", "), q[1].cast("string"), F.lit(")"))
    labels = F.transform(p["points"], lambda q, i: S.primitive("point_label", point=F.array(q[0].cast("double"), q[1].cast("double")), text=text(q), draw=i < LABELLED, owner="outline"))
    return S.figure(S.primitive("axes", step=1.0), S.polygon("outline", points, "outline"), S.region("union", "outline"), labels=[labels])


COORDINATE = Family(
    "coordinate_polygon",
    {"points": "lattice_points"},
    SHADED_REGION,
    _coordinate_checks,
    lambda p: exact.summed(exact.rational_term(F.abs(G.twice_signed_area(p["points"])), F.lit(2))),
    lambda p: G.shoelace(p["points"]),
    _coordinate_spec,
)

_FAMILIES: dict[str, Family] = {}
_BUILDERS = ("checks", "terms", "decimal", "spec")


def register(family: Family) -> Family:
    """Add a family; the same one again is fine, another of the same name isn't. What breaks the contract is named."""
    name = getattr(family, "name", family)
    for what in ("name", "params", "stem", *_BUILDERS):
        if not getattr(family, what, None):
            raise ContractError(f"family {name!r} lacks {what}")
    for what in (*_BUILDERS, *(["space"] if family.space is not None else [])):
        builder = getattr(family, what)
        if not callable(builder):
            raise ContractError(f"family {name!r}: {what} must be callable")
        try:
            inspect.signature(builder).bind(object())
        except TypeError as e:
            raise ContractError(f"family {name!r}: {what} must take one argument") from e
    bad = {k: v for k, v in family.params.items() if v not in KINDS}
    if bad:
        raise ContractError(f"family {name!r} has unknown kinds: {bad}")
    if _FAMILIES.setdefault(family.name, family) is not family:
        raise ContractError(f"another family is registered as {name!r}")
    return family


def discover(package: str) -> list[str]:
    """Register each Family that a module of a package holds; the names, sorted. Modules that begin with _ are passed by."""
    found, root = set(), importlib.import_module(package)
    for info in pkgutil.iter_modules(root.__path__):
        if not info.name.startswith("_"):
            module = importlib.import_module(f"{package}.{info.name}")
            found |= {register(x).name for x in vars(module).values() if isinstance(x, Family)}
    return sorted(found)


def get(name: str) -> Family:
    if name not in _FAMILIES:
        raise KeyError(f"unknown family {name!r}; available: {available()}")
    return _FAMILIES[name]


def available() -> list[str]:
    return sorted(_FAMILIES)


for _f in (NESTED, CIRCLE, COMPOSITE, COORDINATE):
    register(_f)
