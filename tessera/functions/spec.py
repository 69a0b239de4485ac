"""Figures as data: an array of primitives (shapes, regions, labels, axes), built, checked and measured by built-in expressions.

A figure's measure comes from this column alone, never from the parameters that it was made from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions.geometry import bound

#: A primitive's fields; each kind uses some of them.
FIELDS = {
    "kind": "string", "id": "string", "points": "array<array<double>>", "center": "array<double>", "radius": "double", "role": "string", "operation": "string", "of": "array<string>", "style": "string", "measure": "string",
    "segment": "array<array<double>>", "value": "double", "point": "array<double>", "text": "string", "draw": "boolean", "owner": "string", "step": "double",
}
TYPE = "array<struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">>"
#: Kinds of primitives, those with curved edges, and how shapes combine.
SHAPES, CURVED_KINDS, OPERATIONS = ("polygon", "circle"), ("circle", "arc", "sector"), ("difference", "union", "intersection")
KINDS = (*SHAPES, "region", "length_label", "point_label", "axes")
_NEAR = 1e-9


def primitive(kind: str, **fields: Column | str | float | bool) -> Column:
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*[value(kind if k == "kind" else fields.get(k)).cast(t).alias(k) for k, t in FIELDS.items()])


def polygon(name: str, points: Column, role: str | None = None) -> Column:
    return primitive("polygon", id=name, points=points, role=role)


def circle(name: str, center: Column, radius: Column, role: str | None = None) -> Column:
    return primitive("circle", id=name, center=center, radius=radius, role=role)


def region(operation: str, *of: str, measure: str | None = None, style: str = "shaded") -> Column:
    return primitive("region", operation=operation, of=F.array(*map(F.lit, of)), measure=measure, style=style)


def length_labels(points: Column, value: Column | Callable, text: Column | Callable, owner: str, drawn: Column | bool = True) -> Column:
    """A label for each edge; value, text and drawn: the same for all edges, or an array with one for each."""
    of = lambda x, i: x(i) if callable(x) else x
    return F.transform(G.edges(points), lambda e, i: primitive("length_label", segment=F.array(e["a"], e["b"]), value=of(value, i), text=of(text, i), draw=of(drawn, i), owner=owner))


def figure(*parts: Column, labels: list[Column] | None = None) -> Column:
    return F.concat(F.array(*parts), *(labels or []))


def of_kind(spec: Column, *kinds: str) -> Column:
    return F.filter(spec, lambda s: s["kind"].isin(*kinds))


def has_curve(spec: Column) -> Column:
    return F.exists(spec, lambda s: s["kind"].isin(*CURVED_KINDS))


def fault(spec: Column) -> Column:
    """The first thing that keeps a figure from being built, null if there is none."""
    shapes, regions = of_kind(spec, *SHAPES), of_kind(spec, "region")
    ids = F.transform(shapes, lambda s: s["id"])
    first = lambda a: F.get(a, F.lit(0))
    curved = first(F.filter(spec, lambda s: s["kind"].isin("arc", "sector")))["kind"]
    unknown = first(F.filter(spec, lambda s: s["kind"].isNull() | ~s["kind"].isin(*KINDS, "arc", "sector")))
    few = first(F.filter(shapes, lambda s: (s["kind"] == "polygon") & (F.coalesce(F.size(s["points"]), F.lit(0)) < 3)))["id"]
    crossed = first(F.filter(shapes, lambda s: (s["kind"] == "polygon") & ~F.coalesce(G.is_simple(s["points"]), F.lit(False))))["id"]
    flat = first(F.filter(shapes, lambda s: (s["kind"] == "circle") & ~F.coalesce(s["radius"] > 0, F.lit(False))))["id"]
    operation = first(F.filter(regions, lambda r: ~F.coalesce(r["operation"].isin(*OPERATIONS), F.lit(False))))
    operands = first(F.filter(regions, lambda r: F.coalesce(F.size(r["of"]), F.lit(0)) < F.when(r["operation"] == "union", 1).otherwise(2)))["operation"]
    dangling = first(F.flatten(F.transform(regions, lambda r: F.array_except(r["of"], ids))))
    measure = first(F.filter(regions, lambda r: ~F.coalesce(r["measure"], F.lit("area")).isin("area", "length")))["measure"]
    said = lambda label, x: F.concat(F.lit(label), x)
    return (
        F.when(unknown.isNotNull(), said("unknown kind ", F.coalesce(unknown["kind"], F.lit("null"))))
        .when(curved.isNotNull(), said("can't build kind ", curved))
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "two shapes have one id")
        .when(few.isNotNull(), said("fewer than three points in ", few))
        .when(crossed.isNotNull(), said("not a simple polygon: ", crossed))
        .when(flat.isNotNull(), said("radius must be positive: ", flat))
        .when(F.size(regions) == 0, "no region to measure")
        .when(operation.isNotNull(), said("unknown operation ", F.coalesce(operation["operation"], F.lit("null"))))
        .when(dangling.isNotNull(), said("no shape is named ", dangling))
        .when(operands.isNotNull(), said("too few shapes for ", operands))
        .when(measure.isNotNull(), said("unknown measure ", measure))
    )


def _area(shape: Column) -> Column:
    return F.when(shape["kind"] == "circle", G.circle_area(shape["radius"])).otherwise(G.shoelace(shape["points"]))


def _holds(outer: Column, inner: Column) -> Column:
    """Whether a convex, counter-clockwise polygon holds another shape whole, up to rounding."""
    size = G.shoelace(outer["points"]) * _NEAR
    clear = lambda e: G.cross(e["a"], e["b"], inner["center"]) >= inner["radius"] * F.hypot(e["b"][0] - e["a"][0], e["b"][1] - e["a"][1]) - size
    ring = F.forall(G.edges(outer["points"]), clear)
    return (outer["kind"] == "polygon") & G.is_convex(outer["points"]) & (G.twice_signed_area(outer["points"]) > 0) & F.when(inner["kind"] == "circle", ring).otherwise(G.contains_all(outer["points"], inner["points"], size))


def regions_of(spec: Column) -> Column:
    """Each region with its shapes in the place of their ids."""
    shape = lambda i: F.get(F.filter(spec, lambda s: s["kind"].isin(*SHAPES) & (s["id"] == i)), F.lit(0))
    return F.transform(of_kind(spec, "region"), lambda r: F.struct(r["operation"].alias("operation"), F.coalesce(r["measure"], F.lit("area")).alias("measure"), F.transform(r["of"], shape).alias("own")))


def plain_area(regions: Column) -> Column:
    """Sum of the regions' areas where each is one shape, or a convex polygon less a shape that it holds; null otherwise.

    That covers the figures of the families. All others are for the general measure of functions.regions.
    """

    def one(r: Column) -> Column:
        a, b = F.get(r["own"], F.lit(0)), F.get(r["own"], F.lit(1))
        single = (r["operation"] == "union") & (F.size(r["own"]) == 1)
        nested = (r["operation"] == "difference") & (F.size(r["own"]) == 2)
        pair = bound(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(_holds(p["a"], p["b"]), _area(p["a"]) - _area(p["b"])))
        return F.when(r["measure"] != "area", F.lit(None).cast("double")).when(single, _area(a)).when(nested, pair)

    return F.when(F.size(regions) > 0, F.aggregate(regions, F.lit(0.0), lambda total, r: total + one(r)))


def as_json(spec: Column) -> Column:
    """A figure as JSON text, fields without a value left out."""
    return F.to_json(spec)


def unknown_owner(spec: Column) -> Column:
    """The first label owner that no polygon of the figure is named by; null where all are, or are null."""
    polygons = F.transform(of_kind(spec, "polygon"), lambda s: s["id"])
    owners = F.transform(F.filter(of_kind(spec, "length_label"), lambda s: s["owner"].isNotNull()), lambda s: s["owner"])
    return F.get(F.array_except(owners, polygons), F.lit(0))
