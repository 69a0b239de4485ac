"""Plane geometry as Column expressions over arrays of points (each an array of two numbers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it: lambdas compute what they name each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def area_regular(k: Column, side: Column) -> Column:
    """Area of a regular k-gon."""
    return k / 4 * side * side * F.cot(F.pi() / k)


def apothem(k: Column, side: Column) -> Column:
    return side / (F.tan(F.pi() / k) * 2)


def circumradius(k: Column, side: Column) -> Column:
    return side / (F.sin(F.pi() / k) * 2)


def regular_vertices(k: Column, side: Column) -> Column:
    """Corners counter-clockwise around the origin, the first edge flat at the bottom."""
    of = F.struct(circumradius(k, side).alias("r"), (F.pi() / k - F.pi() / 2).alias("start"), k.alias("k"))
    corner = lambda c, t: F.array(c["r"] * F.cos(t), c["r"] * F.sin(t))
    return bound(of, lambda c: F.transform(F.sequence(F.lit(0), c["k"].cast("int") - 1), lambda i: corner(c, c["start"] + i * 2 * F.pi() / c["k"])))


def _next(points: Column, i: Column, by: int = 1) -> Column:
    return F.get(points, (i + by) % F.size(points))


def edges(points: Column) -> Column:
    """Each corner with the next one, around."""
    return bound(points, lambda own: F.transform(own, lambda p, i: F.struct(p.alias("a"), _next(own, i).alias("b"))))


def twice_signed_area(points: Column) -> Column:
    return F.aggregate(F.transform(edges(points), lambda e: e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1]), F.lit(0).cast("double"), lambda a, x: a + x)


def shoelace(points: Column) -> Column:
    return F.abs(twice_signed_area(points)) / 2


def counter_clockwise(points: Column) -> Column:
    return F.when(twice_signed_area(points) > 0, points).otherwise(F.reverse(points))


def cross(o: Column, a: Column, b: Column) -> Column:
    """Turn from oa to ob: above 0 to the left."""
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def contains_all(outer: Column, inner: Column, tolerance: Column) -> Column:
    """Whether all inner points are left of or on each edge of the outer, counter-clockwise convex polygon."""
    both = F.struct(edges(outer).alias("edges"), inner.alias("points"), tolerance.alias("most"))
    return bound(both, lambda x: ~F.exists(x["edges"], lambda e: F.exists(x["points"], lambda p: cross(e["a"], e["b"], p) < -x["most"])))


def turns(points: Column) -> Column:
    return bound(points, lambda own: F.transform(own, lambda p, i: cross(p, _next(own, i), _next(own, i, 2))))


def is_convex(points: Column) -> Column:
    """All turns to one side, none straight."""
    return bound(turns(points), lambda t: F.forall(t, lambda x: x > 0) | F.forall(t, lambda x: x < 0))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether closed segments ab and cd share a point; exact on integers."""

    def within(p: Column, q: Column, r: Column) -> Column:
        return (cross(p, r, q) == 0) & q[0].between(F.least(p[0], r[0]), F.greatest(p[0], r[0])) & q[1].between(F.least(p[1], r[1]), F.greatest(p[1], r[1]))

    apart = (F.signum(cross(a, b, c)) != F.signum(cross(a, b, d))) & (F.signum(cross(c, d, a)) != F.signum(cross(c, d, b)))
    return apart | within(a, c, b) | within(a, d, b) | within(c, a, d) | within(c, b, d)


def is_simple(points: Column) -> Column:
    """A closed outline with an area, no edge doubling back, and no two edges meeting that aren't neighbours."""

    def simple(own: Column) -> Column:
        n = F.size(own)

        def doubles_back(i: Column) -> Column:
            p, q, r = F.get(own, i), _next(own, i), _next(own, i, 2)
            return (cross(p, q, r) == 0) & ((q[0] - p[0]) * (r[0] - q[0]) + (q[1] - p[1]) * (r[1] - q[1]) < 0)

        def meets_later(i: Column) -> Column:
            later = F.when(i + 2 < n, F.sequence(i + 2, n - 1)).otherwise(F.array().cast("array<int>"))
            return F.exists(later, lambda j: ~((i == 0) & (j == n - 1)) & segments_meet(F.get(own, i), _next(own, i), F.get(own, j), _next(own, j)))

        places = F.sequence(F.lit(0), n - 1)
        return (twice_signed_area(own) != 0) & ~F.exists(places, doubles_back) & ~F.exists(places, meets_later)

    return bound(points, simple)


#: A circle is measured as the polygon of so many corners on it.
CIRCLE_CORNERS = 4096


def circle_area(radius: Column) -> Column:
    return radius * radius * (CIRCLE_CORNERS / 2) * F.sin(F.lit(2.0) * F.pi() / CIRCLE_CORNERS)
