"""Measures of boolean regions (union, intersection, difference) of polygons and circles, without a geometry library.

Edges are cut where they cross; a piece bounds the region if it has the region on one side only. Such pieces' cross products
sum up to the area, and their lengths to the length of the boundary. Edges that may cross are found by halving the plane
until few are left in a box. Sides are told by crossing numbers, of which a polygon's intervals of height keep the edges in
order: an edge is kept at the few nodes of a tree of intervals that it spans throughout, and within a node edges of a
simple polygon don't cross. So a figure of n edges takes n log n steps and a few more for each crossing, all by arrays.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.geometry import CIRCLE_CORNERS


class RegionError(ValueError):
    """A figure that can't be built."""


#: Edges of a box that are compared with each other.
LEAF = 48
#: Pairs that are looked at together.
AT_ONCE = 1 << 20
#: Points closer than this share of the figure's extent are one.
NEAR = 1e-12


def _edges(p: np.ndarray) -> np.ndarray:
    """(edges x ends x coordinates) of a closed outline."""
    return np.stack([p, np.roll(p, -1, 0)], 1)


def _near_pairs(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of edges whose boxes meet, but for rounding, each once."""
    slack = NEAR * float(np.ptp(e.reshape(-1, 2), axis=0).max(initial=0))
    low, high = e.min(1) - slack, e.max(1) + slack
    found, todo = [], [(np.arange(len(e)), 0)]
    while todo:
        own, stuck = todo.pop()
        if len(own) > LEAF and stuck < 2:
            box = high[own].max(0) - low[own].min(0)
            axis = int(box[1] > box[0]) ^ stuck
            middle = np.median((low[own, axis] + high[own, axis]) / 2)
            sides = own[low[own, axis] <= middle], own[high[own, axis] >= middle]
            if max(map(len, sides)) < 0.9 * len(own):
                todo += [(s, 0) for s in sides]
            else:
                todo.append((own, stuck + 1))  # along the other axis; edges that all lie across both are compared
            continue
        for a in range(0, len(own), max(1, AT_ONCE // max(1, len(own)))):
            i, j = np.meshgrid(own[a : a + max(1, AT_ONCE // len(own))], own, indexing="ij")
            i, j = i.ravel(), j.ravel()
            meet = (i < j) & (low[i] <= high[j]).all(1) & (low[j] <= high[i]).all(1)
            found.append(i[meet] * len(e) + j[meet])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // max(1, len(e)), pairs % max(1, len(e))


def _cuts(e: np.ndarray, i: np.ndarray, j: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, place on it from 0 to 1, number of the pair) of all points where the edges of pairs meet; of an overlap its ends."""
    p, q = e[i, 0], e[j, 0]
    d, f, o = e[i, 1] - p, e[j, 1] - q, q - p
    cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    den, dd, ff = cross(d, f), (d * d).sum(1), (f * f).sum(1)
    slack = NEAR * scale
    along = np.abs(den) <= 1e-13 * np.sqrt(dd * ff)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(o, f) / den, cross(o, d) / den
        st, su = slack / np.sqrt(dd), slack / np.sqrt(ff)
    hit = np.flatnonzero(~along & (t >= -st) & (t <= 1 + st) & (u >= -su) & (u <= 1 + su))
    out = [(i[hit], t[hit], hit), (j[hit], u[hit], hit)]
    one = np.flatnonzero(along & (np.abs(cross(o, d)) <= slack * np.sqrt(dd)))
    for own, other in ((i, j), (j, i)):
        start, way = e[own[one], 0], e[own[one], 1] - e[own[one], 0]
        for end in (0, 1):
            at = ((e[other[one], end] - start) * way).sum(1) / (way * way).sum(1)
            on = (at >= -NEAR) & (at <= 1 + NEAR)
            out.append((own[one][on], at[on], one[on]))
    edge, at, pair = (np.concatenate(x) for x in zip(*out, strict=True))
    return edge, np.clip(at, 0, 1), pair


def _meets_itself(p: np.ndarray) -> bool:
    """Whether edges of an outline meet other than neighbours in their corner."""
    n, e = len(p), _edges(p)
    if (np.abs(e[:, 1] - e[:, 0]).max(1) == 0).any():
        return True
    i, j = _near_pairs(e)
    edge, at, pair = _cuts(e, i, j, np.ptp(p, axis=0).max())
    beside = (j - i == 1) | (i + n - j == 1)
    if not beside[pair].all():
        return True
    # neighbours: at the end of one and the start of the other only
    first = np.where(j - i == 1, i, j)[pair]
    return bool((np.where(edge == first, 1 - at, at) > 1e-9).any()) and n > 3 or n == 3 and abs(_signed(p)) < 1e-15


def _signed(p: np.ndarray) -> float:
    """Twice the area, positive if the outline runs counterclockwise."""
    q = np.roll(p - p[0], -1, 0)
    return float(((p - p[0])[:, 0] * q[:, 1] - q[:, 0] * (p - p[0])[:, 1]).sum())


class Inside:
    """Membership of many points in one simple polygon."""

    def __init__(self, p: np.ndarray):
        e = _edges(p)
        e = e[e[:, 0, 1] != e[:, 1, 1]]
        up = e[:, 0, 1] < e[:, 1, 1]
        low, high = np.where(up[:, None], e[:, 0], e[:, 1]), np.where(up[:, None], e[:, 1], e[:, 0])
        self.ys = np.unique(p[:, 1])
        self.depth = max(1, (len(self.ys) - 1 - 1).bit_length()) if len(self.ys) > 2 else 0
        a, b = np.searchsorted(self.ys, low[:, 1]), np.searchsorted(self.ys, high[:, 1])
        # the nodes that an edge spans throughout: at each level at most one on each side
        size = 1 << self.depth
        left, right, own = a + size, b + size, np.arange(len(e))
        node, edge = [], []
        for _ in range(self.depth + 1):
            live = left < right
            for side, step in ((live & (left & 1 == 1), 0), (live & (right & 1 == 1), -1)):
                node.append((left if step == 0 else right)[side] + step)
                edge.append(own[side])
            left, right = (left + 1) >> 1, right >> 1
        node, edge = np.concatenate(node), np.concatenate(edge)
        level = self.depth - np.floor(np.log2(np.maximum(node, 1))).astype(np.int64)
        first = (node << level) - size  # the node's heights
        last = first + (1 << level)
        top = len(self.ys) - 1
        y = (self.ys[np.minimum(first, top)] + self.ys[np.minimum(last, top)]) / 2
        slope = (high[:, 0] - low[:, 0]) / (high[:, 1] - low[:, 1])
        x = low[edge, 0] + slope[edge] * (y - low[edge, 1])
        order = np.lexsort((x, node))
        self.node, self.x0, self.y0, self.slope = node[order], low[edge[order], 0], low[edge[order], 1], slope[edge[order]]
        self.size = size

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether points are inside; a point at a corner's height counts as above it."""
        slab = np.searchsorted(self.ys, y, side="right") - 1
        count = np.zeros(len(x), np.int64)
        within = np.flatnonzero((slab >= 0) & (slab < len(self.ys) - 1))
        at, px, py = slab[within] + self.size, x[within], y[within]
        for _ in range(self.depth + 1):
            low, high = np.searchsorted(self.node, at, "left"), np.searchsorted(self.node, at, "right")
            begin = low
            while (more := low < high).any():  # the first edge that isn't left of the point
                middle = (low + high) // 2
                k = np.minimum(middle, len(self.node) - 1)
                left = self.x0[k] + self.slope[k] * (py - self.y0[k]) < px
                low, high = np.where(more & left, middle + 1, low), np.where(more & ~left, middle, high)
            count[within] += low - begin
            at = at >> 1
        return count % 2 == 1


def build(spec: list[dict]) -> tuple[dict[str, np.ndarray], list[dict]]:
    """(corners by shape id, regions), checked: unique ids, simple shapes, known operations, declared operands."""
    shapes: dict[str, np.ndarray] = {}
    for part in spec:
        kind = part.get("kind")
        if kind in ("arc", "sector"):
            raise RegionError(f"{kind} can't be built")
        if kind not in ("polygon", "circle"):
            continue
        if part.get("id") is None or part["id"] in shapes:
            raise RegionError(f"shape id {part.get('id')!r} is missing or repeated")
        if kind == "circle":
            if not part["radius"] > 0:
                raise RegionError("a radius must be positive")
            a = np.arange(CIRCLE_CORNERS) * 2 * np.pi / CIRCLE_CORNERS
            shapes[part["id"]] = np.array(part["center"], float) + part["radius"] * np.stack([np.cos(a), np.sin(a)], 1)
            continue
        p = np.array(part["points"], float)
        if p.ndim != 2 or len(p) < 3:
            raise RegionError("a polygon needs three points")
        if not np.isfinite(p).all():
            raise RegionError(f"polygon {part['id']!r} isn't finite")
        if (p[0] == p[-1]).all() and len(p) > 3:
            p = p[:-1]  # closed by its first corner
        if _meets_itself(p):
            raise RegionError(f"polygon {part['id']!r} meets itself")
        if abs(_signed(p)) < 1e-15:
            raise RegionError(f"polygon {part['id']!r} has no area")
        shapes[part["id"]] = p
    regions = [part for part in spec if part.get("kind") == "region"]
    if not regions:
        raise RegionError("no region to measure")
    for r in regions:
        if r.get("operation") not in ("difference", "union", "intersection"):
            raise RegionError(f"unknown operation {r.get('operation')!r}")
        if missing := [i for i in r["of"] if i not in shapes]:
            raise RegionError(f"undeclared shapes {missing}")
        if len(r["of"]) < (1 if r["operation"] == "union" else 2):
            raise RegionError("too few operands")
        if r.get("measure", "area") not in ("area", "length"):
            raise RegionError(f"unknown measure {r['measure']!r}")
    return shapes, regions


def _member(operation: str, inside: np.ndarray) -> np.ndarray:
    """inside: (shapes x points) membership."""
    if operation == "union":
        return inside.any(0)
    return inside.all(0) if operation == "intersection" else inside[0] & ~inside[1:].any(0)


def boundary(operation: str, shapes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(pieces x ends x coordinates, side) of a region's boundary; side: 1 where the region is on the left of a piece, else -1."""
    every = np.concatenate(shapes)
    origin, scale = every.mean(0), max(float(np.ptp(every, axis=0).max()), 1e-300)
    shapes = [p - origin for p in shapes]
    e = np.concatenate([_edges(p) for p in shapes])
    e = e[np.abs(e[:, 1] - e[:, 0]).max(1) > 0]
    edge, at = (np.zeros(0, np.int64), np.zeros(0)) if len(shapes) == 1 else _cuts(e, *_near_pairs(e), scale)[:2]
    every = np.arange(len(e))
    edge, at = np.concatenate([every, every, edge]), np.concatenate([np.zeros(len(e)), np.ones(len(e)), at])
    order = np.lexsort((at, edge))
    edge, at = edge[order], at[order]
    way = e[:, 1] - e[:, 0]
    long = np.sqrt((way * way).sum(1))
    piece = np.flatnonzero((edge[1:] == edge[:-1]) & ((at[1:] - at[:-1]) * long[edge[1:]] > NEAR * scale))
    own = edge[piece]
    ends = np.stack([e[own, 0] + at[piece, None] * way[own], e[own, 0] + at[piece + 1, None] * way[own]], 1)
    middle, unit = ends.mean(1), way[own] / long[own, None]
    # a piece that outlines share counts once
    _, once = np.unique(np.round(np.concatenate([middle, np.abs(ends[:, 1] - ends[:, 0])], 1) / (scale * 1e-9)), axis=0, return_index=True)
    ends, middle, unit = ends[once], middle[once], unit[once]
    normal = np.stack([-unit[:, 1], unit[:, 0]], 1) * scale * 1e-9
    tests = [Inside(p) for p in shapes]
    left, right = (_member(operation, np.stack([t(*(middle + k * normal).T) for t in tests])) for k in (1, -1))
    bounds = left != right
    return ends[bounds] + origin, np.where(left[bounds], 1, -1)


def region_area(operation: str, shapes: list[np.ndarray]) -> float:
    ends, side = boundary(operation, shapes)
    if not len(ends):
        return 0.0
    p = ends - ends.reshape(-1, 2).mean(0)
    return float((side * (p[:, 0, 0] * p[:, 1, 1] - p[:, 1, 0] * p[:, 0, 1])).sum() / 2)


def region_length(operation: str, shapes: list[np.ndarray]) -> float:
    ends, _ = boundary(operation, shapes)
    return float(np.hypot(*(ends[:, 1] - ends[:, 0]).T).sum())


def measure_spec(text: str) -> float:
    """The sum of a figure's regions, each by its own measure."""
    shapes, regions = build(json.loads(text))
    return sum((region_length if r.get("measure", "area") == "length" else region_area)(r["operation"], [shapes[i] for i in r["of"]]) for r in regions)


@F.pandas_udf(T.StructType([T.StructField("measured", T.DoubleType()), T.StructField("error", T.StringType())]))
def measured_spec(specs: pd.Series) -> pd.DataFrame:
    known: dict = {None: (None, None)}  # figures repeat
    for s in specs:
        if s in known:
            continue
        try:
            known[s] = (measure_spec(s), None)
        except (RegionError, KeyError, TypeError, ValueError) as e:
            known[s] = (None, f"{e}")
    return pd.DataFrame([known[s] for s in specs], columns=["measured", "error"])
