"""Figures as deterministic SVG text: a square window, the outline with its hole, and labels outside their edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import spec as S

MARGIN, SIZE, GAP = 1.14, 400, 0.06


def _n(x: Column) -> Column:
    """Four places; minus zero is zero."""
    return F.format_string("%.4f", F.round(x, 4) + F.lit(0.0))


def path(points: Column) -> Column:
    """A closed path; y grows upwards in figures and downwards in SVG."""
    return F.concat(F.lit("M"), F.array_join(F.transform(points, lambda p: F.concat(_n(p[0]), F.lit(" "), _n(-p[1]))), "L"), F.lit("Z"))


def window(points: Column) -> Column:
    """(x, y, half) of the square around all points, with a margin."""
    low = lambda k: F.array_min(F.transform(points, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(points, lambda p: p[k]))
    half = F.greatest(high(0) - low(0), high(1) - low(1)) / 2 * MARGIN
    return F.struct(((low(0) + high(0)) / 2).alias("x"), ((low(1) + high(1)) / 2).alias("y"), half.alias("half"))


def label_places(points: Column, gap: Column) -> Column:
    """For each edge its middle, moved outwards by a gap; corners run counter-clockwise."""

    def place(e: Column) -> Column:
        dx, dy = e["b"][0] - e["a"][0], e["b"][1] - e["a"][1]
        n = F.hypot(dx, dy)
        return F.array((e["a"][0] + e["b"][0]) / 2 + dy / n * gap, (e["a"][1] + e["b"][1]) / 2 - dx / n * gap)

    return F.transform(G.edges(points), place)


def labels(points: Column, texts: Column, drawn: Column, gap: Column) -> Column:
    places = label_places(points, gap)
    text = lambda p, i: F.when(F.get(drawn, i), F.concat(F.lit('<text x="'), _n(p[0]), F.lit('" y="'), _n(-p[1]), F.lit('">'), F.get(texts, i), F.lit("</text>"))).otherwise("")
    return F.array_join(F.transform(places, text), "")


def grid(view: Column, step: float = 1.0) -> Column:
    """Vertical and horizontal lines at whole steps inside the window."""
    low, high = view["x"] - view["half"], view["x"] + view["half"]
    at = F.transform(F.sequence(F.floor(low / step).cast("int"), F.floor(high / step).cast("int")), lambda k: k * step)
    line = lambda v: F.concat(F.lit("M"), _n(v), F.lit(" "), _n(-(view["y"] + view["half"])), F.lit("V"), _n(-(view["y"] - view["half"])))
    return F.concat(F.lit('<path class="grid" d="'), F.array_join(F.transform(at, line), ""), F.lit('"/>'))


def svg(outline: Column, hole: Column | None, texts: Column, drawn: Column, axes: bool = False) -> Column:
    """The figure: the outline shaded, its hole left out, and those labels that are drawn."""
    view = window(outline)
    box = F.concat_ws(" ", _n(view["x"] - view["half"]), _n(-(view["y"] + view["half"])), _n(view["half"] * 2), _n(view["half"] * 2))
    shape = path(outline) if hole is None else F.concat(path(outline), path(F.reverse(hole)))
    return F.concat(
        F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{SIZE}" height="{SIZE}" viewBox="'), box, F.lit('">'), grid(view) if axes else F.lit(""),
        F.lit('<path class="shaded" fill-rule="nonzero" d="'), shape, F.lit('"/>'), labels(outline, texts, drawn, view["half"] * GAP), F.lit("</svg>"),
    )


# --- figures from their column spec ---------------------------------------------------------------
#: How far a corner's label is from it, of the figure's extent.
POINT_GAP = 0.2


def _disc(center: Column, r: Column, turn: int) -> Column:
    """A circle as a closed path of two arcs; turn 1 runs against a polygon's sense, so that it is a hole in one."""
    x, y = center[0], -center[1]
    arc = lambda to: F.concat(F.lit("A"), _n(r), F.lit(" "), _n(r), F.lit(f" 0 1 {turn} "), _n(to), F.lit(" "), _n(y))
    return F.concat(F.lit("M"), _n(x - r), F.lit(" "), _n(y), arc(x + r), arc(x - r), F.lit("Z"))


def _outline(shape: Column, hole: bool = False) -> Column:
    wound = G.counter_clockwise(shape["points"])
    return F.when(shape["kind"] == "circle", _disc(shape["center"], shape["radius"], 1 if hole else 0)).otherwise(path(F.reverse(wound) if hole else wound))


def _extremes(shape: Column) -> Column:
    """Points that a shape's frame has to hold: its corners, or a circle's four extremes."""
    c, r = shape["center"], shape["radius"]
    return F.when(shape["kind"] == "circle", F.array(F.array(c[0] - r, c[1]), F.array(c[0] + r, c[1]), F.array(c[0], c[1] - r), F.array(c[0], c[1] + r))).otherwise(shape["points"])


def _half(points: Column) -> Column:
    return window(points)["half"] / MARGIN


def length_places(spec: Column, gap: Column) -> Column:
    """(x, y, text, draw) of each length label: the middle of its segment, moved away from the owner, whose corners may run either way."""
    clockwise = lambda s: F.exists(spec, lambda o: (o["kind"] == "polygon") & (o["id"] == s["owner"]) & (G.twice_signed_area(o["points"]) < 0))

    def place(s: Column) -> Column:
        a, b = s["segment"][0], s["segment"][1]
        dx, dy, side = b[0] - a[0], b[1] - a[1], F.when(clockwise(s), -1.0).otherwise(1.0)
        n = F.greatest(F.hypot(dx, dy), F.lit(1e-12))
        return F.struct(((a[0] + b[0]) / 2 + dy / n * gap * side).alias("x"), ((a[1] + b[1]) / 2 - dx / n * gap * side).alias("y"), s["text"].alias("text"), F.coalesce(s["draw"], F.lit(True)).alias("draw"))

    return F.transform(S.of_kind(spec, "length_label"), place)


def point_places(spec: Column) -> Column:
    """(px, py, x, y, text, draw) of each marked point: the point, and its label, pushed away from the middle of all polygons' corners."""
    points = S.of_kind(spec, "point_label")
    corners = F.flatten(F.transform(S.of_kind(spec, "polygon"), lambda s: s["points"]))
    corners = F.when(F.size(corners) > 0, corners).otherwise(F.transform(points, lambda p: p["point"]))
    mean = lambda c, k: F.aggregate(c, F.lit(0.0), lambda t, p: t + p[k]) / F.size(c)
    middle = G.bound(corners, lambda c: F.struct(mean(c, 0).alias("x"), mean(c, 1).alias("y")))

    def placed(m: Column) -> Column:
        away = lambda p: F.hypot(p["point"][0] - m["x"], p["point"][1] - m["y"])

        def place(p: Column, gap: Column) -> Column:
            n = away(p)
            dx, dy = F.when(n > 0, (p["point"][0] - m["x"]) / n).otherwise(0.0), F.when(n > 0, (p["point"][1] - m["y"]) / n).otherwise(1.0)
            x, y = p["point"][0], p["point"][1]
            return F.struct(x.alias("px"), y.alias("py"), (x + dx * gap).alias("x"), (y + dy * gap).alias("y"), p["text"].alias("text"), F.coalesce(p["draw"], F.lit(True)).alias("draw"))

        most = F.coalesce(F.array_max(F.transform(points, away)), F.lit(1.0))
        return G.bound(F.when(most == 0, 1.0).otherwise(most) * POINT_GAP, lambda gap: F.transform(points, lambda p: place(p, gap)))

    return G.bound(middle, placed)


def render_fault(spec: Column) -> Column:
    """The first thing that keeps a figure from being drawn, null if there is none: what can't be built, an unnamed polygon, a label of an unknown owner, a grid without a step."""
    unnamed = F.exists(spec, lambda s: (s["kind"] == "polygon") & s["id"].isNull())
    step = F.exists(spec, lambda s: (s["kind"] == "axes") & ~F.coalesce(s["step"] > 0, F.lit(False)))
    owner = S.unknown_owner(spec)
    return F.when(unnamed, "a polygon needs an id").when(step, "axes step must be positive").otherwise(F.coalesce(S.fault(spec), F.when(owner.isNotNull(), F.concat(F.lit("no polygon is named "), owner))))


def render(spec: Column) -> Column:
    """A figure of column spec as SVG text: grid and axes, shaded regions, outlines, marked points, and those labels that are drawn. The frame is a square around all of it."""
    shapes = S.of_kind(spec, *S.SHAPES)
    extremes = F.flatten(F.transform(shapes, lambda s: _extremes(s)))
    text = lambda p: F.concat(F.lit('<text x="'), _n(p["x"]), F.lit('" y="'), _n(-p["y"]), F.lit('">'), p["text"], F.lit("</text>"))
    drawn = lambda places: F.filter(places, lambda p: p["draw"] & (p["text"] != ""))

    def parts(c: Column) -> Column:
        frame = F.concat(c["extremes"], *[F.transform(drawn(c[k]), lambda p: F.array(p["x"], p["y"])) for k in ("lengths", "points")])
        return F.struct(c["spec"].alias("spec"), c["lengths"].alias("lengths"), c["points"].alias("points"), window(frame).alias("view"), F.get(F.filter(c["spec"], lambda s: (s["kind"] == "axes") & (s["step"] > 0)), F.lit(0))["step"].alias("step"), S.regions_of(c["spec"]).alias("regions"))

    def shaded(r: Column, i: Column) -> Column:
        first, rest = F.get(r["own"], F.lit(0)), F.slice(r["own"], 2, F.greatest(F.size(r["own"]) - 1, F.lit(0)))
        d = F.when(r["operation"] == "union", F.array_join(F.transform(r["own"], lambda s: _outline(s)), "")).when(r["operation"] == "intersection", _outline(first)).otherwise(F.concat(_outline(first), F.array_join(F.transform(rest, lambda s: _outline(s, True)), "")))
        clip = F.concat(F.lit('<clipPath id="c'), i.cast("string"), F.lit('"><path d="'), F.array_join(F.transform(rest, lambda s: _outline(s)), ""), F.lit('"/></clipPath>'))
        clipped = (r["operation"] == "intersection") & (F.size(rest) > 0)
        return F.concat(F.when(clipped, clip).otherwise(""), F.lit('<path class="shaded" fill-rule="nonzero"'), F.when(clipped, F.concat(F.lit(' clip-path="url(#c'), i.cast("string"), F.lit(')"'))).otherwise(""), F.lit(' d="'), d, F.lit('"/>'))

    def axes(view: Column, step: Column) -> Column:
        def lines(k: str, across: str) -> Column:
            at = F.transform(F.sequence(F.floor((view[k] - view["half"]) / step).cast("int"), F.floor((view[k] + view["half"]) / step).cast("int")), lambda i: i * step)
            low, high = view[across] - view["half"], view[across] + view["half"]
            up = lambda v: F.concat(F.lit("M"), _n(v), F.lit(" "), _n(-high), F.lit("V"), _n(-low))
            flat = lambda v: F.concat(F.lit("M"), _n(low), F.lit(" "), _n(-v), F.lit("H"), _n(high))
            return F.array_join(F.transform(at, up if k == "x" else flat), "")

        cross = F.concat(F.lit("M"), _n(view["x"] - view["half"]), F.lit(" 0.0000H"), _n(view["x"] + view["half"]), F.lit("M0.0000 "), _n(-(view["y"] + view["half"])), F.lit("V"), _n(-(view["y"] - view["half"])))
        return F.concat(F.lit('<path class="grid" d="'), lines("x", "y"), lines("y", "x"), F.lit('"/><path class="axes" d="'), cross, F.lit('"/>'))

    def drawing(c: Column) -> Column:
        view = c["view"]
        box = F.concat_ws(" ", _n(view["x"] - view["half"]), _n(-(view["y"] + view["half"])), _n(view["half"] * 2), _n(view["half"] * 2))
        outlines = F.array_join(F.transform(S.of_kind(c["spec"], *S.SHAPES), lambda s: F.concat(F.lit('<path class="outline" d="'), _outline(s), F.lit('"/>'))), "")
        dots = F.array_join(F.transform(c["points"], lambda p: F.concat(F.lit('<circle class="dot" cx="'), _n(p["px"]), F.lit('" cy="'), _n(-p["py"]), F.lit('"/>'))), "")
        texts = F.array_join(F.transform(F.concat(drawn(c["lengths"]), F.transform(drawn(c["points"]), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["text"].alias("text"), p["draw"].alias("draw")))), text), "")
        return F.concat(
            F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{SIZE}" height="{SIZE}" viewBox="'), box, F.lit('">'), F.when(c["step"].isNotNull(), axes(view, c["step"])).otherwise(""),
            F.array_join(F.transform(c["regions"], shaded), ""), outlines, dots, texts, F.lit("</svg>"),
        )

    placed = lambda c: F.struct(c["spec"].alias("spec"), c["extremes"].alias("extremes"), length_places(c["spec"], c["half"] * GAP).alias("lengths"), point_places(c["spec"]).alias("points"))
    sized = F.struct(spec.alias("spec"), extremes.alias("extremes"), _half(extremes).alias("half"))
    return G.bound(G.bound(G.bound(sized, placed), parts), drawing)


def rendered_or_fail(spec: Column) -> Column:
    """The figure; one that can't be drawn ends the query with the reason."""
    fault = render_fault(spec)
    return F.when(fault.isNull(), render(spec)).otherwise(F.raise_error(F.coalesce(fault, F.lit(""))).cast("string"))


def contact_sheet(images: Column, columns: int = 6) -> Column:
    """Several figures, an array of SVG texts, as one: a grid of them in their order."""
    at = lambda i: F.concat(F.lit('<svg x="'), (i % columns * SIZE).cast("string"), F.lit('" y="'), (F.floor(i / columns) * SIZE).cast("string"), F.lit('" '))
    inner = F.transform(images, lambda s, i: F.concat(at(i), F.regexp_replace(s, r'^<svg xmlns="[^"]*" ', "")))
    rows = F.ceil(F.size(images) / columns)
    return F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{columns * SIZE}" height="'), (rows * SIZE).cast("string"), F.lit('">'), F.array_join(inner, ""), F.lit("</svg>"))
