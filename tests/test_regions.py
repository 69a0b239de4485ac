"""Regions against sampling, closed forms and plain loops."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import regions as R

OPERATIONS = ("union", "intersection", "difference")


def square(x, y, side):
    return np.array([[x, y], [x + side, y], [x + side, y + side], [x, y + side]], float)


def circle(x, y, r, n=4096):
    a = np.arange(n) * 2 * np.pi / n
    return np.array([x, y]) + r * np.stack([np.cos(a), np.sin(a)], 1)


def star(rng, n):
    a = np.sort(rng.random(n)) * 2 * np.pi
    return rng.normal(size=2) * 0.5 + rng.uniform(0.3, 1.5, n)[:, None] * np.stack([np.cos(a), np.sin(a)], 1)


def inside(p, x, y):
    q = np.roll(p, -1, 0)
    spans = (p[:, 1, None] > y) != (q[:, 1, None] > y)
    with np.errstate(all="ignore"):
        at = (q[:, 0] - p[:, 0])[:, None] * (y - p[:, 1, None]) / (q[:, 1] - p[:, 1])[:, None] + p[:, 0, None]
    return (spans & (x < at)).sum(0) % 2 == 1


def simple(p):
    def side(a, b, c):
        return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    n = len(p)
    e = [(p[i], p[(i + 1) % n]) for i in range(n)]
    return not any(side(*e[i], e[j][0]) != side(*e[i], e[j][1]) and side(*e[j], e[i][0]) != side(*e[j], e[i][1]) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1))


@pytest.mark.parametrize("seed", range(8))
def test_random_stars(seed):
    rng = np.random.default_rng(seed)
    shapes = [star(rng, int(rng.integers(3, 70))) for _ in range(int(rng.integers(2, 5)))]
    assert [not R._meets_itself(p) for p in shapes] == [simple(p) for p in shapes]
    shapes = [p for p in shapes if simple(p)]
    points = rng.uniform(-4, 4, (100_000, 2))
    held = np.stack([inside(p, *points.T) for p in shapes])
    for p, h in zip(shapes, held, strict=True):
        assert (R.Inside(p)(*points.T) == h).all()
    for operation in OPERATIONS:
        share = R._member(operation, held).mean()
        assert R.region_area(operation, shapes) == pytest.approx(share * 64, abs=64 * 5 * math.sqrt(share * (1 - share) / 1e5) + 1e-6)
    if len(shapes) > 1:
        a, b = shapes[:2]
        area, length = ({o: f(o, [a, b]) for o in OPERATIONS} for f in (R.region_area, R.region_length))
        whole = R.region_area("union", [a])
        assert area["union"] + area["intersection"] == pytest.approx(whole + R.region_area("union", [b]))
        assert area["difference"] == pytest.approx(whole - area["intersection"])
        assert length["union"] + length["intersection"] == pytest.approx(R.region_length("union", [a]) + R.region_length("union", [b]))


def test_shared_edges_and_corners():
    a, b = square(0, 0, 2), square(2, 0, 2)
    assert (R.region_area("union", [a, b]), R.region_length("union", [a, b])) == (8, 12)
    assert (R.region_area("intersection", [a, b]), R.region_length("intersection", [a, b])) == (0, 0)
    assert (R.region_area("difference", [a, a]), R.region_area("union", [a, a]), R.region_length("intersection", [a, a[::-1]])) == (0, 4, 8)
    assert R.region_area("difference", [a, square(0, 0, 1), square(1, 1, 1)]) == 2
    assert R.region_length("difference", [a, square(0, 0, 1)]) == 8
    corner = square(2, 2, 1)
    assert (R.region_area("union", [a, corner]), R.region_length("union", [a, corner])) == (5, 12)
    big = square(1e9, 1e9, 4)
    assert R.region_area("difference", [big, square(1e9 + 1, 1e9 + 1, 1)]) == pytest.approx(15)


def test_circles_take_milliseconds():
    began = time.time()
    assert R.region_length("union", [circle(0, 0, 1)]) == pytest.approx(4096 * 2 * math.sin(math.pi / 4096))
    assert time.time() - began < 0.5
    began = time.time()
    d, r, s = 3.0, 5.0, 4.0
    lens = r * r * math.acos((d * d + r * r - s * s) / (2 * d * r)) + s * s * math.acos((d * d + s * s - r * r) / (2 * d * s)) - math.sqrt((-d + r + s) * (d + r - s) * (d - r + s) * (d + r + s)) / 2
    assert R.region_area("intersection", [circle(0, 0, r), circle(d, 0, s)]) == pytest.approx(lens, rel=1e-5)
    assert time.time() - began < 5


@pytest.mark.parametrize("k", [3, 4, 5, 6, 7, 8])
def test_circles_that_touch_every_edge(k):
    for side in range(1, 21):
        r, t = side / (2 * math.sin(math.pi / k)), math.pi / k - math.pi / 2 + np.arange(k) * 2 * np.pi / k
        q = side / (2 * math.tan(math.pi / k))
        shapes = [np.stack([r * np.cos(t), r * np.sin(t)], 1), circle(0, 0, q)]
        round_ = 4096 * 2 * q * math.sin(math.pi / 4096)
        assert R.region_length("difference", shapes) == pytest.approx(k * side + round_, rel=1e-9)
        assert R.region_area("difference", shapes) == pytest.approx(k * side * q / 2 - 2048 * q * q * math.sin(2 * math.pi / 4096), rel=1e-9)


def test_a_comb_of_many_teeth():
    n = 10_000
    x = np.arange(2 * n) / 2
    comb = np.concatenate([np.stack([x, np.where(np.arange(2 * n) % 2 == 0, 0.0, 100.0)], 1), [[n, -1], [0, -1]]])
    began = time.time()
    assert not R._meets_itself(comb)
    y = np.roll(comb, -1, 0)
    area = abs((comb[:, 0] * y[:, 1] - y[:, 0] * comb[:, 1]).sum()) / 2
    assert R.region_area("union", [comb]) == pytest.approx(area)
    assert R.region_area("intersection", [comb, square(-5, -5, n + 50.0)]) == pytest.approx(area)
    assert time.time() - began < 30


@pytest.mark.parametrize(("points", "bad"), [([[0, 0], [2, 2], [2, 0], [0, 2]], True), ([[0, 0], [4, 0], [2, 0], [2, 2]], True), ([[0, 0], [1, 0], [1, 1], [0, 1]], False), ([[0, 0], [4, 0], [4, 4], [2, 0], [0, 4]], True), ([[0, 0], [1, 1], [2, 2]], True), ([[0, 0], [2, 0], [4, 0], [4, 4]], False), ([[0, 0], [0, 0], [4, 0], [4, 4]], True)])
def test_simple_outlines(points, bad):
    assert R._meets_itself(np.array(points, float)) == bad


def test_figures_in_a_table(spark):
    part = lambda name, p: {"kind": "polygon", "id": name, "points": p.tolist()}
    figure = [part("a", square(0, 0, 4)), part("b", square(1, 1, 1)), {"kind": "circle", "id": "c", "center": [10, 0], "radius": 1}]
    region = lambda operation, *of, **more: {"kind": "region", "operation": operation, "of": list(of)} | more
    specs = {
        "sum": [*figure, region("difference", "a", "b"), region("union", "c", measure="length")], "open": [*figure, region("difference", "a")], "volume": [*figure, region("union", "a", measure="volume")],
        "nan": [part("a", np.array([[0, 0], [1, float("nan")], [1, 1.0]])), region("union", "a")], "closed": [part("a", np.concatenate([square(0, 0, 2), [[0, 0]]])), region("union", "a")],
    }
    rows = [(k, json.dumps(v)) for k, v in specs.items()] * 2 + [("null", None)]
    got = {r.name: r.m for r in spark.createDataFrame(rows, "name string, spec string").select("name", R.measured_spec("spec").alias("m")).collect()}
    assert got["sum"].measured == pytest.approx(15 + 2 * math.pi, rel=1e-6) and got["closed"].measured == 4
    assert all(got[k].measured is None and got[k].error for k in ("open", "volume", "nan"))
    assert got["null"].measured is None
    assert F.lit(1) is not None
