"""Operators 12 and 13 against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import vector_codes as codes
from tessera.llm.vector_codes import assign, build, edges_of, levels_of, vector_codes
from tessera.llm.vector_links import sign_keys, planes, tables_for, vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, node string, code int, kept int, ball int"
EXTRA = ("a", 1, "b", 2, 3, 4)


def near(points, book):
    return ((points[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)


def lloyd(vectors, parts=4, rounds=4, entries=256):
    """(codes, errors, digest) of integer vectors in the order of their ids."""
    w = vectors.shape[1] // parts
    cut = [vectors[:, k * w : (k + 1) * w] for k in range(parts)]
    books = [p[:entries].copy() for p in cut]
    for _ in range(rounds):
        for p, b in zip(cut, books, strict=True):
            own = np.array([int(np.argmin(r)) for r in near(p, b)])
            for j in range(len(b)):
                if (own == j).any():
                    b[j] = [int(s) // int((own == j).sum()) for s in p[own == j].sum(0)]
    far = [near(p, b) for p, b in zip(cut, books, strict=True)]
    text = ["".join("%02x" % int(np.argmin(f[i])) for f in far) for i in range(len(vectors))]
    return text, [int(sum(f[i].min() for f in far)) for i in range(len(vectors))], hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


@pytest.mark.parametrize(("n", "width", "spread"), [(1, 3, 5), (32, 1, 2), (33, 4, 1), (700, 5, 3), (900, 2, 1000), (257, 8, 0)])
def test_trees_assign_as_brute_force(n, width, spread):
    rng = np.random.default_rng(n)
    points = rng.integers(-spread, spread + 1, (n, width))
    book = np.concatenate([points[: min(n, 40)], rng.integers(-2 * spread, 2 * spread + 1, (9, width)), points[:3]])
    order, low, high, sums = build(points)
    assert sorted(order) == list(range(n))
    found, whole, places = np.full(n, -1), 0, points[order]
    for level, where, entries in assign(places, low, high, book):
        if level is None:
            found[where[0] : where[1]] = entries
            continue
        edge = edges_of(n, level)
        for node, e in zip(where, entries, strict=True):
            a, b = edge[node], edge[node + 1]
            whole += 1
            assert (sums[(1 << level) - 1 + node] == places[a:b].sum(0)).all()
            found[a:b] = e
    assert (found == np.argmin(near(places, book).astype(np.int64), axis=1)).all()
    assert whole or spread  # where all points are equal, the root goes whole
    assert levels_of(n) <= 1 + math.ceil(math.log2(max(2, n)))


def test_large_numbers_stay_exact():
    points = np.array([[1 << 23, -(1 << 23)], [(1 << 23) - 1, 1 << 23], [5, 7]] * 20)
    order, low, high, _ = build(points)
    found = np.full(60, -1)
    book = np.array([[0, 0], [1 << 23, (1 << 23) - 1], [1 << 23, -(1 << 23)]])
    for level, where, entries in assign(points[order], low, high, book):
        if level is None:
            found[where[0] : where[1]] = entries
        else:
            for node, e in zip(where, entries, strict=True):
                found[edges_of(60, level)[node] : edges_of(60, level)[node + 1]] = e
    assert (found == np.argmin(near(points[order], book).astype(np.int64), axis=1)).all()


@pytest.mark.parametrize(("n", "block"), [(700, 1 << 20), (700, 1 << 11), (40, 1 << 20)])
def test_codes(spark, n, block):
    rng = np.random.default_rng(n)
    vectors = np.concatenate([rng.normal(0, 0.2, (n - 20, 8)), np.repeat(rng.normal(0, 0.2, (2, 8)), 10, axis=0)]).astype(np.float32)
    ids = rng.permutation(n) - 9
    labels = [None if i % 7 == 0 else int(i % 3) for i in range(n)]
    bad = [None, [None] + [0.0] * 7, [float("nan")] + [0.0] * 7, [0.0] * 7 + [float("inf")]]
    rows = [(int(i), v.tolist(), x, *EXTRA) for i, v, x in zip(ids, vectors, labels, strict=True)] + [(-1000 - k, v, 1, *EXTRA) for k, v in enumerate(bad)]
    got = {r.vec_id: r for r in vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()}
    order = np.argsort(ids)
    want, errors, digest = lloyd(np.floor(vectors[order].astype(float) * 1024).astype(np.int64))
    by = Counter()
    for i, e in zip(order, errors, strict=True):
        by[labels[i]] += e
    assert {i: (r.code, r.error, r.label_error, r.codebooks_sha256) for i, r in got.items()} == {int(ids[i]): (c, e, by[labels[i]], digest) for i, c, e in zip(order, want, errors, strict=True)}


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes(empty).count() == 0
    rows = [(None, [1.0, 2.0, 3.0, 4.0], None, *EXTRA), (3, [1.0, 2.0, 3.0, 4.0], 1, *EXTRA), (3, [0.5, 2.0, 3.0, 4.0], 1, *EXTRA), (3, [0.5, 2.0, 3.0, 4.0], 1, *EXTRA)]
    got = vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.code, r.error) for r in got) == [(False, "00000000", 0), (False, "00000000", 0), (False, "02000000", 0), (True, "02000000", 0)]
    none = vector_codes(spark.createDataFrame([(1, [], None, *EXTRA), (2, [], 1, *EXTRA)], SCHEMA)).collect()
    assert [(r.code, r.error) for r in none] == [("00000000", 0)] * 2
    for v, said in (([1.0] * 6, "equal parts"), ([20000.0] * 4, "scale"), ([1.0] * 8, "lengths")):
        with pytest.raises(Exception, match=said):
            vector_codes(spark.createDataFrame([(1, [0.0] * (6 if len(v) == 6 else 4), 0, *EXTRA), (2, v, 0, *EXTRA)], SCHEMA)).collect()


def brute_links(rows, cosine=0.9):
    """[(n_links, component)] of (id, vector) rows."""
    live = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for (_, v), ok in zip(rows, live, strict=True)]
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if live[i] and live[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[root(i)].append(x)
    return [(links[i], min(least[root(i)], default=None)) for i in range(n)]


def make(seed, n, dim, noise):
    """Groups of noisy copies, chains of small steps, exact copies, and singles."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        kind, x = rng.integers(0, 4), rng.normal(size=dim)
        if kind == 0:
            out += [x + rng.normal(size=dim) * noise * rng.random() for _ in range(int(rng.integers(2, 40)))]
        elif kind == 1:
            for _ in range(12):
                out.append(x)
                x = x + rng.normal(size=dim) * 0.25
        elif kind == 2:
            out += [x] * int(rng.integers(2, 9)) + [2 * x]
        else:
            out.append(x)
    return np.array(out[:n], np.float32)


@pytest.mark.parametrize(("seed", "noise", "slice_rows", "bucket"), [(1, 0.3, 4096, 256), (2, 0.6, 4096, 64), (3, 0.1, 8, 64), (4, 0.45, 16, 1 << 20)])
def test_links(spark, seed, noise, slice_rows, bucket):
    vectors = make(seed, 700, 24, noise)
    rows = [(int(i), v.tolist()) for i, v in zip(np.random.default_rng(seed).permutation(700) - 50, vectors, strict=True)]
    got = vector_links(spark.createDataFrame([(*r, 1, *EXTRA) for r in rows], SCHEMA).repartition(3), missed=1e-9, slice_rows=slice_rows, bucket=bucket).collect()
    want = {i: w for (i, _), w in zip(rows, brute_links(rows), strict=True)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_of_odd_rows(spark):
    x, y = [1.0, 0.0, 0.0], [-0.0, 1.0, 0.0]
    rows = [(1, x), (1, x), (None, x), (None, y), (5, y), (6, [0.0, 1.0, -0.0]), (7, None), (8, [0.0, 0.0, 0.0]), (9, [float("nan"), 1.0, 0.0]), (10, [None, 1.0, 0.0]), (10, []), (11, [1.0, 0.0]), (12, [float("inf")] * 3), (None, None), (13, [1e-40, 0.0, 0.0]), (14, [3e38, 3e37, 0.0])]
    got = vector_links(spark.createDataFrame([(*r, 1, *EXTRA) for r in rows], SCHEMA)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, brute_links(rows), strict=True))
    empty = vector_links(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0
    wide = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e300, 1.1e300]), (3, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links) for r in vector_links(wide).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_many_copies_stay_few_rows(spark):
    """A third of all rows are one vector, another third its noisy copies; links are counted, not listed."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=32)
    vectors = np.concatenate([np.repeat(x[None], 1000, 0), x + rng.normal(size=(1000, 32)) * 0.08, rng.normal(size=(1000, 32))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    assert [got[i].n_links for i in range(3000)] == ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()


def test_tables_hold_pairs_at_the_least_cosine():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20000, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9 * x + math.sqrt(1 - 0.81) * side
    n = tables_for(6, 0.9)
    normals = planes(40, 6 * n, 2)
    met = (sign_keys(x, normals, 6) == sign_keys(y, normals, 6)).any(1)
    assert (~met).sum() <= 12  # 2 are expected
    assert codes.PARTS == 4
