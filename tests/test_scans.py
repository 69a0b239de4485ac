"""Prefix scans and runs against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.scans import Fold, scan
from tessera.plans.queries import run_prefix


@pytest.mark.parametrize("stretch", [2, 7, 1 << 16])
def test_scan(spark, stretch):
    rng = random.Random(stretch)
    rows = [(rng.choice(["a", "b", None]), i // 2 + 1, i % 2, rng.choice([None, *range(-9, 9)])) for i in range(301)]
    df = spark.createDataFrame(rows, "k string, place long, turn int, v long")
    folds = {"total": Fold(F.col("v")), "before": Fold(F.col("v"), inclusive=False), "high": Fold(F.col("v"), "max"), "low": Fold(F.col("v"), "min", False)}
    for by in ([], ["k"]):
        got = {(r.place, r.turn): r for r in scan(df, "place", folds, by, ["turn"], stretch).collect()}
        assert len(got) == len(rows)
        for k, place, turn, _ in rows:
            upto = [v for a, p, t, v in rows if (not by or a == k) and (p, t) <= (place, turn) and v is not None]
            earlier = [v for a, p, t, v in rows if (not by or a == k) and (p, t) < (place, turn) and v is not None]
            r = got[place, turn]
            assert (r.total, r.before, r.high, r.low) == (sum(upto), sum(earlier), max(upto, default=None), min(earlier, default=None))
    assert scan(df.where("false"), "place", folds, stretch=stretch).count() == 0
    with pytest.raises(ValueError, match="folds"):
        scan(df, "place", {"x": Fold(F.col("v"), "median")})


def test_scan_of_null_places(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (0, 5), (4, 7)], "place long, v long")
    assert sorted(r.t for r in scan(df, "place", {"t": Fold(F.col("v"))}, stretch=2).collect()) == [1, 2, 7, 14]


def loop(draws, n, most, ceilings, streak):
    """Family after family, draw after draw."""
    names = sorted(draws)
    at, out, idle, gone, made, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0), dict.fromkeys(names, 0), set(), [], 0
    while total < n and len(made) < most and len(gone) < len(names):
        for f in names:
            if total >= n or len(made) >= most:
                break
            if f in gone:
                continue
            if (out[f] >= ceilings[f] if f in ceilings else idle[f] >= streak) or at[f] == len(draws[f]):
                gone.add(f)
                continue
            em = draws[f][at[f]]
            at[f] += 1
            total += em
            made.append((len(made) + 1, f, at[f], out[f], total))
            out[f] += em
            idle[f] = 0 if em else idle[f] + 1
    return made


@pytest.mark.parametrize(("seed", "n", "most", "streak"), [(1, 40, 500, 4), (2, 1000, 150, 9), (3, 1000, 4000, 3), (4, 1, 50, 5), (5, 500, 4000, 12)])
def test_runs_follow_the_loop(spark, seed, n, most, streak):
    rng = random.Random(seed)
    draws = {f: [rng.random() < p for _ in range(300)] for f, p in (("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.9))}
    ceilings = {"a": 25, "d": 60}
    rows = [(f, turn, i + 1, em, "wide") for turn, f in enumerate(sorted(draws)) for i, em in enumerate(draws[f])]
    df = spark.createDataFrame(rows, "family string, turn int, ord long, is_first boolean, spec string")
    got = run_prefix(df, n, most, ceilings, streak, stretch=16).orderBy("number").collect()
    assert [(r.number, r.family, r.ord, r.done, r.out) for r in got] == loop(draws, n, most, ceilings, streak)
    assert all(r.spec == "wide" for r in got)
