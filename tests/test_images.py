"""Figures as files: what is shaded, the same bytes each time, and a file where a record says."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import spec as S
from tessera.operators import images

SQUARE = [[-5, -5], [5, -5], [5, 5], [-5, 5]]


def scene(operation, own, **more):
    return json.dumps({"frame": {"x": 0, "y": 0, "half": 6}, "regions": [{"operation": operation, "own": own}], "shapes": [], "dots": [], "texts": []} | more)


def share(said):
    return ((images.WHITE - images.read_png(images.draw(said)).astype(float)) / (images.WHITE - images.SHADE)).mean() * 144


def test_shaded_shares():
    square, ring = {"kind": "polygon", "points": SQUARE}, {"kind": "circle", "center": [0, 0], "radius": 3}
    bent = {"kind": "polygon", "points": [[-5, -5], [5, -5], [0, 0], [5, 5], [-5, 5]][::-1]}
    far = {"kind": "circle", "center": [4, 0], "radius": 2}
    assert share(scene("union", [square])) == 100
    assert share(scene("difference", [square, ring])) == pytest.approx(100 - 9 * math.pi, rel=5e-3)
    assert share(scene("intersection", [square, ring])) == pytest.approx(9 * math.pi, rel=5e-3)
    assert share(scene("union", [bent])) == pytest.approx(75, rel=5e-3)
    d, r, t = 4, 3, 2
    lens = r * r * math.acos((d * d + r * r - t * t) / (2 * d * r)) + t * t * math.acos((d * d + t * t - r * r) / (2 * d * t)) - math.sqrt((-d + r + t) * (d + r - t) * (d - r + t) * (d + r + t)) / 2
    assert share(scene("union", [ring, far])) == pytest.approx(13 * math.pi - lens, rel=5e-3)
    assert share(scene("difference", [ring, square])) == 0


def test_files_round_trip_and_repeat():
    said = scene("union", [{"kind": "polygon", "points": SQUARE}], shapes=[{"kind": "polygon", "points": SQUARE}], dots=[[1, 1]], texts=[{"x": 0, "y": -5.5, "text": "10 é"}], step=1.0, stem="Find the area of the shaded region, which is a question of very many words indeed.")
    one = images.draw(said)
    grey = images.read_png(one)
    assert one == images.draw(said) and grey.shape[1] == images.SIDE and grey.shape[0] > images.SIDE + 40
    assert (grey[: 20 * images.UNIT] == images.BLACK).any() and {images.BLACK, images.WHITE} <= set(np.unique(grey).tolist())
    assert images.letters("0A~").shape == (8 * images.UNIT, 18 * images.UNIT)
    damaged = bytearray(one)
    damaged[60] ^= 1
    with pytest.raises(ValueError, match="check sum"):
        images.read_png(bytes(damaged))


def test_the_frame_holds_labels_and_faults_end_the_query(spark):
    corners = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in SQUARE])
    good = S.figure(S.polygon("a", corners), S.region("union", "a"), labels=[S.length_labels(corners, F.lit(10.0), F.lit("10"), "a")])
    figures = spark.range(2).select("id", good.alias("spec"), F.lit("Find it.").alias("stem"))
    one, two = images.pictures(figures, "id").orderBy("id").collect()
    assert (one.id, two.id) == (0, 1) and one.image == two.image
    grey = images.read_png(bytes(one.image))
    assert (grey == images.SHADE).mean() > 0.4
    with pytest.raises(Exception, match="no region to measure"):
        images.pictures(spark.range(1).select(S.figure(S.polygon("a", corners)).alias("spec"))).collect()


def test_a_runs_files(spark, tmp_path):
    for name in "ab":
        assert cli.main(["--family", "coordinate_polygon", "--n", "5", "--seed", "2", "--out", str(tmp_path / name)], spark) == 0
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / name / "images").iterdir()} for name in "ab")
    assert one == two and len(one) == 5 and all(k.endswith(".png") for k in one)
    lines = [json.loads(x) for p in sorted((tmp_path / "a" / "manifest").rglob("part-*")) for x in p.read_text().splitlines()]
    assert sorted(r["image_path"] for r in lines) == sorted(f"images/{k}" for k in one)
