"""Manifests in parts: a run that is stopped and carried on gives the manifest of one that wasn't."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import records
from tessera.sources import manifest


def rows(spark, n, bad=None, first=1):
    df = spark.range(first, n + 1).select(F.col("id").alias("number"), F.col("id").alias("ord"))
    id_ = F.concat(F.lit("f_"), F.format_string("%05d", F.col("number") - 1))
    answer = F.when(F.col("number") == bad, 0.0).otherwise(F.col("number") * 1.5)
    return records.record(
        df, ("number", "ord"), problem_id=id_, family=F.lit("f"), category=F.lit(1), stem=F.lit("Find the area."), image_path=records.image_path(id_), answer_exact=F.lit("1"), answer_decimal=answer, origin=F.lit("generated"),
        seed=F.lit(0), params=F.lit('{"a":1}'), signature=F.concat(F.lit("s"), F.col("number").cast("string")), generator_version=F.lit("1"),
    )


def text(path):
    return "".join(p.read_text() for p in sorted(path.rglob("part-*")) if p.is_file())


def test_a_stopped_write_goes_on(spark, tmp_path):
    whole, stopped = tmp_path / "whole", tmp_path / "stopped"
    assert manifest.write_parts(rows(spark, 20), str(whole), "number", 3) == 7
    with pytest.raises(Exception, match="answer_decimal is zero"):
        manifest.write_parts(rows(spark, 20, bad=11), str(stopped), "number", 3)
    assert manifest.committed(spark, str(stopped)) == 3
    kept = manifest.read_parts(spark, str(stopped))
    assert kept.count() == 9 and kept.where("error IS NOT NULL").count() == 0
    # a part that was begun and never committed
    begun = stopped / "part=000003"
    begun.mkdir(exist_ok=True)
    (begun / "part-00000.txt").write_text('{"problem_id": "half')
    assert manifest.read_parts(spark, str(stopped)).count() == 9
    with pytest.raises(ValueError, match="exists"):
        manifest.write_parts(rows(spark, 20), str(stopped), "number", 3)
    assert manifest.write_parts(rows(spark, 20), str(stopped), "number", 3, resume=True) == 4
    assert text(stopped) == text(whole) and [json.loads(x)["problem_id"] for x in text(whole).splitlines()] == [f"f_{i:05d}" for i in range(20)]
    assert manifest.write_parts(rows(spark, 20), str(stopped), "number", 3, resume=True) == 0
    assert manifest.write_parts(rows(spark, 2), str(stopped), "number", 3, overwrite=True) == 1 and manifest.read_parts(spark, str(stopped)).count() == 2
    with pytest.raises(ValueError, match="either"):
        manifest.write_parts(rows(spark, 2), str(stopped), "number", 3, resume=True, overwrite=True)
    assert manifest.write_parts(rows(spark, 0), str(tmp_path / "none"), "number", 3) == 0


def test_appending_takes_what_is_new(spark, tmp_path):
    path = str(tmp_path / "m")
    assert manifest.append(rows(spark, 4), path) == 4
    more = rows(spark, 7, first=3).unionByName(rows(spark, 7, first=6).withColumn("ord", F.col("ord") + 100))
    assert manifest.append(more, path) == 3 and manifest.append(more, path) == 0
    got = manifest.read_parts(spark, path).orderBy("problem_id").collect()
    assert [(r.problem_id, r.signature, r.image_path) for r in got] == [(f"f_{i:05d}", f"s{i + 1}", f"images/f_{i:05d}.png") for i in range(7)]
    assert manifest.committed(spark, path) == 2


def test_a_run_carried_on_from_the_command_line(spark, tmp_path):
    args = ["--family", "inscribed_circle", "--n", "9", "--seed", "1", "--part-size", "4", "--no-report"]
    assert cli.main([*args, "--out", str(tmp_path / "a")], spark) == 0
    assert cli.main([*args, "--out", str(tmp_path / "b")], spark) == 0
    last = tmp_path / "b" / "manifest" / "part=000002"
    (last / "_SUCCESS").unlink()
    for p in last.glob("part-*"):
        p.write_text("{half")
    assert cli.main([*args, "--out", str(tmp_path / "b")], spark) == 1  # there already
    assert cli.main([*args, "--resume", "--out", str(tmp_path / "b")], spark) == 0
    assert text(tmp_path / "a" / "manifest") == text(tmp_path / "b" / "manifest")
