"""The geometry-problem engine against hand-worked cases and published numbers."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers as ans
from tessera.functions import geometry as G
from tessera.functions.regions import RegionError, measure_spec
from tessera.operators import families as fam
from tessera.operators import figure, harvest, records, structured
from tessera.operators import stages as st
from tessera.plans import more_queries, queries
from tessera.plans.more_queries import SPECS, _polygon, _region, _square
from tessera.plans.runs import report, run
from tessera.sources import manifest
from tessera.sources.draws import draws


def judged(spark, family, rows, schema):
    return st.judge(spark.createDataFrame(rows, schema), family)


@pytest.mark.parametrize("family,want", [(fam.CIRCLE, (120, 120)), (fam.NESTED, (18_000, 9_334)), (fam.COMPOSITE, (34_969, 11_449)), (fam.COORDINATE, (None, None))])
def test_ceilings(spark, family, want):
    row = queries.ceiling(spark, family).first()
    assert (row.raw, row.ceiling) == want


def test_signature_is_stable(spark):
    row = st.sign(spark.sql("SELECT 4L AS k, 10L AS side"), fam.CIRCLE).first()
    assert row.signature == "5c56ec7b77ee6ad15e6c549f16d54e347c23509095a0d19eb159b07f29a3a0b8"
    same = st.sign(spark.sql("SELECT 4L AS k, CAST(10.0000001 AS DECIMAL(20,7)) AS side"), fam.CIRCLE).first()
    assert same.signature == row.signature
    points = st.sign(spark.sql("SELECT array(array(0L,0L), array(4L,0L), array(4L,3L)) AS points UNION ALL SELECT array(array(4L,0L), array(4L,3L), array(0L,0L))"), fam.COORDINATE).collect()
    assert points[0].signature != points[1].signature


@pytest.mark.parametrize(
    "family,schema,row,exact,value",
    [
        (fam.NESTED, "n long, m long, side_outer long, side_inner long", (4, 3, 10, 6), "100 - 9*sqrt(3)", 100 - 9 * 3**0.5),
        (fam.NESTED, "n long, m long, side_outer long, side_inner long", (6, 4, 4, 3), "24*sqrt(3) - 9", 24 * 3**0.5 - 9),
        (fam.NESTED, "n long, m long, side_outer long, side_inner long", (8, 3, 1, 1), "2*sqrt(2) + 2 - sqrt(3)/4", 2 + 2 * 2**0.5 - 3**0.5 / 4),
        (fam.NESTED, "n long, m long, side_outer long, side_inner long", (9, 3, 2, 2), "9*cot(pi/9) - sqrt(3)", 9 / math.tan(math.pi / 9) - 3**0.5),
        (fam.CIRCLE, "k long, side decimal(20,6)", (4, 10), "100 - 25*pi", 100 - 25 * math.pi),
        (fam.CIRCLE, "k long, side decimal(20,6)", (3, 6), "9*sqrt(3) - 3*pi", 9 * 3**0.5 - 3 * math.pi),
        (fam.COMPOSITE, "width double, height double, notch_w double, notch_h double", (12.5, 6.0, 5.0, 2.5), "125/2", 62.5),
        (fam.COORDINATE, "points array<array<long>>", ([[0, 0], [6, 0], [6, 6], [3, 3], [0, 6]],), "27", 27.0),
        (fam.COORDINATE, "points array<array<long>>", ([[0, 0], [1, 0], [0, 1]],), "1/2", 0.5),
    ],
)
def test_answers(spark, family, schema, row, exact, value):
    from decimal import Decimal

    row = tuple(Decimal(x) if "decimal" in schema and i == 1 else x for i, x in enumerate(row))
    got = st.measure(st.solve(spark.createDataFrame([row], schema), family)).first()
    assert got.answer_exact == exact and got.answer_decimal == pytest.approx(value, rel=1e-12) and got.verified


def test_worst_circle_difference(spark):
    df = st.measure(st.solve(fam.CIRCLE.space(spark), fam.CIRCLE))
    assert df.agg(F.max("rel_diff")).first()[0] == pytest.approx(7.158e-06, rel=1e-3)


def test_corrupt_figures_fail(spark):
    df = st.solve(spark.sql("SELECT 10L AS width, 8L AS height, 4L AS notch_w, 3L AS notch_h"), fam.COMPOSITE)
    bad = st.measure(df.withColumn("answer_decimal", F.lit(68.001)))
    assert not bad.first().verified
    with pytest.raises(Exception, match="measure as solved"):
        st.verified_or_fail(bad).collect()


def test_issue_order_and_severity(spark):
    s = "n long, m long, side_outer long, side_inner long"
    got = {r.n: r for r in judged(spark, fam.NESTED, [(2, 3, 1, 1), (13, 14, 20, 1), (5, 3, 0, 1), (4, 8, 10, 4), (6, 3, 1, 20)], s).collect()}
    assert got[2].blocking == "outer side count 2 outside [3, 12]"
    assert [i.reason for i in got[13].issues][:3] == ["outer side count 13 outside [3, 12]", "inner side count 14 outside [3, 12]", "inner side count 14 is not less than outer 13"]
    assert got[5].blocking == "side lengths must be positive" and got[5].reject_reason == got[5].blocking
    assert got[4].blocking is None and got[4].warnings[0] == "inner side count 8 is not less than outer 4"
    assert got[6].blocking.startswith("inner polygon does not fit")
    key = spark.range(1).select(st.reason_key(F.lit("notch width is 0.10 of the figure, outside [0.25, 0.75]")).alias("a"), st.reason_key(F.lit("vertex (7, 0) outside the lattice bounds")).alias("b")).first()
    assert (key.a, key.b) == ("notch width is of the figure, outside", "vertex")


def test_outlines(spark):
    s = "id int, points array<array<long>>"
    rows = [(1, [[0, 0], [2, 2], [2, 0], [0, 2]]), (2, [[0, 0], [4, 0], [4, 4], [0, 4]]), (3, [[0, 0], [6, 0], [6, 6], [3, 3], [0, 6]]), (4, [[0, 0], [4, 0], [2, 0], [2, 3]]), (5, [[0, 0], [2, 0], [4, 0], [0, 4]])]
    got = {r.id: r for r in spark.createDataFrame(rows, s).select("id", G.is_simple(F.col("points")).alias("simple"), G.is_convex(F.col("points")).alias("convex")).collect()}
    assert {i: (r.simple, r.convex) for i, r in got.items()} == {1: (False, False), 2: (True, True), 3: (True, False), 4: (False, False), 5: (True, False)}


def test_draws_follow_the_generator(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    assert [tuple(r)[1:] for r in draws(spark, "inscribed_circle", 3, 7).orderBy("ord").collect()] == [(int(rng.integers(3, 9)), int(rng.integers(1, 21))) for _ in range(3)]
    assert draws(spark, "coordinate_polygon", 5000, 1).count() == 5000


def test_mixed_run_equals_the_published_report(spark):
    prefix = run(spark, ["nested_polygons", "inscribed_circle", "composite_rectilinear", "coordinate_polygon"], 200, 0)
    r = report(prefix).first()
    assert (r.draws, r.invalid, r.duplicates, r.emitted) == (404, 170, 34, 200)
    assert r.by_family == {"composite_rectilinear": 38, "coordinate_polygon": 47, "inscribed_circle": 68, "nested_polygons": 47}
    assert r.worst_difference == pytest.approx(7.16e-06, abs=1e-8) and r.acceptance_rate == pytest.approx(0.579, abs=1e-3)
    ids = [x.problem_id for x in prefix.where("family = 'nested_polygons' AND is_first").orderBy("ord").collect()]
    assert ids == [f"nested_polygons_{i:05d}" for i in range(47)]


def test_a_run_stops_at_its_ceiling(spark):
    r = report(run(spark, ["inscribed_circle"], 130, 0, max_draws=2000)).first()
    assert r.emitted == 120


@pytest.mark.parametrize("text,value,exact", [("100 - 9*sqrt(3)", 100 - 9 * 3**0.5, "100 - 9*sqrt(3)"), ("2^3", 8, "8"), ("2**3", 8, "8"), ("Rational(25, 4)", 6.25, "25/4"), ("E", math.e, "E"), ("cbrt(27)", 3, "3"), (".5 + 1.", 1.5, "3/2"), ("-sqrt(2)", -(2**0.5), "-sqrt(2)"), ("25/4 - 25*pi/16", 25 / 4 - 25 * math.pi / 16, "25/4 - 25*pi/16"), ("-2^2", -4, "-4"), ("2^-1", 0.5, "1/2")])
def test_plain_answers(text, value, exact):
    v = ans.parse_plain(text)
    assert v.number == pytest.approx(value, rel=1e-14) and v.text() == exact


@pytest.mark.parametrize("text", ["", "x", "__import__('os')", "1; 2", "sqrt", "sqrt(-1)", "1/0", "(1", "1)", "a.b", "[1]", "lambda: 1", "1 if 1 else 2", "'a'", "2 3", "sqrt(1, 2)", "9**9**9"])
def test_rejected_answers(text):
    with pytest.raises((ans.AnswerError, OverflowError)):
        v = ans.parse_plain(text)
        assert math.isfinite(v.number) and v.number < 1e300


@pytest.mark.parametrize("text,exact", [(r"\( 8+4\sqrt{3} \)", "4*sqrt(3) + 8"), (r"\(x=30\)", "30"), (r"\(\displaystyle 1296+81\pi\) cm\(^2\)", "81*pi + 1296"), (r"\(431.25\)", "1725/4"), (r"\(\dfrac{450\sqrt{3}}{2}\)", "225*sqrt(3)"), (r"\(3-2\sqrt{2}\approx 0.17157\)", "3 - 2*sqrt(2)")])
def test_latex_answers(text, exact):
    assert ans.parse_latex(text).text() == exact


@pytest.mark.parametrize("text", ["30", r"\(1\) or \(2\)", r"\(\alpha\)", r"\(x\)", r"\(\frac{1}{\)"])
def test_rejected_latex(text):
    with pytest.raises(ans.AnswerError):
        ans.parse_latex(text)


@pytest.mark.parametrize("name,want", [("union", 28), ("intersection", 4), ("corners", 14), ("length", 20)])
def test_region_measures(name, want):
    assert measure_spec(json.dumps(SPECS[name])) == pytest.approx(want, rel=1e-12)


def test_regions_with_circles_and_sums():
    ring = [{"kind": "circle", "id": "a", "center": [0, 0], "radius": 5}, {"kind": "circle", "id": "b", "center": [0, 0], "radius": 2}, _region("difference", "a", "b")]
    assert measure_spec(json.dumps(ring)) == pytest.approx(21 * math.pi, rel=1e-4)
    assert measure_spec(json.dumps(ring)) != pytest.approx(21 * math.pi, rel=1e-9)
    two = [_polygon("a", _square(0, 0, 4)), _polygon("b", _square(1, 1, 1)), _polygon("c", _square(9, 0, 2)), _polygon("d", _square(9, 0, 0.5)), _region("difference", "a", "b"), _region("difference", "c", "d")]
    assert measure_spec(json.dumps(two)) == pytest.approx(18.75)


@pytest.mark.parametrize("spec", [SPECS["bowtie"], SPECS["dangling"], [_polygon("a", [[0, 0], [1, 1]]), _region("union", "a")], [_polygon("a", _square(0, 0, 1))], [_polygon("a", _square(0, 0, 1)), _region("xor", "a", "a")], [{"kind": "arc"}, _region("union", "a")], [_polygon("a", _square(0, 0, 1)), _polygon("a", _square(0, 0, 2)), _region("union", "a")]])
def test_bad_figures(spec):
    with pytest.raises(RegionError):
        measure_spec(json.dumps(spec))


GOOD = {"input_id": "a", "family": "composite_rectilinear", "params": {"width": 10, "height": 8, "notch_w": 4, "notch_h": 3}, "expected_answer": "68"}


def statuses(spark, rows):
    lines = [(i + 1, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    return {r.line: r for r in structured.statuses(spark.createDataFrame(lines, "line long, value string")).collect()}


def test_structured_examples(spark):
    """Rows with known answers, each family, one with decimals and one that only warns."""
    f = lambda i, family, params, answer: {"input_id": i, "family": family, "params": params, "expected_answer": answer}
    rows = [
        f("n1", "nested_polygons", {"n": 4, "m": 3, "side_outer": 10, "side_inner": 6}, "100 - 9*sqrt(3)"), f("n2", "nested_polygons", {"n": 4, "m": 6, "side_outer": 8, "side_inner": 2}, "64 - 6*sqrt(3)"), GOOD,
        f("c2", "composite_rectilinear", {"width": 12.5, "height": 6, "notch_w": 5, "notch_h": 2.5}, "62.5"), f("p1", "coordinate_polygon", {"points": [[0, 0], [6, 0], [6, 6], [3, 3], [0, 6]]}, "27"), f("k1", "inscribed_circle", {"k": 4, "side": 2.5}, "25/4 - 25*pi/16"),
    ]
    got = statuses(spark, rows)
    assert [got[i + 1].status for i in range(len(rows))] == ["emitted"] * len(rows)
    assert len(got[2].warnings) > 0 and len(got[5].warnings) > 0 and got[4].answer_exact == "125/2"


def test_structured_errors_and_order(spark):
    change = lambda **k: GOOD | k
    p = GOOD["params"]
    bad = [
        ("{oops", "invalid JSON"), ("[1]", "row must be"), (change(extra=1), "unknown keys extra"), ({k: v for k, v in GOOD.items() if k != "params"}, "missing required keys params"), (change(input_id="-x"), "input_id must"),
        (change(input_id="b", family=3), "family must"), (change(input_id="c", family="cube"), "unknown family"), (change(input_id="d", params=[1]), "params must be a JSON object"), (change(input_id="e", params={"width": 1}), "params must have exactly"),
        (change(input_id="f", params=p | {"width": "10"}), "params: width"), (change(input_id="g", params=p | {"width": True}), "params: width"), (change(input_id="h", expected_answer=" "), "expected_answer must"), (change(input_id="i", expected_answer="x+1"), "expected_answer: unknown symbols"),
        (change(input_id="j", source=3), "source must"), (change(input_id="k", source={"who": "x"}), "unknown source keys"), (change(input_id="l", source={"site": 3}), "source.site must"), (change(input_id="m", notes=3), "notes must"),
    ]
    got = statuses(spark, [r for r, _ in bad] + [GOOD, GOOD, change(input_id="z")])
    for i, (_, reason) in enumerate(bad):
        assert got[i + 1].status == "input_error" and got[i + 1].reason.startswith(reason), (i, got[i + 1].reason)
    n = len(bad)
    assert got[n + 1].status == "emitted"
    assert got[n + 2].reason == "duplicate input_id a"
    assert got[n + 3].status == "duplicate"


def test_a_mismatch_frees_its_signature(spark):
    got = statuses(spark, [GOOD | {"expected_answer": "67"}, GOOD | {"input_id": "b"}, GOOD | {"input_id": "c"}])
    assert [got[i].status for i in (1, 2, 3)] == ["answer_mismatch", "emitted", "duplicate"]


def test_records_and_manifest(spark, tmp_path):
    df = st.solve(st.sign(spark.sql("SELECT 10L AS width, 8L AS height, 4L AS notch_w, 3L AS notch_h"), fam.COMPOSITE), fam.COMPOSITE)
    made = records.generated(df, F.lit("composite_rectilinear"), F.to_json(F.struct("width")), F.lit(5), F.lit("composite_rectilinear_00000")).withColumn("original_answer", F.lit('line "one"\n  é'))
    path = str(tmp_path / "m")
    manifest.write(made, path)
    assert manifest.read(spark, path).drop("error").collect() == made.collect()
    with pytest.raises(Exception, match="already exists"):
        manifest.write(made, path)
    line = json.loads(records.to_line(made).first().value)
    assert line["params"] == {"width": 10} and "expected_answer" not in line and line["source_url"] is None and list(line) == sorted(line)
    with pytest.raises(Exception, match="answer_decimal is zero"):
        manifest.write(made.withColumn("answer_decimal", F.lit(0.0)), path, overwrite=True)
    (tmp_path / "cut").write_text(records.to_line(made).first().value + '\n{"problem_id": "x')
    assert [r.error for r in manifest.read(spark, str(tmp_path / "cut")).collect()] == [None, "invalid JSON"]
    assert [r.error for r in manifest.read(spark, str(tmp_path / "cut"), strict=False).collect()] == [None]


def test_given_records(spark):
    base = {"problem_id": F.lit("g"), "family": F.lit("paper"), "category": F.lit(1), "stem": F.lit("Find 2 sides."), "image_path": F.lit("x.png"), "origin": F.lit("given"), "paper_index": F.lit(7), "answer_type": F.lit("unavailable")}
    reason = lambda **k: records.record(spark.range(1), **(base | k)).select(records.invalid_reason().alias("r"), records.stem_warning().alias("w")).first()
    ok = reason()
    assert ok.r is None and ok.w == "stem contains digits 2"
    assert reason(paper_index=F.lit(201)).r.startswith("given requires paper_index")
    assert reason(seed=F.lit(1)).r == "given has no generator provenance: seed"
    assert reason(answer_exact=F.lit("1")).r.startswith("unavailable means")
    assert reason(answer_type=F.lit("exact")).r == "answer_exact must be non-empty"
    assert reason(category=F.lit(2)).r == "category 2 must not carry a diagram"


def test_stems(spark):
    stems = {"Find the area.": None, "Find ٣ it": "stem contains digits ٣", "two, Three!": "stem contains number words three, two", "the (Hexagon)": "stem names shapes hexagon", "squared": None}
    got = spark.createDataFrame([(s,) for s in stems], "s string").select("s", records.stem_leak(F.col("s")).alias("w")).collect()
    assert {r.s: r.w for r in got} == stems


def test_harvest(spark):
    head = lambda n, more="": f'<h5>\\(\\textbf{{{n})}}\\) Find the shaded area of this figure. <div class="sh-link">Show Answer</div><div class="sh-content">\\({n}0\\)</div>{more}</h5>'
    html = f'<div class="entry-content">{head(1)}<p><img src="https://x/play.png"><img src="https://x/1.png"></p>{head(2)}<p>none</p>{head(1)}<h5>plain</h5><img src="https://x/2.png">{head(4)}<iframe></iframe></div>'
    pages = spark.createDataFrame([(1, html), (2, "<p>no area</p>")], "page_id long, html string")
    got = {r.number: r for r in harvest.fields(harvest.blocks(pages)).collect()}
    assert sorted(got) == [1, 2, 4]
    assert got[1].stem == "Find the shaded area of this figure." and got[1].image_url == "https://x/1.png" and got[1].answer_raw == "\\(10\\)"
    assert got[2].harvestable and got[2].image_url == "https://x/2.png" and not got[4].harvestable
    assert [r.number for r in harvest.harvest(pages).orderBy("number").collect()] == [1, 2] and harvest.harvest(pages, 1).count() == 1
    assert [r.number for r in harvest.skipped(pages).collect()] == [4]
    assert harvest.numbering(harvest.blocks(pages)).first().gaps == [3]
    assert {r.number: r.answer for r in harvest.layout(harvest.blocks(pages)).collect()} == {1: "same block", 2: "same block", 4: "same block"}


def test_figures_are_deterministic(spark):
    df = spark.sql("SELECT 10L AS width, 8L AS height, 4L AS notch_w, 3L AS notch_h")
    make = lambda: df.select(figure.svg(fam.outline(fam.COMPOSITE.columns(df)), None, F.array(*map(F.lit, "abcdef")), F.array(*[F.lit(i != 1) for i in range(6)]), axes=True).alias("s")).first().s
    s = make()
    assert s == make() and s.count("<text") == 5 and "M0.0000 0.0000L10.0000 0.0000" in s and ">b<" not in s


def test_plug_ins():
    with pytest.raises(KeyError, match="unknown family"):
        fam.get("cube")
    assert fam.register(fam.CIRCLE) is fam.CIRCLE
    import dataclasses

    with pytest.raises(ValueError, match="another family"):
        fam.register(dataclasses.replace(fam.CIRCLE, stem="x"))
    with pytest.raises(ValueError, match="unknown kinds"):
        fam.register(dataclasses.replace(fam.CIRCLE, name="c2", params={"k": "colour"}))


def test_stream_appends_each_problem_once(spark, tmp_path):
    from tessera.streaming import structured_stream as stream

    rows = [{"input_id": str(i), "family": "inscribed_circle", "params": json.dumps({"k": 3 + i % 3, "side": 2}), "at": "2024-01-01T00:00:00Z"} for i in range(9)] + [{"input_id": "x", "family": "other", "params": "{}", "at": "2024-01-01T00:00:00Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = stream.append(stream.problems(spark, str(tmp_path / "in"), "inscribed_circle"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_every_query_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert more_queries.SPECS and entry.entry(spark).columns == ["problem_id", "signature", "n", "m", "side_outer", "side_inner", "answer_decimal"]


def test_every_query_equals_its_sql(spark):
    """All queries of the engine on the smallest tables, against DuckDB."""
    import glob
    import os

    import duckdb

    con, sf_dir = duckdb.connect(), "/root/testdata/sf0.001"
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    shown = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    for name, query in queries.QUERIES.items():
        got = query(spark, sf_dir)
        columns = sorted(got.columns)
        rows = got.select(*columns).collect()
        if name in queries.ORACLE_SQL:
            want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
            assert shown(rows) == shown(want), name
