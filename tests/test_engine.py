"""Figures as data, order as data, runs from the command line and from files, pages, and the family contract."""

import dataclasses
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import answers as ans
from tessera.functions import geometry as G
from tessera.functions import spec as S
from tessera.operators import families as fam
from tessera.operators import figure, harvest, records, structured
from tessera.operators import stages as st
from tessera.operators.ordinals import least_by, numbered
from tessera.plans.runs import run
from tessera.sources.draws import draws

#: The first ten problems of each family's run with seed 7, in the order of their parameters' names.
GOLDEN = {
    "composite_rectilinear": ("height notch_h notch_w width", [[4, 3, 9, 19], [9, 3, 6, 17], [12, 7, 7, 12], [14, 7, 8, 17], [12, 3, 3, 8], [5, 3, 3, 12], [10, 6, 10, 15], [5, 2, 3, 5], [17, 7, 4, 10], [20, 12, 5, 13]]),
    "coordinate_polygon": ("points", [[[[-3, 5], [5, -6], [0, 4]]], [[[4, -5], [0, 4], [-3, -2]]], [[[3, -3], [6, -1], [0, 0]]], [[[0, 4], [0, 6], [-6, -5]]], [[[2, -4], [2, 4], [0, -6]]], [[[-2, 4], [-4, -5], [1, -2]]], [[[1, -1], [6, -5], [1, 2], [-1, 2]]], [[[-3, -6], [-1, 4], [-5, -1]]], [[[5, 6], [-4, -2], [1, -6], [6, -3]]], [[[-1, 3], [-6, -6], [3, -2]]]]),
    "inscribed_circle": ("k side", [[8, 13], [7, 18], [6, 16], [8, 5], [3, 7], [4, 18], [8, 1], [5, 17], [3, 16], [3, 10]]),
    "nested_polygons": ("m n side_inner side_outer", [[7, 9, 5, 17], [5, 8, 12, 11], [5, 8, 17, 20], [8, 11, 7, 13], [4, 5, 3, 13], [4, 5, 10, 20], [10, 11, 13, 17], [5, 6, 4, 18], [7, 8, 15, 17], [3, 9, 10, 15]]),
}


@pytest.mark.parametrize("family", GOLDEN)
def test_golden_runs(spark, family):
    names, want = GOLDEN[family]
    got = run(spark, [family], 10, 7).where("is_first").orderBy("ord").collect()
    assert [[json.loads(r.params)[n] for n in names.split()] for r in got] == want


@pytest.mark.parametrize("family,rate", [("nested_polygons", 0.491), ("inscribed_circle", 1.0), ("composite_rectilinear", 0.354), ("coordinate_polygon", 0.438)])
def test_acceptance(spark, family, rate):
    """Published shares of valid ones among 1,000 draws of seed 0."""
    f = fam.get(family)
    got = st.judge(draws(spark, family, 1000, 0), f).agg(F.count_if(F.col("reject_code").isNull())).first()[0]
    assert got == round(1000 * rate)


def test_a_run_adds_up(spark):
    from tessera.plans.runs import causes, report

    prefix = run(spark, ["nested_polygons"], 150, 0)
    r = report(prefix).first()
    assert r.draws == r.invalid + r.duplicates + r.emitted and r.emitted == 150 and 0 <= r.collision_rate < 0.5
    out = prefix.where("is_first").orderBy("number").collect()
    assert len({x.signature for x in out}) == 150 and [x.problem_id for x in out] == [f"nested_polygons_{i:05d}" for i in range(150)]
    counts = [x.n for x in causes(prefix).collect()]
    assert sum(counts) == r.invalid and counts == sorted(counts, reverse=True)


# --- figures as data ------------------------------------------------------------------------------
def solved(spark, sql, family):
    return st.solve(spark.sql(sql), family)


NESTED = "SELECT 6L AS n, 4L AS m, 10L AS side_outer, 3L AS side_inner"


def test_a_wrong_figure_fails_though_the_parameters_are_right(spark):
    df = solved(spark, NESTED, fam.NESTED)
    assert st.measure(df).first().verified
    moved = lambda change: df.withColumn("spec", F.transform("spec", lambda s: F.when(s["id"] == "inner", change(s)).otherwise(s)))
    grown = moved(lambda s: s.withField("points", F.transform(s["points"], lambda p: F.transform(p, lambda x: x * 1.001))))
    outside = moved(lambda s: s.withField("points", F.transform(s["points"], lambda p: F.array(p[0] + 30, p[1]))))
    assert not st.measure(grown).first().verified
    r = st.measure(outside).first()  # not inside: no plain measure
    assert r.measured is None and not r.verified
    r = st.measure(outside, general=True).first()
    assert r.measured == pytest.approx(G_area(6, 10)) and not r.verified
    r = st.measure(df, general=True).first()
    assert r.verified
    # and right figures don't depend on the parameters
    assert st.measure(df.withColumn("n", F.lit(11)).withColumn("side_outer", F.lit(1))).first().verified


def G_area(k, side):
    return k / 4 * side * side / math.tan(math.pi / k)


def test_circle_figures_pass_at_the_curved_tolerance_only(spark):
    df = solved(spark, "SELECT 4L AS k, 10L AS side", fam.CIRCLE)
    assert st.measure(df).first().verified and not st.measure(df, 1e-9).first().verified
    wide = df.withColumn("spec", F.transform("spec", lambda s: F.when(s["kind"] == "circle", s.withField("radius", F.lit(5.2))).otherwise(s)))
    assert st.measure(wide).first().measured is None  # it leaves the square


FIGURES = {
    "a polygon of two points": ([dict(kind="polygon", id="a", points=[[0.0, 0.0], [1.0, 0.0]]), dict(kind="region", operation="union", of=["a"])], "fewer than three points in a"),
    "a bowtie": ([dict(kind="polygon", id="a", points=[[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0]]), dict(kind="region", operation="union", of=["a"])], "not a simple polygon: a"),
    "one id twice": ([dict(kind="polygon", id="a", points=[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])] * 2 + [dict(kind="region", operation="union", of=["a"])], "two shapes have one id"),
    "a flat circle": ([dict(kind="circle", id="a", center=[0.0, 0.0], radius=0.0), dict(kind="region", operation="union", of=["a"])], "radius must be positive: a"),
    "an arc": ([dict(kind="arc", id="a")], "can't build kind arc"),
    "an unknown kind": ([dict(kind="blob")], "unknown kind blob"),
    "no region": ([dict(kind="circle", id="a", center=[0.0, 0.0], radius=1.0)], "no region to measure"),
    "an unknown operation": ([dict(kind="circle", id="a", center=[0.0, 0.0], radius=1.0), dict(kind="region", operation="xor", of=["a"])], "unknown operation xor"),
    "a dangling id": ([dict(kind="circle", id="a", center=[0.0, 0.0], radius=1.0), dict(kind="region", operation="union", of=["b"])], "no shape is named b"),
    "one operand": ([dict(kind="circle", id="a", center=[0.0, 0.0], radius=1.0), dict(kind="region", operation="difference", of=["a"])], "too few shapes for difference"),
    "an unknown measure": ([dict(kind="circle", id="a", center=[0.0, 0.0], radius=1.0), dict(kind="region", operation="union", of=["a"], measure="mass")], "unknown measure mass"),
    "a good one": ([dict(kind="circle", id="a", center=[0.0, 0.0], radius=1.0), dict(kind="region", operation="union", of=["a"])], None),
}


def figures(spark, specs):
    rows = [(k, [{f: p.get(f) for f in S.FIELDS} for p in v]) for k, v in specs.items()]
    return spark.createDataFrame(rows, f"name string, spec {S.TYPE}")


def test_what_keeps_a_figure_from_being_built(spark):
    got = {r.name: r.f for r in figures(spark, {k: v[0] for k, v in FIGURES.items()}).select("name", S.fault(F.col("spec")).alias("f")).collect()}
    assert got == {k: v[1] for k, v in FIGURES.items()}


def test_drawing(spark):
    square = dict(kind="polygon", id="a", points=[[0.0, 0.0], [0.0, 4.0], [4.0, 4.0], [4.0, 0.0]])  # clockwise
    label = lambda owner: dict(kind="length_label", segment=[[0.0, 0.0], [0.0, 4.0]], text="4", owner=owner)
    specs = {
        "hole": [square, dict(kind="circle", id="b", center=[2.0, 2.0], radius=1.0), dict(kind="region", operation="difference", of=["a", "b"]), label("a")],
        "both": [square, dict(kind="circle", id="b", center=[4.0, 2.0], radius=3.0), dict(kind="region", operation="intersection", of=["a", "b"])],
        "owner": [square, dict(kind="region", operation="union", of=["a"]), label("z")],
        "grid": [square, dict(kind="region", operation="union", of=["a"]), dict(kind="axes", step=0.0)],
        "kind": [square, dict(kind="region", operation="union", of=["a"]), dict(kind="blob")],
    }
    df = figures(spark, specs)
    got = {r.name: (r.s, r.f) for r in df.select("name", figure.render(F.col("spec")).alias("s"), figure.render_fault(F.col("spec")).alias("f")).collect()}
    assert [got[k][1] for k in specs] == [None, None, "no polygon is named z", "axes step must be positive", "unknown kind blob"]
    assert "A1.0000 1.0000 0 1 1" in got["hole"][0] and '<text x="-0.1200" y="-2.0000">4</text>' in got["hole"][0]
    assert "clip-path" in got["both"][0] and "viewBox" in got["both"][0]
    with pytest.raises(Exception, match="no polygon is named z"):
        df.where("name = 'owner'").select(figure.rendered_or_fail(F.col("spec"))).collect()
    sheet = df.where("name IN ('hole', 'both')").agg(figure.contact_sheet(F.collect_list(figure.render(F.col("spec"))), 1).alias("s")).first().s
    assert sheet.count("<svg") == 3 and 'height="800"' in sheet and 'y="400"' in sheet
    points = solved(spark, "SELECT array(array(0L,0L), array(4L,0L), array(0L,3L)) AS points", fam.COORDINATE).select(figure.render(F.col("spec")).alias("s")).first().s
    assert points.count('class="dot"') == 3 and points.count("<text") == 2 and "(4, 0)" in points and "(0, 3)" not in points and 'class="axes"' in points


def test_inner_fits_equals_every_corner_against_every_edge(spark):
    df = spark.sql("SELECT n, m, so AS side_outer, si AS side_inner FROM range(3, 17) a(n), range(3, 17) b(m), VALUES (4L), (7L) AS c(so), VALUES (1L), (3L), (5L), (6L), (7L) AS d(si)")
    tolerance = F.pow(G.circumradius(F.col("n"), F.col("side_outer").cast("double")), 2) * 1e-9
    loop = G.contains_all(G.regular_vertices(F.col("n"), F.col("side_outer").cast("double")), G.regular_vertices(F.col("m"), F.col("side_inner").cast("double")), tolerance)
    got = df.select(fam.inner_fits(fam.NESTED.columns(df)).alias("one"), loop.alias("loop")).groupBy("one", "loop").count().collect()
    assert {(r.one, r.loop) for r in got} == {(True, True), (False, False)}


# --- order as data --------------------------------------------------------------------------------
def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), (F.col("id") % 3).alias("b")).repartition(7)
    got = numbered(df, ["b", "a"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001)) and [(r.b, r.a) for r in got] == sorted((r.b, r.a) for r in got)
    assert numbered(df.where("false"), ["a"]).count() == 0
    tied = numbered(df.withColumn("c", F.lit(1)), ["c"], "n", 0)
    assert sorted(r.n for r in tied.collect()) == list(range(5000))


def test_least_of_a_key(spark):
    df = spark.createDataFrame([("a", 3, True), ("a", 1, False), ("b", 2, False), (None, 0, True), (None, 5, True)], "k string, v int, ok boolean")
    got = {(r.k, r.v): r.least for r in least_by(df, "k", F.col("v"), F.col("ok"), "least").collect()}
    assert got == {("a", 3): 3, ("a", 1): 3, ("b", 2): None, (None, 0): None, (None, 5): None}


def test_payload_of_any_value(spark):
    """What tells values apart: true from 1, text from numbers, null, lists; keys in order."""
    cases = {
        '{"side": 10, "k": 4}': '[["k",["n","4.000000"]],["side",["n","10.000000"]]]',
        '{"a": true, "b": 1, "c": "1", "d": null, "e": 0.9999999}': '[["a",["b",true]],["b",["n","1.000000"]],["c",["s","1"]],["d",["z",null]],["e",["n","1.000000"]]]',
        '{"p": [[0, -1], [2, 3.5]]}': '[["p",["l",[["l",[["n","0.000000"],["n","-1.000000"]]],["l",[["n","2.000000"],["n","3.500000"]]]]]]]',
    }
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", st.variant_payload("v").alias("p")).collect()
    assert {r.v: r.p for r in got} == cases
    digest = hashlib.sha256(("inscribed_circle\0" + cases['{"side": 10, "k": 4}']).encode()).hexdigest()
    assert st.sign(spark.sql("SELECT 4L AS k, 10L AS side"), fam.CIRCLE).first().signature == digest


# --- runs -----------------------------------------------------------------------------------------
def lines_of(folder):
    return [json.loads(x) for p in sorted(folder.rglob("part-*.txt")) for x in p.read_text().splitlines()]


def test_a_drawn_run_from_the_command_line(spark, tmp_path, capsys):
    out = tmp_path / "run"
    assert cli.main(["--family", "inscribed_circle", "--n", "12", "--seed", "3", "--out", str(out)], spark) == 0
    text = capsys.readouterr().out
    assert "family                : inscribed_circle" in text and "emitted               : 12/12" in text and "ceiling               : inscribed_circle 120" in text
    rows = lines_of(out / "manifest")
    assert [r["problem_id"] for r in rows] == [f"inscribed_circle_{i:05d}" for i in range(12)] and all(r["seed"] == 3 and r["origin"] == "generated" for r in rows)
    files = sorted(p.name for p in (out / "images").iterdir())
    assert files == [f"inscribed_circle_{i:05d}.png" for i in range(12)] and all((out / r["image_path"]).read_bytes().startswith(b"\x89PNG") for r in rows)
    pictures = spark.createDataFrame([(r["problem_id"], bytearray((out / r["image_path"]).read_bytes())) for r in rows], "problem_id string, image binary")
    joined = records.with_images(spark.createDataFrame(rows, "problem_id string"), pictures)
    assert joined.where("image IS NULL").count() == 0
    assert cli.main(["--family", "inscribed_circle", "--n", "12", "--out", str(out)], spark) == 1  # it is there already
    capsys.readouterr()
    assert cli.main(["--family", "inscribed_circle", "--n", "130", "--out", str(tmp_path / "b"), "--max-draws", "3000"], spark) == 2
    said = capsys.readouterr()
    assert "*** SHORT ***" in said.out and "emitted all 120 of its unique valid combinations; stopping at 120/130 emitted" in said.err and "will emit at most 120" in said.err
    assert cli.main(["--family", "cube", "--out", "x"], spark) == 1 and cli.main(["--list-families"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["--from-file", "x", "--n", "3", "--out", "y"], spark)


GOOD = {"input_id": "a", "family": "composite_rectilinear", "params": {"width": 10, "height": 8, "notch_w": 4, "notch_h": 3}, "expected_answer": "68"}


def test_a_file_to_a_manifest_with_its_sources(spark, tmp_path, capsys):
    rows = [
        GOOD | {"source": {"site": "s", "url": "u", "problem_id": "p7", "original_answer": "68 cm", "retrieved_at": "2024"}}, GOOD | {"input_id": "b"}, GOOD | {"input_id": "c", "params": GOOD["params"] | {"width": 12}, "expected_answer": "67"},
        {"input_id": "d", "family": "inscribed_circle", "params": {"k": 4, "side": 10}, "expected_answer": "100 - 25*pi"}, GOOD | {"input_id": "e", "params": GOOD["params"] | {"notch_w": 10}},
        GOOD | {"input_id": "f", "params": {"width": 10, "height": 8, "notch_w": 9, "notch_h": 3}, "expected_answer": "53"},
    ]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(["", *map(json.dumps, rows[:2]), "   ", *map(json.dumps, rows[2:]), "{not json"]) + "\r\n")
    assert cli.main(["--from-file", str(path), "--out", str(tmp_path / "out")], spark) == 1
    said = capsys.readouterr()
    made = {r["problem_id"]: r for r in lines_of(tmp_path / "out" / "manifest")}
    assert sorted(made) == ["a", "d", "f"]
    assert (made["a"]["source_site"], made["a"]["source_problem_id"], made["a"]["original_answer"], made["a"]["retrieved_at"]) == ("s", "p7", "68 cm", "2024")
    assert made["d"]["source_url"] is None and made["d"]["answer_exact"] == "100 - 25*pi" and made["d"]["origin"] == "structured" and made["d"]["seed"] is None
    assert "emitted               : 3/7   *** INCOMPLETE ***" in said.out and "readability warnings  : 1 rows" in said.out
    assert "PASS  line 2  a [composite_rectilinear]  answer=68" in said.out and "FAIL  line 3  b [composite_rectilinear]  duplicate: same family and params as an earlier row" in said.out
    assert "line 5 c: answer_mismatch: computed 84 = 84" in said.err and "line 9 <no input_id>: input_error: invalid JSON" in said.err
    found = structured.statuses(structured.read_lines(spark, str(path)))
    assert [tuple(r) for r in structured.warning_counts(found).collect()] == [("notch width is of the figure, outside", 1)]
    assert [r.cause for r in structured.rejection_counts(found).collect()] == ["notch is not strictly inside", "invalid JSON"]
    with pytest.raises(ValueError, match="no rows"):
        (tmp_path / "none").write_text("\n \n")
        structured.read_lines(spark, str(tmp_path / "none"))


def test_lines_keep_their_numbers_where_a_file_is_split(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("\n".join(f"line {i}" for i in range(1, 20001)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = structured.read_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(got) == 20000 and all(r.value == f"line {r.line}" for r in got)


# --- pages ----------------------------------------------------------------------------------------
def test_pages(spark):
    head = lambda n, inside="": f"<h5>\\(\\textbf{{{n})}}\\) {inside}</h5>"
    html = (
        '<html><body><article>' + head(1, 'Find the shaded area of it. <img src="https://x/1.png"><div class="sh-link">Show Answer</div><div class="sh-content sh-hide">\\(10\\)</div>')
        + head(2) + '<p><img src="https://x/play.png"><img src="data:,"><a href="https://youtu.be/x">see</a></p>' + head(4, "A question of many words.") + "</article></body></html>"
    )
    pages = spark.createDataFrame([(1, html), (2, "plain")], "page_id long, html string")
    assert [r.area for r in harvest.content_area(pages).orderBy("page_id").collect()] == ["article", None]
    assert harvest.blocks(pages).count() == 0
    found = harvest.blocks(pages, fallback=True)
    got = {r.number: r for r in harvest.layout(found).collect()}
    assert [(got[n].layout, got[n].answer, got[n].image, got[n].hidden, got[n].prompt, got[n].videos) for n in (1, 2, 4)] == [("A", "same block", "url", True, True, 0), ("B", "video only", "lazy stub", False, False, 1), ("B", "none", "none", False, True, 0)]
    assert {r.layout: r.blocks for r in harvest.layout_counts(found).collect()} == {"A": 1, "B": 2}
    s = harvest.survey(found).first()
    assert (s.blocks, s.with_answer, s.video_only, s.neither, s.no_prompt, s.with_diagram, s.lazy_stub, s.single_fetch) == (3, 1, 1, 1, 1, 1, 1, False)
    assert {r.marker: r.n for r in harvest.markers(pages).where("page_id = 1").collect()}["\\("] == 4
    item = spark.sql(r"SELECT 7 AS number, 'Find the area.' AS stem, '\\(\\frac{3}{2}\\pi\\)' AS answer_raw, 'https://x/7.png' AS image_url")
    made = ans.fill_in(harvest.harvested_records(item, "site", "https://site/page")).first()
    assert (made.problem_id, made.image_path, made.origin, made.answer_exact, made.answer_error) == ("site_07", "images/site_07.png", "harvested", "3*pi/2", None)
    assert made.retrieved_at.endswith("+00:00") and made.answer_decimal == pytest.approx(1.5 * math.pi)
    bad = ans.fill_in(harvest.harvested_records(item.withColumn("answer_raw", F.lit("none")), "site", "u")).first()
    assert bad.answer_exact is None and bad.answer_decimal is None and bad.answer_error


# --- the family contract --------------------------------------------------------------------------
def test_contract(spark, tmp_path, monkeypatch):
    with pytest.raises(fam.ContractError, match="'c3'.*checks must take one argument"):
        fam.register(dataclasses.replace(fam.CIRCLE, name="c3", checks=lambda: []))
    with pytest.raises(fam.ContractError, match="'c4'.*spec must be callable"):
        fam.register(dataclasses.replace(fam.CIRCLE, name="c4", spec="no"))
    verdicts = spark.createDataFrame([("true",), ("false",), ("",), ("too thin (0.1)",)], "v string")
    family = dataclasses.replace(fam.CIRCLE, name="c5", params={"v": "integer"}, checks=lambda p: fam.from_verdict(p["v"]))
    assert [(r.v, r.reject_reason, r.reject_key) for r in st.judge(verdicts, family).collect()] == [("true", None, None), ("false", "unspecified", "unspecified"), ("", "unspecified", "unspecified"), ("too thin (0.1)", "too thin (0.1)", "too thin")]
    with pytest.raises(Exception, match="must be true, false or text"):
        st.judge(verdicts.select(F.lit(None).cast("string").alias("v")), family).select("reject_reason").collect()
    package = tmp_path / "plugged"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "_helper.py").write_text("raise RuntimeError('passed by')")
    (package / "mine.py").write_text("import dataclasses\nfrom tessera.operators import families as fam\nMINE = dataclasses.replace(fam.CIRCLE, name='mine')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(fam, "_FAMILIES", dict(fam._FAMILIES))
    assert fam.discover("plugged") == ["mine"] and "mine" in fam.available()


def test_storage_needs_a_shared_folder_on_a_cluster():
    from tessera.operators.storage import shared_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
