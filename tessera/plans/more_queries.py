"""Further registered queries: figures' references, stems, records, hand-entered rows, answers, manifests, pages, drawn runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import answers as ans
from tessera.functions import spec as S
from tessera.functions.regions import measured_spec
from tessera.operators import figure, harvest, images, records, structured
from tessera.operators import stages as st
from tessera.operators.storage import stored
from tessera.plans.queries import _CIRCLE, _COMPOSITE, _COORDINATE, _NESTED, emitted, query


# --- references between a figure's parts ----------------------------------------------------------
def _specs(spark, sf_dir) -> DataFrame:
    """Figures of parts: two shapes and two regions each, one of which names a shape that isn't there."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    shape = lambda i: F.concat(F.lit("s"), (F.col("p_partkey") % 5 + i).cast("string"))
    return t.select(F.col("p_partkey").alias("figure"), F.array(shape(0), shape(1)).alias("shapes"), F.array(F.array(shape(0), shape(1)), F.array(shape(1), F.concat(F.lit("s"), (F.col("p_size") % 7).cast("string")))).alias("regions"))


def references(specs: DataFrame) -> DataFrame:
    """(figure, region, operand, declared): each operand of each region, looked up among its figure's shapes."""
    shapes = specs.select("figure", F.explode("shapes").alias("operand")).distinct().withColumn("declared", F.lit(True))
    operands = specs.select("figure", F.posexplode("regions").alias("region", "of")).select("figure", "region", F.explode("of").alias("operand"))
    return operands.join(shapes, ["figure", "operand"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


_SPECS = """p AS (SELECT p_partkey AS figure, 's' || (p_partkey % 5) AS a, 's' || (p_partkey % 5 + 1) AS b, 's' || (p_size % 7) AS c FROM part),
o AS (SELECT figure, 0 AS region, a AS operand, a, b FROM p UNION ALL SELECT figure, 0, b, a, b FROM p UNION ALL SELECT figure, 1, b, a, b FROM p UNION ALL SELECT figure, 1, c, a, b FROM p)"""


@query(f"WITH {_SPECS} SELECT operand, count(*) AS uses, count(*) FILTER (WHERE operand IN (a, b)) AS declared FROM o GROUP BY 1")
def region_lookup(spark, sf_dir):
    return references(_specs(spark, sf_dir)).groupBy("operand").agg(F.count("*").alias("uses"), F.count_if("declared").alias("declared"))


@query(f"WITH {_SPECS} SELECT figure, CAST(region AS BIGINT) AS region, operand FROM o WHERE operand NOT IN (a, b)")
def region_dangling(spark, sf_dir):
    return references(_specs(spark, sf_dir)).where("NOT declared").select("figure", F.col("region").cast("long").alias("region"), "operand")


# --- stems ----------------------------------------------------------------------------------------
def _leaks(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, records.stem_leak(F.coalesce("text", F.lit(""))).alias("leak")).where("leak IS NOT NULL")


def _leak_sql(table: str, keys: str) -> str:
    shapes, numbers = ("[" + ", ".join(f"'{w}'" for w in sorted(ws)) + "]" for ws in (records.SHAPE_WORDS, records.NUMBER_WORDS))
    return f"""WITH w AS (SELECT {keys}, list_sort(list_distinct(regexp_extract_all(text, '[\\p{{Nd}}\\p{{No}}]'))) AS d,
    list_transform(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda x: lower(regexp_replace(x, '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g'))) AS ws FROM {table}),
    l AS (SELECT {keys}, CASE WHEN len(d) > 0 THEN 'stem contains digits ' || array_to_string(d, '') WHEN len(list_intersect(ws, {numbers})) > 0 THEN 'stem contains number words ' || array_to_string(list_sort(list_intersect(ws, {numbers})), ', ')
    WHEN len(list_intersect(ws, {shapes})) > 0 THEN 'stem names shapes ' || array_to_string(list_sort(list_intersect(ws, {shapes})), ', ') END AS leak FROM w) SELECT * FROM l WHERE leak IS NOT NULL"""


@query(_leak_sql("documents", "doc_id"))
def stem_leak_documents(spark, sf_dir):
    return _leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


@query(_leak_sql("conversations", "conv_id, turn"))
def stem_leak_conversations(spark, sf_dir):
    return _leaks(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")


@query(_leak_sql("benchmark", "item_id"))
def stem_leak_benchmark(spark, sf_dir):
    return _leaks(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")


# --- records --------------------------------------------------------------------------------------
def _records(spark, sf_dir) -> DataFrame:
    """Records of parts, with one field spoiled in most of them by the part's key."""
    k = F.col("p_partkey")
    spoil = lambda i, bad, good: F.when(k % 12 == i, bad).otherwise(good)
    null = F.lit(None)
    return records.record(
        spark.read.parquet(f"{sf_dir}/part.parquet"), problem_id=st.problem_id("part", k), family=F.lit("inscribed_circle"), category=spoil(1, F.lit(3), F.lit(1)), stem=spoil(2, F.lit("Find all 3 sides."), F.lit("Find the area.")),
        image_path=spoil(3, null, F.lit("images/x.png")), answer_exact=spoil(4, F.lit(" "), F.lit("1")), answer_decimal=spoil(5, F.lit(0.0), spoil(6, null.cast("double"), F.col("p_retailprice"))), origin=spoil(7, F.lit("copied"), F.lit("generated")),
        seed=spoil(8, null, F.lit(1)), params=spoil(9, F.lit("[1]"), F.lit('{"k":4,"side":1}')), signature=spoil(10, F.lit(""), F.sha2(k.cast("string"), 256)), generator_version=F.lit("0.2.0"),
    )


_RECORDS = """r AS (SELECT 'part_' || printf('%05d', k) AS problem_id, 'inscribed_circle' AS family, CASE k % 12 WHEN 1 THEN 3 ELSE 1 END AS category, CASE k % 12 WHEN 2 THEN 'Find all 3 sides.' ELSE 'Find the area.' END AS stem, CASE k % 12 WHEN 3 THEN NULL ELSE 'images/x.png' END AS image_path,
CASE k % 12 WHEN 4 THEN ' ' ELSE '1' END AS answer_exact, CASE k % 12 WHEN 5 THEN 0.0 WHEN 6 THEN NULL ELSE price END AS answer_decimal, CASE k % 12 WHEN 7 THEN 'copied' ELSE 'generated' END AS origin, CASE k % 12 WHEN 8 THEN NULL ELSE 1 END AS seed,
CASE k % 12 WHEN 9 THEN '[1]' ELSE '{"k":4,"side":1}' END AS params, CASE k % 12 WHEN 10 THEN '' ELSE sha256(CAST(k AS VARCHAR)) END AS signature, '0.2.0' AS generator_version FROM (SELECT p_partkey AS k, p_retailprice AS price FROM part))"""


@query(f"""WITH {_RECORDS} SELECT coalesce(reason, 'valid') AS outcome, count(*) AS records FROM (SELECT CASE
WHEN origin NOT IN ('generated', 'harvested', 'structured', 'given') THEN 'unknown origin' WHEN category NOT IN (1, 2) THEN 'category must be 1 or 2' WHEN category = 1 AND trim(coalesce(image_path, '')) = '' THEN 'category 1 requires an image_path'
WHEN category = 1 AND regexp_matches(stem, '[0-9]') THEN 'category 1 stem carries geometric information' WHEN category = 2 AND image_path IS NOT NULL THEN 'category 2 must not carry a diagram' WHEN trim(problem_id) = '' THEN 'problem_id must be non-empty' WHEN trim(family) = '' THEN 'family must be non-empty'
WHEN trim(stem) = '' THEN 'stem must be non-empty' WHEN origin = 'generated' AND (seed IS NULL OR params IS NULL OR signature IS NULL OR generator_version IS NULL) THEN 'generated lacks ' || concat_ws(', ', CASE WHEN seed IS NULL THEN 'seed' END, CASE WHEN params IS NULL THEN 'params' END, CASE WHEN signature IS NULL THEN 'signature' END, CASE WHEN generator_version IS NULL THEN 'generator_version' END)
WHEN origin = 'generated' AND trim(signature) = '' THEN 'signature must be non-empty' WHEN trim(coalesce(answer_exact, '')) = '' THEN 'answer_exact must be non-empty' WHEN answer_decimal IS NULL THEN 'answer_decimal must be a real number' WHEN NOT isfinite(answer_decimal) THEN 'answer_decimal must be finite'
WHEN answer_decimal = 0 THEN 'answer_decimal is zero' WHEN json_type(params) <> 'OBJECT' THEN 'params are not a JSON object' END AS reason FROM r) GROUP BY 1""")
def record_validate_counts(spark, sf_dir):
    return _records(spark, sf_dir).select(F.coalesce(records.invalid_reason(), F.lit("valid")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("records"))


# --- hand-entered rows ----------------------------------------------------------------------------
def _structured_lines(spark, sf_dir) -> DataFrame:
    """JSON rows of orders: the derived notched rectangle with its answer, spoiled in some rows."""
    from tessera.sources.derived import composite

    df = composite(spark, sf_dir).repartition("o_orderkey")  # few splits of the table make many rows of JSON to parse
    area = F.col("width") * F.col("height") - F.col("notch_w") * F.col("notch_h")
    k = F.col("o_orderkey")
    return df.select(
        (k + 1).alias("line"),
        F.when(k % 10 == 0, F.lit("{not json")).otherwise(
            F.format_string(
                '{"input_id": "row%d", "family": "%s", "params": {"width": %d, "height": %d, "notch_w": %d, "notch_h": %s}, "expected_answer": "%d"}',
                F.when(k % 10 == 1, k - 1 + F.lit(10**9)).otherwise(k), F.when(k % 10 == 2, "unheard_of").otherwise("composite_rectilinear"), "width", "height", F.when(k % 10 == 3, F.col("width")).otherwise(F.col("notch_w")),
                F.when(k % 10 == 4, F.concat(F.lit('"'), F.col("notch_h").cast("string"), F.lit('"'))).otherwise(F.col("notch_h").cast("string")), F.when(k % 10 == 5, area + 1).otherwise(area),
            )
        ).alias("value"),
    )


@query(f"""WITH {_COMPOSITE}, r AS (SELECT o_orderkey AS k, signature, CASE WHEN o_orderkey % 10 IN (0, 2, 4) THEN 'input_error' WHEN o_orderkey % 10 = 3 THEN 'geometry_rejected' END AS early, o_orderkey % 10 = 5 AS wrong FROM composite_j),
f AS (SELECT *, min(CASE WHEN early IS NULL AND NOT wrong THEN k END) OVER (PARTITION BY early IS NULL, signature) AS first FROM r)
SELECT coalesce(early, CASE WHEN first < k THEN 'duplicate' WHEN wrong THEN 'answer_mismatch' ELSE 'emitted' END) AS status, count(*) AS n FROM f GROUP BY 1""")
def structured_status(spark, sf_dir):
    return structured.statuses(_structured_lines(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_COMPOSITE}, r AS (SELECT o_orderkey AS k, signature, CAST(answer AS BIGINT) AS answer, CASE WHEN o_orderkey % 10 IN (0, 2, 4) THEN 'x' WHEN o_orderkey % 10 = 3 THEN 'x' END AS early, o_orderkey % 10 = 5 AS wrong FROM composite_j),
f AS (SELECT *, min(CASE WHEN early IS NULL AND NOT wrong THEN k END) OVER (PARTITION BY early IS NULL, signature) AS first FROM r)
SELECT 'row' || CASE WHEN k % 10 = 1 THEN k - 1 + 1000000000 ELSE k END AS problem_id, 'structured' AS origin, signature, CAST(answer AS VARCHAR) AS answer_exact, CAST(answer AS VARCHAR) AS expected_answer, 'https://x/' || k AS source_url, CAST(NULL AS VARCHAR) AS source_site, CAST(NULL AS VARCHAR) AS invalid FROM f WHERE early IS NULL AND NOT wrong AND first = k""")
def structured_records(spark, sf_dir):
    """Hand-entered rows to manifest records: own ids, expected answers and sources; none breaks a record's rules."""
    lines = _structured_lines(spark, sf_dir)
    sourced = F.regexp_replace("value", r"\}$", "").eqNullSafe(F.col("value"))
    lines = lines.withColumn("value", F.when(sourced, F.col("value")).otherwise(F.concat(F.regexp_replace("value", r"\}$", ""), F.lit(', "source": {"url": "https://x/'), (F.col("line") - 1).cast("string"), F.lit('"}}'))))
    rows = structured.emitted_records(structured.statuses(lines))
    return rows.select("problem_id", "origin", "signature", "answer_exact", "expected_answer", "source_url", "source_site", records.invalid_reason().alias("invalid"))


@query(f"""WITH {_COMPOSITE}, w AS (SELECT unnest([CASE WHEN NOT (notch_w / width BETWEEN 0.25 AND 0.75) THEN 'notch width is of the figure, outside' END, CASE WHEN NOT (notch_h / height BETWEEN 0.25 AND 0.75) THEN 'notch height is of the figure, outside' END]) AS warning FROM composite WHERE o_orderkey % 10 NOT IN (0, 2, 3, 4))
SELECT warning, count(*) AS n FROM w WHERE warning IS NOT NULL GROUP BY 1""")
def structured_warnings(spark, sf_dir):
    """Readability warnings of hand-entered rows by cause; they don't block."""
    return structured.warning_counts(structured.statuses(_structured_lines(spark, sf_dir)))


# --- answers --------------------------------------------------------------------------------------
def _published(spark, sf_dir) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 0, F.concat(F.lit(r"The area is \( "), size.cast("string"), F.lit(r" \) cm\(^2\)"))).when(k % 4 == 1, F.concat(F.lit(r"\(\dfrac{"), size.cast("string"), F.lit(r"}{2}\pi\)"))).when(k % 4 == 2, F.concat(F.lit(r"\(x="), size.cast("string"), F.lit(r"\) or \(\left(3\right)\)"))).otherwise("none")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", text.alias("text"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '\frac{' || p_size || '}{2}\pi' WHEN 2 THEN 'x=' || p_size || '|(3 )' ELSE '' END AS spans FROM part""")
def answer_spans(spark, sf_dir):
    return _published(spark, sf_dir).select("p_partkey", F.array_join(F.transform(ans.math_spans(F.col("text")), ans.clean_span), "|").alias("spans"))


@query("""SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size / 2 * pi() END, 6) AS value, p_partkey % 4 IN (2, 3) AS failed FROM part""")
def answer_parse_latex(spark, sf_dir):
    df = ans.with_fields(_published(spark, sf_dir), "text", "a", latex=True)
    return df.select("p_partkey", F.round("a.value", 6).alias("value"), F.col("a.error").isNotNull().alias("failed"))


@query("""SELECT p_partkey, round(p_size * sqrt(3) + p_partkey / 4 - 2 ^ 3, 6) AS value FROM part""")
def answer_parse_plain(spark, sf_dir):
    text = F.format_string("%d*sqrt(3) + Rational(%d, 4) - 2^3", "p_size", "p_partkey")
    df = ans.with_fields(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("text")), "text", "a")
    return df.select("p_partkey", F.round("a.value", 6).alias("value"))


# --- manifests ------------------------------------------------------------------------------------
@query(f"""WITH {_NESTED} SELECT count(DISTINCT signature) AS records, 0 AS errors, count(DISTINCT signature) AS same FROM nested_j WHERE reason IS NULL""")
def manifest_roundtrip(spark, sf_dir):
    """Records to JSON lines and back, field for field."""
    df = emitted(spark, sf_dir, "nested_polygons")
    params = F.to_json(F.struct("m", "n", "side_inner", "side_outer"))
    made = records.generated(df, F.lit("nested_polygons"), params, F.lit(0), st.problem_id("nested_polygons", F.col("index")))
    # each record travels with its own line, so both are compared without a join
    back = records.from_line(records.to_line(made.withColumn("a", F.struct(*records.FIELDS)), "a"))
    same = F.lit(True)
    for f in records.FIELDS:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f))
    return back.agg(F.count("*").alias("records"), F.count_if(F.col("error").isNotNull()).cast("int").alias("errors"), F.count_if(same).alias("same"))


# --- pages ----------------------------------------------------------------------------------------
def _paragraphs(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))).alias("number", "inner"))


@query("""SELECT page_id, i AS number, length(ps[i + 1]) AS chars FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ps FROM pages), range(0, 10000) r(i) WHERE i < len(ps)""")
def harvest_blocks(spark, sf_dir):
    """Numbered paragraphs of each page."""
    return _paragraphs(spark, sf_dir).select("page_id", F.col("number").cast("long").alias("number"), F.length("inner").cast("long").alias("chars"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading, regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link, CAST(len(regexp_extract_all(html, '<a href="')) AS BIGINT) AS links FROM pages""")
def harvest_fields(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1).alias("heading"), F.regexp_extract("html", '<a href="([^"]*)"', 1).alias("first_link"), F.regexp_count("html", F.lit('<a href="')).cast("long").alias("links"))


@query("""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS inner_html FROM pages) SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM b WHERE length(inner_html) >= 600)""")
def harvest_skipped(spark, sf_dir):
    """Pages without a paragraph long enough to keep."""
    good = _paragraphs(spark, sf_dir).where(F.length("inner") >= 600).select("page_id").distinct()
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").join(good, "page_id", "left_anti")


@query(r"""WITH h AS (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, page_id FROM pages), s AS (SELECT host, min(page_id) AS low, max(page_id) AS high, count(DISTINCT page_id) AS n FROM h GROUP BY 1)
SELECT host, low, high, high - low + 1 - n AS gaps FROM s""")
def harvest_numbering_gaps(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), "page_id")
    return harvest.gap_counts(pages, "host", "page_id")


# --- figures --------------------------------------------------------------------------------------
def _square(x: float, y: float, side: float) -> list:
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side]]


def _polygon(name: str, points: list) -> dict:
    return {"kind": "polygon", "id": name, "points": points}


def _region(operation: str, *of: str, **more: str) -> dict:
    return {"kind": "region", "operation": operation, "of": list(of), **more}


SPECS = {
    "union": [_polygon("a", _square(0, 0, 4)), _polygon("b", _square(2, 2, 4)), _region("union", "a", "b")],
    "intersection": [_polygon("a", _square(0, 0, 4)), _polygon("b", _square(2, 2, 4)), _region("intersection", "a", "b")],
    "corners": [_polygon("a", _square(0, 0, 4)), _polygon("b", _square(0, 0, 1)), _polygon("c", _square(3, 3, 1)), _region("difference", "a", "b", "c")],
    "length": [_polygon("a", _square(0, 0, 4)), _polygon("b", _square(1, 1, 1)), _region("difference", "a", "b", measure="length")],
    "bowtie": [_polygon("a", [[0, 0], [2, 2], [2, 0], [0, 2]]), _region("union", "a")],
    "dangling": [_polygon("a", _square(0, 0, 4)), _region("union", "b")],
}


def _crossing(spark, sf_dir) -> DataFrame:
    """(figure, n): two rectangles of each order, the second between the first's lines, with their region; equal figures counted before they are measured."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 36).cast("double").alias("a"), (F.col("o_custkey") % 10).cast("double").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    a, b = F.col("a"), F.col("b")
    corners = lambda x, y, w, h: F.array(*[F.array(u, v) for u, v in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
    first, second = corners(F.lit(0.0), F.lit(0.0), 4 + a % 7, 4 + b), corners(a % 5 + 0.5, b % 4 + 0.5, 2 + a % 4, 2 + b % 3)
    pick = lambda *of: F.element_at(F.array(*map(F.lit, of)), (F.col("which") + 1).cast("int"))
    t = t.withColumns({"which": a % 3, "measure": F.when(F.floor(a / 3) % 2 == 0, "area").otherwise("length")}).withColumn("operation", pick("union", "intersection", "difference"))
    region = S.primitive("region", operation=F.col("operation"), of=F.array(F.lit("a"), F.lit("b")), measure=F.col("measure"))
    return t.select("operation", "measure", "n", S.as_json(S.figure(S.polygon("a", first), S.polygon("b", second), region)).alias("figure"))


@query("""WITH r AS (SELECT o_orderkey % 36 AS a, o_custkey % 10 AS b FROM orders), s AS (SELECT a, b, 4 + a % 7 AS w, 4 + b AS h, a % 5 + 0.5 AS x, b % 4 + 0.5 AS y, a % 5 + 2.5 + a % 4 AS x2, b % 4 + 2.5 + b % 3 AS y2 FROM r),
o AS (SELECT *, greatest(0, least(w, x2) - x) AS ox, greatest(0, least(h, y2) - y) AS oy, x2 > w AS px, y2 > h AS py FROM s),
v AS (SELECT a, ox * oy AS common, w * h AS one, (x2 - x) * (y2 - y) AS two, 2 * (w + h) AS l1, 2 * (x2 - x + y2 - y) AS l2,
  CASE WHEN oy > 0 AND ox > 0 THEN (CASE WHEN py THEN ox ELSE 0 END) + (CASE WHEN px THEN oy ELSE 0 END) ELSE 0 END AS in2,
  CASE WHEN oy > 0 AND ox > 0 THEN ox + oy + (CASE WHEN py THEN 0 ELSE ox END) + (CASE WHEN px THEN 0 ELSE oy END) ELSE 0 END AS in1 FROM o)
SELECT CASE a % 3 WHEN 0 THEN 'union' WHEN 1 THEN 'intersection' ELSE 'difference' END AS operation, CASE WHEN a // 3 % 2 = 0 THEN 'area' ELSE 'length' END AS measure,
  CAST(CASE WHEN a // 3 % 2 = 0 THEN CASE a % 3 WHEN 0 THEN one + two - common WHEN 1 THEN common ELSE one - common END ELSE CASE a % 3 WHEN 0 THEN l1 - in2 + l2 - in1 WHEN 1 THEN in1 + in2 ELSE l1 - in2 + in1 END END AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS orders FROM v GROUP BY 1, 2, 3""")
def region_measures(spark, sf_dir):
    """Areas and boundary lengths of unions, intersections and differences of orders' rectangles, by the region measure."""
    found = _crossing(spark, sf_dir).withColumn("m", measured_spec("figure"))
    return found.groupBy("operation", "measure", F.round("m.measured", 6).alias("value")).agg(F.sum("n").alias("orders"))


@query(f"""WITH {_CIRCLE} SELECT DISTINCT k, CAST(side AS BIGINT) AS side, round(k * side + 4096 * 2 * side / (2 * tan(pi() / k)) * sin(pi() / 4096), 6) AS length FROM circle_j""")
def region_lengths(spark, sf_dir):
    """The boundary of each polygon less its inscribed circle, which touches every edge: measured on the figure."""
    df = emitted(spark, sf_dir, "inscribed_circle")
    asked = F.transform("spec", lambda s: F.when(s["kind"] == "region", s.withField("measure", F.lit("length"))).otherwise(s))
    figures = stored(df.select("k", "side", S.as_json(asked).alias("figure")), "figures")  # a Python function takes a plain column
    return figures.select("k", "side", F.round(measured_spec("figure")["measured"], 6).alias("length"))


@F.pandas_udf(T.DoubleType())
def _ink(data: pd.Series) -> pd.Series:
    """How much of a picture is shaded: lines are half of what they bound."""
    def one(x: bytes) -> float:
        grey = images.read_png(x).astype(float)
        return float(np.where(grey < images.SHADE, 0.5, (images.WHITE - grey) / (images.WHITE - images.SHADE)).mean())

    return data.map(one)


@query(f"""WITH {_CIRCLE} SELECT DISTINCT k, CAST(side AS BIGINT) AS side, true AS shaded_right, true AS is_png FROM circle_j""")
def figure_png(spark, sf_dir):
    """The files of all polygons less their circles: the share of shaded pixels is the answer's share of the frame, up to a hundredth of it."""
    df = emitted(spark, sf_dir, "inscribed_circle").drop("stem").withColumn("frame", F.get_json_object(images.scene(F.col("spec")), "$.frame.half").cast("double") * 2)
    made = images.pictures(df, "k", "side", "answer_decimal", "frame")
    off = F.abs(_ink("image") - F.col("answer_decimal") / (F.col("frame") * F.col("frame")))
    return made.select("k", "side", (off < 0.01).alias("shaded_right"), F.startswith(F.hex("image"), F.lit("89504E470D0A1A0A")).alias("is_png"))


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 51 AS depth, o_totalprice AS price, o_orderkey % 5 AS kind FROM orders),
n AS (SELECT *, CASE kind WHEN 0 THEN '["n","1361129467683753853853498429727072845824.000000"]' WHEN 1 THEN '["n","' || printf('%.6f', price) || '"]' WHEN 2 THEN '["s","' || o_orderkey || '"]' WHEN 3 THEN '["b",true],["z",null]' END AS inner_ FROM v)
SELECT o_orderkey, CASE WHEN kind < 4 THEN sha256('any' || chr(0) || repeat('["l",[', depth + 1) || inner_ || repeat(']]', depth + 1)) END AS signature, CASE WHEN kind = 4 THEN 'an object within a value can''t be signed' END AS unsigned FROM n""")
def signatures_of_any_value(spark, sf_dir):
    """Signatures of JSON lists up to 51 deep around numbers of 40 digits, prices, texts, true and null; objects in them have a reason instead."""
    key = F.col("o_orderkey")
    inner = F.element_at(F.array(F.lit("1361129467683753853853498429727072845824"), F.format_string("%.2f", "o_totalprice"), F.concat(F.lit('"'), key.cast("string"), F.lit('"')), F.lit("true , null"), F.lit('{"a": 1}')), (key % 5 + 1).cast("int"))
    depth = (key % 51 + 1).cast("int")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.repeat(F.lit("["), depth), inner, F.repeat(F.lit("]"), depth)).alias("value"))
    return st.signed_values(df, "value", F.lit("any")).select("o_orderkey", "signature", "unsigned")


_N = lambda x: f"printf('%.4f', round({x}, 4) + 0.0)"  # noqa: E731  a number of a figure's text
_OUTLINE = "'M0.0000 ' || " + " || ".join(["'0.0000L'", _N("width"), "' 0.0000L'", _N("width"), "' '", _N("notch_h - height"), "'L'", _N("width - notch_w"), "' '", _N("notch_h - height"), "'L'", _N("width - notch_w"), "' '", _N("-height"), "'L0.0000 '", _N("-height"), "'Z'"])
_TEXTS = " || ".join(f"""'<text x="' || {_N(x)} || '" y="' || {_N(y)} || '">' || {t} || '</text>'""" for x, y, t in (("width / 2", "g", "width"), ("width - notch_w / 2", "notch_h - height - g", "notch_w"), ("width - notch_w + g", "notch_h / 2 - height", "notch_h"), ("-g", "-height / 2", "height")))


@query(f"""WITH {_COMPOSITE}, f AS (SELECT *, 0.03 * greatest(width, height) AS g FROM composite_j WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ord) = 1),
b AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS idx, greatest(width, width - notch_w + g) AS rgt, greatest(height, height - notch_h + g) AS top FROM f),
v AS (SELECT *, (rgt - g) / 2 AS cx, (top - g) / 2 AS cy, greatest(rgt + g, top + g) / 2 * 1.14 AS half FROM b)
SELECT 'composite_rectilinear_' || printf('%05d', idx) AS problem_id, '<svg xmlns="http://www.w3.org/2000/svg" width="400" height="400" viewBox="' || {_N("cx - half")} || ' ' || {_N("-(cy + half)")} || ' ' || {_N("half * 2")} || ' ' || {_N("half * 2")} || '"><path class="shaded" fill-rule="nonzero" d="' || {_OUTLINE} || '"/><path class="outline" d="' || {_OUTLINE} || '"/>' || {_TEXTS} || '</svg>' AS svg FROM v""")
def figure_svg(spark, sf_dir):
    """The notched rectangles' figures as text."""
    df = emitted(spark, sf_dir, "composite_rectilinear")
    return df.select(st.problem_id("composite_rectilinear", F.col("index")).alias("problem_id"), figure.render(F.col("spec")).alias("svg"))


@query(f"""WITH {_NESTED}, f AS (SELECT DISTINCT signature, n, m FROM nested_j WHERE reason IS NULL) SELECT 'nested_polygons' AS family, count(*) AS figures, CAST(sum(n + m) AS BIGINT) AS labels, CAST(0 AS BIGINT) AS dots, CAST(0 AS BIGINT) AS grids, CAST(0 AS BIGINT) AS faults FROM f
UNION ALL (WITH {_CIRCLE} SELECT 'inscribed_circle', count(*), CAST(sum(k) AS BIGINT), 0, 0, 0 FROM (SELECT DISTINCT signature, k FROM circle_j))
UNION ALL (WITH {_COORDINATE} SELECT 'coordinate_polygon', count(*), count(*) * 2, CAST(sum(corners) AS BIGINT), count(*), 0 FROM (SELECT DISTINCT signature, corners FROM coordinate_j WHERE reason IS NULL))""")
def figure_parts(spark, sf_dir):
    """Labels, marked points and grids that the figures of the other families show, and how many can't be drawn."""
    out = None
    for name in ("nested_polygons", "inscribed_circle", "coordinate_polygon"):
        df = emitted(spark, sf_dir, name).select(figure.render(F.col("spec")).alias("s"), figure.render_fault(F.col("spec")).alias("f"))
        n = lambda what: F.sum(F.regexp_count("s", F.lit(what))).cast("long")
        one = df.agg(F.lit(name).alias("family"), F.count("*").alias("figures"), n("<text ").alias("labels"), n('class="dot"').alias("dots"), n('class="grid"').alias("grids"), F.count("f").alias("faults"))
        out = one if out is None else out.unionByName(one)
    return out


# --- pages in the source's layout -----------------------------------------------------------------
def _problem_pages(spark, sf_dir) -> DataFrame:
    """Pages whose paragraphs, with their own HTML, are numbered blocks of the source's layout: by the paragraph's number some lack an answer, an
    image, or both, and one in seven repeats a number. Answers lie in elements within elements, comments hold tags, and a numbered header follows the content."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)).alias("ps"))
    number = lambda i: F.when(i % 7 == 6, i).otherwise(i + 1).cast("string")
    said = lambda i: F.concat(F.lit(r'<div class="sh-link">Show <div>Answer</div></div><!-- </div></h5> --><div class="box sh-content sh-hide"><div><div>\('), (i * 10).cast("string"), F.lit(r"\)</div> cm&sup2;</div> &lt;exact&gt;</div>"))
    answer = lambda i: F.when(i % 3 != 2, said(i)).otherwise("")
    image = lambda i: F.when(i % 4 == 3, '<p><img src="data:x" data-src="y"></p>').otherwise(F.concat(F.lit('<div><p><a href="https://youtu.be/x"><img src="https://x/play.png"></a></div><div><img src="https://x/'), i.cast("string"), F.lit('.png"></p></div>')))
    block = lambda x, i: F.concat(F.lit(r"<h5 id='q'>\(\textbf{"), number(i), F.lit(r")}\) Question on "), x, answer(i), F.lit("</h5>"), image(i))
    area = F.when(F.col("page_id") % 10 != 9, '<!-- <div class="entry-content"> --><div class="post entry-content">').otherwise('<div class="other">')
    return p.select("page_id", F.concat(F.lit("<html><body><div>"), area, F.array_join(F.transform("ps", block), ""), F.lit(r'</div><h5>\(\textbf{999)}\) Behind the content</h5><p><img src="https://x/999.png"></p></div></body></html>')).alias("html"))


_PAGES = """ps AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ps FROM pages), x AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(ps[i + 1], '<[^>]*>', ' ', 'g'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\\s\\x{A0}]+', ' ', 'g')) AS words, CASE WHEN i % 7 = 6 THEN i ELSE i + 1 END AS number, i % 3 <> 2 AS answered, i % 4 <> 3 AS pictured FROM ps, range(0, 10000) r(i) WHERE i < len(ps) AND page_id % 10 <> 9),
h AS (SELECT * FROM x WHERE i % 7 <> 6), t AS (SELECT h.*, h.answered OR coalesce(n.answered, false) AS any_answer, CASE WHEN h.answered THEN h.i WHEN n.answered THEN n.i END AS said, h.pictured OR coalesce(n.pictured, false) AS any_picture, CASE WHEN h.pictured THEN h.i WHEN n.pictured THEN n.i END AS shown, h.pictured OR coalesce(n.pictured, false) AS video,
  h.pictured AS first_pictured, n.i IS NOT NULL AS longer, coalesce(n.answered, false) AS second_answered FROM h LEFT JOIN x n ON h.page_id = n.page_id AND n.i = h.i + 1 AND n.i % 7 = 6)"""


@query(f"""WITH {_PAGES} SELECT page_id, CAST(number AS INT) AS number, trim('Question on ' || words) AS stem, CASE WHEN any_answer THEN '\\(' || said * 10 || '\\) cm² <exact>' END AS answer_raw, CASE WHEN any_picture THEN 'https://x/' || shown || '.png' END AS image_url, any_answer AND any_picture AS harvestable FROM t""")
def harvest_block_fields(spark, sf_dir):
    """Stem, answer and image of each numbered block, by the harvest operators."""
    return harvest.fields(harvest.blocks(_problem_pages(spark, sf_dir), numbered=harvest.ANY_NUMBER), harvest.ANY_NUMBER).drop("html")


@query(f"""WITH {_PAGES}, g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY number) AS r FROM t WHERE any_answer AND any_picture)
SELECT 'andymath_' || printf('%02d', number) AS problem_id, CAST(page_id AS VARCHAR) AS source_url, trim('Question on ' || words) AS stem, 'images/andymath_' || printf('%02d', number) || '.png' AS image_path, '\\(' || said * 10 || '\\) cm² <exact>' AS original_answer, CASE WHEN said > 0 THEN CAST(said * 10 AS VARCHAR) ELSE '0' END AS answer_exact, CAST(said * 10 AS DOUBLE) AS answer_decimal FROM g WHERE r <= 10""".replace("andymath", "site"))
def harvest_records(spark, sf_dir):
    """The first ten harvestable blocks of each page as manifest records, their answers filled in."""
    found = harvest.harvest(_problem_pages(spark, sf_dir), numbered=harvest.ANY_NUMBER)
    rows = ans.fill_in(harvest.harvested_records(found, "site", F.col("page_id").cast("string"), "2024-01-01T00:00:00+00:00"))
    return rows.select("problem_id", "source_url", "stem", "image_path", "original_answer", "answer_exact", "answer_decimal")


@query(f"WITH {_PAGES} SELECT page_id, CAST(number AS INT) AS number FROM t WHERE NOT (any_answer AND any_picture)")
def harvest_unusable(spark, sf_dir):
    """Numbered blocks that can't be harvested."""
    return harvest.skipped(_problem_pages(spark, sf_dir), harvest.ANY_NUMBER)


@query(f"""WITH {_PAGES} SELECT page_id, count(*) AS blocks, count(*) FILTER (WHERE any_answer) AS with_answer, count(*) FILTER (WHERE NOT any_answer AND video) AS video_only, count(*) FILTER (WHERE NOT any_answer AND NOT video) AS neither, CAST(0 AS BIGINT) AS no_prompt,
count(*) FILTER (WHERE first_pictured) AS with_diagram, count(*) FILTER (WHERE NOT first_pictured) AS lazy_stub, count(*) FILTER (WHERE first_pictured) = count(*) AS single_fetch FROM t GROUP BY 1""")
def harvest_survey(spark, sf_dir):
    """What the pages' blocks hold: answers, videos, prompts, diagrams."""
    return harvest.survey(harvest.blocks(_problem_pages(spark, sf_dir), numbered=harvest.ANY_NUMBER), harvest.ANY_NUMBER)


@query(r"""SELECT marker, CAST(sum((length(html) - length(replace(html, marker, ''))) // length(marker)) AS BIGINT) AS n FROM pages, (VALUES ('\('), ('\['), ('$$'), ('latex'), ('MathJax'), ('katex')) m(marker) GROUP BY 1""")
def harvest_markers(spark, sf_dir):
    """Traces of formulas in the pages as they are."""
    return harvest.markers(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).groupBy("marker").agg(F.sum("n").alias("n"))


@query("""SELECT CASE WHEN html LIKE '%class="entry-content"%' THEN 'entry-content' WHEN regexp_matches(html, '<article[\\s>]') THEN 'article' WHEN regexp_matches(html, '<main[\\s>]') THEN 'main' WHEN regexp_matches(html, '<div[^>]*class="[^"]*\\bpost-content\\b') THEN 'post-content' WHEN regexp_matches(html, '<div[^>]*class="[^"]*\\bcontent\\b') THEN 'content' WHEN regexp_matches(html, '<body[\\s>]') THEN 'body' END AS area, count(*) AS pages FROM pages GROUP BY 1""")
def harvest_areas(spark, sf_dir):
    """Which content area the pages have."""
    return harvest.content_area(spark.read.parquet(f"{sf_dir}/pages.parquet")).groupBy("area").agg(F.count("*").alias("pages"))
