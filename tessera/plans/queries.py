"""The registered queries of the geometry-problem engine and their SQL.

Problems come from the tables by the formulas of sources/derived.py. Every output column is cast, and
doubles are rounded to six places, so that both engines give the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import spec as S
from tessera.operators import families as fam
from tessera.operators import stages as st
from tessera.operators.ordinals import numbered
from tessera.operators.scans import Fold, scan
from tessera.operators.storage import stored
from tessera.sources import derived as src

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- the derived tables and rules in SQL ----------------------------------------------------------
_NESTED = """
nested AS (SELECT *, 1 + l_orderkey % 20 AS side_inner, 3 + l_suppkey % (n - 3) AS m FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 4 + l_partkey % 9 AS n, 1 + CAST(trunc(l_quantity) AS BIGINT) % 20 AS side_outer FROM lineitem)),
nested_r AS (SELECT *, (side_inner / (2 * sin(pi() / m))) / (side_outer / (2 * tan(pi() / n))) AS ratio FROM nested),
nested_j AS (SELECT *, CASE WHEN m >= n THEN 'inner side count is not less than outer' WHEN ratio > 0.9 THEN 'inner polygon does not fit with clearance'
  WHEN ratio < 0.15 THEN 'inner polygon too small to read' END AS reason,
  sha256('nested_polygons' || chr(0) || '[["m",["n","' || m || '.000000"]],["n",["n","' || n || '.000000"]],["side_inner",["n","' || side_inner || '.000000"]],["side_outer",["n","' || side_outer || '.000000"]]]') AS signature,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord,
  n / 4.0 * side_outer * side_outer / tan(pi() / n) - m / 4.0 * side_inner * side_inner / tan(pi() / m) AS answer FROM nested_r)"""
_CIRCLE = """
circle AS (SELECT p_partkey, 3 + p_partkey % 6 AS k, 1 + p_size % 20 AS side FROM part),
circle_j AS (SELECT *, CAST(NULL AS VARCHAR) AS reason, sha256('inscribed_circle' || chr(0) || '[["k",["n","' || k || '.000000"]],["side",["n","' || side || '.000000"]]]') AS signature,
  p_partkey AS ord, k / 4.0 * side * side / tan(pi() / k) - pi() * pow(side / (2 * tan(pi() / k)), 2) AS answer FROM circle)"""
_COMPOSITE = """
composite AS (SELECT *, 1 + t % (width - 1) AS notch_w, 1 + (t // 7) % (height - 1) AS notch_h FROM (
  SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS t, 4 + o_orderkey % 17 AS width, 4 + o_custkey % 17 AS height FROM orders)),
composite_j AS (SELECT *, CASE WHEN NOT (notch_w / width BETWEEN 0.25 AND 0.75) THEN 'notch width is of the figure, outside'
  WHEN NOT (notch_h / height BETWEEN 0.25 AND 0.75) THEN 'notch height is of the figure, outside' END AS reason,
  sha256('composite_rectilinear' || chr(0) || '[["height",["n","' || height || '.000000"]],["notch_h",["n","' || notch_h || '.000000"]],["notch_w",["n","' || notch_w || '.000000"]],["width",["n","' || width || '.000000"]]]') AS signature,
  o_orderkey AS ord, CAST(width * height - notch_w * notch_h AS DOUBLE) AS answer FROM composite)"""
_COORDINATE = """
marks AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) % 13 - 6 AS x, CAST(props->>'$.k' AS BIGINT) % 13 - 6 AS y,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS grp FROM events),
corner AS (SELECT user_id, grp, x, y, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, grp) AS c FROM marks),
ring AS (SELECT a.*, b.x AS x2, b.y AS y2, d.x AS x3, d.y AS y3 FROM corner a JOIN corner b ON a.user_id = b.user_id AND a.grp = b.grp AND b.i = (a.i + 1) % a.c
  JOIN corner d ON a.user_id = d.user_id AND a.grp = d.grp AND d.i = (a.i + 2) % a.c WHERE a.c >= 3),
turned AS (SELECT *, (x2 - x) * (y3 - y2) - (y2 - y) * (x3 - x2) AS turn, (x2 - x) * (x3 - x2) + (y2 - y) * (y3 - y2) AS ahead FROM ring),
meets AS (SELECT a.user_id, a.grp, bool_or(
    (sign((a.x2-a.x)*(b.y-a.y)-(a.y2-a.y)*(b.x-a.x)) <> sign((a.x2-a.x)*(b.y2-a.y)-(a.y2-a.y)*(b.x2-a.x)) AND sign((b.x2-b.x)*(a.y-b.y)-(b.y2-b.y)*(a.x-b.x)) <> sign((b.x2-b.x)*(a.y2-b.y)-(b.y2-b.y)*(a.x2-b.x)))
    OR ((a.x2-a.x)*(b.y-a.y)-(a.y2-a.y)*(b.x-a.x) = 0 AND b.x BETWEEN least(a.x,a.x2) AND greatest(a.x,a.x2) AND b.y BETWEEN least(a.y,a.y2) AND greatest(a.y,a.y2))
    OR ((a.x2-a.x)*(b.y2-a.y)-(a.y2-a.y)*(b.x2-a.x) = 0 AND b.x2 BETWEEN least(a.x,a.x2) AND greatest(a.x,a.x2) AND b.y2 BETWEEN least(a.y,a.y2) AND greatest(a.y,a.y2))
    OR ((b.x2-b.x)*(a.y-b.y)-(b.y2-b.y)*(a.x-b.x) = 0 AND a.x BETWEEN least(b.x,b.x2) AND greatest(b.x,b.x2) AND a.y BETWEEN least(b.y,b.y2) AND greatest(b.y,b.y2))
    OR ((b.x2-b.x)*(a.y2-b.y)-(b.y2-b.y)*(a.x2-b.x) = 0 AND a.x2 BETWEEN least(b.x,b.x2) AND greatest(b.x,b.x2) AND a.y2 BETWEEN least(b.y,b.y2) AND greatest(b.y,b.y2))) AS meet
  FROM ring a JOIN ring b ON a.user_id = b.user_id AND a.grp = b.grp AND b.i >= a.i + 2 AND NOT (a.i = 0 AND b.i = a.c - 1) GROUP BY 1, 2),
coordinate AS (SELECT t.user_id, t.grp, any_value(c) AS corners, count(DISTINCT x * 100 + y) = any_value(c) AS apart, abs(sum(x * y2 - x2 * y)) / 2.0 AS area,
  bool_or(turn = 0 AND ahead < 0) AS back, bool_and(turn > 0) OR bool_and(turn < 0) AS convex, bool_or(NOT (x BETWEEN -6 AND 6 AND y BETWEEN -6 AND 6)) AS outside,
  coalesce(any_value(m.meet), false) AS meet, string_agg('["l",[["n","' || x || '.000000"],["n","' || y || '.000000"]]]', ',' ORDER BY i) AS points
  FROM turned t LEFT JOIN meets m ON t.user_id = m.user_id AND t.grp = m.grp GROUP BY 1, 2),
coordinate_j AS (SELECT *, area AS answer, row_number() OVER (ORDER BY user_id, grp) AS ord, CASE WHEN NOT apart THEN 'duplicate vertices' WHEN outside THEN 'vertex'
  WHEN area = 0 OR back OR meet OR NOT convex THEN 'vertices are collinear or wind inconsistently' WHEN area < 6 THEN 'area is below the readable minimum of' END AS reason,
  sha256('coordinate_polygon' || chr(0) || '[["points",["l",[' || points || ']]]]') AS signature FROM coordinate)"""
_ALL = f"""WITH {_NESTED}, {_CIRCLE}, {_COMPOSITE}, {_COORDINATE}, problems AS (
  SELECT 'nested_polygons' AS family, 3 AS turn, ord, reason, signature, answer FROM nested_j UNION ALL SELECT 'inscribed_circle', 2, row_number() OVER (ORDER BY ord), reason, signature, answer FROM circle_j
  UNION ALL SELECT 'composite_rectilinear', 0, row_number() OVER (ORDER BY ord), reason, signature, answer FROM composite_j UNION ALL SELECT 'coordinate_polygon', 1, ord, reason, signature, answer FROM coordinate_j),
firsts AS (SELECT *, reason IS NULL AND row_number() OVER (PARTITION BY family, signature, reason IS NULL ORDER BY ord) = 1 AS em FROM problems)"""

_SOURCES = {"nested_polygons": (fam.NESTED, src.nested, src.NESTED_ORDER), "inscribed_circle": (fam.CIRCLE, src.circle, src.CIRCLE_ORDER), "composite_rectilinear": (fam.COMPOSITE, src.composite, src.COMPOSITE_ORDER), "coordinate_polygon": (fam.COORDINATE, src.coordinate, src.COORDINATE_ORDER)}


def source(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """The derived table of a family: its order's columns and its parameters, and nothing else."""
    f, make, order = _SOURCES[family]
    return make(spark, sf_dir).select(*order, *[c for c in f.params if c not in order])


def judged_sets(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Each distinct parameter set of a derived table with its draws, judged and signed."""
    f = _SOURCES[family][0]
    return st.sign(st.judge(st.sets(source(spark, sf_dir, family), f), f), f)


def emitted(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """The first row of each valid signature, solved; index: dense in source order."""
    f, _, order = _SOURCES[family]
    valid = st.judge(st.sets(source(spark, sf_dir, family), f, order), f).where("reject_code IS NULL")
    firsts = st.sign(valid, f).groupBy("signature").agg(F.min_by(F.struct(*f.params), "first").alias("p"), F.min("first").alias("first"))
    firsts = numbered(firsts, ["first"], "index", 0)
    if f.space is not None:  # no more rows than the space has: few enough to end up in one task, so they are dealt out
        firsts = firsts.repartition(spark.sparkContext.defaultParallelism, "signature")
    return st.solve(firsts.select("signature", "index", "p.*"), f)


def ordered(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """A derived table with ord, a draw's number in its family: the order of a run is one sequence by definition."""
    f, _, order = _SOURCES[family]
    return numbered(source(spark, sf_dir, family), order).select("ord", *f.params)


def first_ords(draws: DataFrame, family: fam.Family) -> DataFrame:
    """(signature, ord) of the draws that are emitted: the first of each valid signature."""
    valid = st.judge(st.sets(draws, family, ["ord"]), family).where("reject_code IS NULL")
    return st.sign(valid, family).groupBy("signature").agg(F.min("first").alias("ord"))


def problems(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The first `most` draws of each derived table as (family, turn, ord, reject_reason, signature, is_first)."""
    out = None
    for turn, name in enumerate(sorted(_SOURCES)):
        f = _SOURCES[name][0]
        df = st.sign(st.judge(ordered(spark, sf_dir, name).where(F.col("ord") <= most), f), f)
        df = st.first_of_signature(df, ["ord"], F.col("reject_code").isNull())
        one = df.select(F.lit(name).alias("family"), F.lit(turn).alias("turn"), "ord", "reject_reason", "signature", "is_first")
        out = one if out is None else out.unionByName(one)
    return out


# --- ceilings -------------------------------------------------------------------------------------
def ceiling(spark: SparkSession, family: fam.Family, precision: int = 6) -> DataFrame:
    """How many distinct valid problems a family has, counted over its whole space."""
    if family.space is None:
        return spark.createDataFrame([(family.name, None, None)], "family string, raw long, ceiling long")
    df = st.sign(st.judge(family.space(spark), family), family, precision)
    return df.agg(F.lit(family.name).alias("family"), F.count("*").alias("raw"), F.countDistinct(F.when(F.col("reject_code").isNull(), F.col("signature"))).alias("ceiling"))


def seen_of_space(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """A family's ceiling, how many of its valid problems a derived table holds, and how many are left to find."""
    f = _SOURCES[family][0]
    seen = judged_sets(spark, sf_dir, family).where("reject_code IS NULL").agg(F.countDistinct("signature").alias("seen"))
    return ceiling(spark, f).crossJoin(F.broadcast(seen)).withColumn("left", F.col("ceiling") - F.col("seen"))  # one row each


def _seen_sql(space: str, cte: str, table: str) -> str:
    return f"WITH {cte}, s AS ({space}), d AS (SELECT count(DISTINCT signature) AS seen FROM {table} WHERE reason IS NULL) SELECT s.*, seen, ceiling - seen AS \"left\" FROM s, d"


@query(_seen_sql("""SELECT 'nested_polygons' AS family, count(*) AS raw, count(*) FILTER (WHERE r BETWEEN 0.15 AND 0.9) AS ceiling FROM
(SELECT (si / (2 * sin(pi() / m))) / (so / (2 * tan(pi() / n))) AS r FROM range(4, 13) a(n), range(3, 12) b(m), range(1, 21) c(so), range(1, 21) d(si) WHERE m < n)""", _NESTED, "nested_j"))
def ceiling_nested(spark, sf_dir):
    return seen_of_space(spark, sf_dir, "nested_polygons")


@query(_seen_sql("SELECT 'inscribed_circle' AS family, count(*) AS raw, count(*) FILTER (WHERE 1 - pi() / (k * tan(pi() / k)) >= 0.05) AS ceiling FROM range(3, 9) a(k), range(1, 21) b(side)", _CIRCLE, "circle_j"))
def ceiling_circle(spark, sf_dir):
    return seen_of_space(spark, sf_dir, "inscribed_circle")


@query(_seen_sql("""SELECT 'composite_rectilinear' AS family, count(*) AS raw, count(*) FILTER (WHERE x / w BETWEEN 0.25 AND 0.75 AND y / h BETWEEN 0.25 AND 0.75) AS ceiling
FROM range(4, 21) a(w), range(4, 21) b(h), range(1, 20) c(x), range(1, 20) d(y) WHERE x < w AND y < h""", _COMPOSITE, "composite_j"))
def ceiling_composite(spark, sf_dir):
    return seen_of_space(spark, sf_dir, "composite_rectilinear")


# --- funnels --------------------------------------------------------------------------------------
def funnel(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Draws by outcome: accepted or the reason's key, with their share."""
    df = judged_sets(spark, sf_dir, family).select(F.coalesce("reject_key", F.lit("accepted")).alias("outcome"), "signature", "draws")
    by = df.groupBy("outcome", "signature").agg(F.sum("draws").alias("draws"))
    counts = by.groupBy("outcome").agg(F.sum("draws").alias("draws"), F.count("*").alias("problems"))
    total = counts.agg(F.sum("draws").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("outcome", "draws", "problems", F.round(F.col("draws") / F.col("total"), 6).alias("share"))


def _funnel_sql(cte: str, table: str) -> str:
    return f"""WITH {cte} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS draws, count(DISTINCT signature) AS problems,
    round(count(*) / (SELECT count(*) FROM {table}), 6) AS share FROM {table} GROUP BY 1"""


@query(_funnel_sql(_NESTED, "nested_j"))
def nested_validity_funnel(spark, sf_dir):
    return funnel(spark, sf_dir, "nested_polygons")


@query(_funnel_sql(_COMPOSITE, "composite_j"))
def composite_funnel(spark, sf_dir):
    return funnel(spark, sf_dir, "composite_rectilinear")


@query(_funnel_sql(_COORDINATE, "coordinate_j"))
def coordinate_funnel(spark, sf_dir):
    return funnel(spark, sf_dir, "coordinate_polygon")


# --- emitted problems -----------------------------------------------------------------------------
def _emit(df: DataFrame, family: str, *columns: str) -> DataFrame:
    return df.select(st.problem_id(family, F.col("index")).alias("problem_id"), "signature", *columns, F.round("answer_decimal", 6).alias("answer_decimal"))


def _emit_sql(cte: str, table: str, family: str, order: str, columns: str) -> str:
    return f"""WITH {cte}, f AS (SELECT * FROM {table} WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY signature ORDER BY {order}) = 1)
    SELECT '{family}_' || printf('%05d', row_number() OVER (ORDER BY {order}) - 1) AS problem_id, signature, {columns}, round(answer, 6) AS answer_decimal FROM f"""


@query(_emit_sql(_NESTED, "nested_j", "nested_polygons", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity", "n, m, side_outer, side_inner"))
def nested_emit(spark, sf_dir):
    return _emit(emitted(spark, sf_dir, "nested_polygons"), "nested_polygons", "n", "m", "side_outer", "side_inner")


@query(_emit_sql(_CIRCLE, "circle_j", "inscribed_circle", "p_partkey", "k, CAST(side AS BIGINT) AS side"))
def circle_emit(spark, sf_dir):
    return _emit(emitted(spark, sf_dir, "inscribed_circle"), "inscribed_circle", "k", "side")


@query(_emit_sql(_COMPOSITE, "composite_j", "composite_rectilinear", "o_orderkey", "width, height, notch_w, notch_h, CAST(CAST(answer AS BIGINT) AS VARCHAR) AS answer_exact"))
def composite_emit(spark, sf_dir):
    return _emit(emitted(spark, sf_dir, "composite_rectilinear"), "composite_rectilinear", "width", "height", "notch_w", "notch_h", "answer_exact")


@query(_emit_sql(_COORDINATE, "coordinate_j", "coordinate_polygon", "user_id, grp", "CAST(corners AS BIGINT) AS corners, CASE WHEN answer = floor(answer) THEN CAST(CAST(answer AS BIGINT) AS VARCHAR) ELSE CAST(CAST(answer * 2 AS BIGINT) AS VARCHAR) || '/2' END AS answer_exact"))
def coordinate_polygons(spark, sf_dir):
    return _emit(emitted(spark, sf_dir, "coordinate_polygon").withColumn("corners", F.size("points").cast("long")), "coordinate_polygon", "corners", "answer_exact")


@query(f"""WITH {_NESTED}, f AS (SELECT * FROM nested_j WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ord) = 1)
SELECT signature, CAST((CASE n WHEN 4 THEN 4 WHEN 8 THEN 8 WHEN 12 THEN 24 ELSE 0 END) * side_outer ** 2 - (CASE m WHEN 4 THEN 4 WHEN 8 THEN 8 ELSE 0 END) * side_inner ** 2 AS BIGINT) AS quarters,
CAST((CASE n WHEN 8 THEN 8 ELSE 0 END) * side_outer ** 2 - (CASE m WHEN 8 THEN 8 ELSE 0 END) * side_inner ** 2 AS BIGINT) AS quarters_sqrt2,
CAST((CASE n WHEN 6 THEN 6 WHEN 12 THEN 12 ELSE 0 END) * side_outer ** 2 - (CASE m WHEN 3 THEN 1 WHEN 6 THEN 6 ELSE 0 END) * side_inner ** 2 AS BIGINT) AS quarters_sqrt3,
CAST(CASE WHEN n IN (3, 4, 6, 8, 12) THEN 0 ELSE n * side_outer ** 2 END AS BIGINT) AS quarters_outer, CAST(CASE WHEN m IN (3, 4, 6, 8, 12) THEN 0 ELSE -m * side_inner ** 2 END AS BIGINT) AS quarters_inner FROM f""")
def nested_exact_terms(spark, sf_dir):
    """Exact answers as quarters of 1, sqrt(2) and sqrt(3) and, for other side counts, of the cotangents of the outer and the inner polygon."""
    df = emitted(spark, sf_dir, "nested_polygons")
    df = df.withColumn("t", fam.NESTED.terms(fam.NESTED.columns(df)))
    part = lambda b: F.coalesce(F.get(F.transform(F.filter("t", lambda t: t["basis"] == b), lambda t: (t["num"] * 4 / t["den"]).cast("long")), F.lit(0)), F.lit(0)).cast("long")
    cot = lambda k: F.concat(F.lit("cot(pi/"), F.col(k).cast("string"), F.lit(")"))
    return df.select("signature", part("1").alias("quarters"), part("sqrt(2)").alias("quarters_sqrt2"), part("sqrt(3)").alias("quarters_sqrt3"), part(cot("n")).alias("quarters_outer"), part(cot("m")).alias("quarters_inner"))


# --- geometry checks ------------------------------------------------------------------------------
@query(f"""WITH {_NESTED}, d AS (SELECT DISTINCT n, m, side_outer AS so, side_inner AS si FROM nested),
o AS (SELECT d.*, i, so / (2 * sin(pi() / n)) AS r, pi() / n - pi() / 2 + i * 2 * pi() / n AS t, pi() / n - pi() / 2 + ((i + 1) % n) * 2 * pi() / n AS u FROM d, range(0, 12) s(i) WHERE i < n),
p AS (SELECT o.*, si / (2 * sin(pi() / m)) AS q, pi() / m - pi() / 2 + j * 2 * pi() / m AS v FROM o, range(0, 12) z(j) WHERE j < m)
SELECT n, m, so AS side_outer, si AS side_inner, NOT bool_or((r*cos(u) - r*cos(t)) * (q*sin(v) - r*sin(t)) - (r*sin(u) - r*sin(t)) * (q*cos(v) - r*cos(t)) < -1e-9 * r * r) AS fits FROM p GROUP BY ALL""")
def nested_inner_fits(spark, sf_dir):
    """Containment of each distinct pair of polygons by one distance; the SQL holds every corner against every edge."""
    df = src.nested(spark, sf_dir).select("n", "m", "side_outer", "side_inner").distinct()
    return df.select("*", fam.inner_fits(fam.NESTED.columns(df)).alias("fits"))


def _verified(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("problems"), F.count_if("verified").alias("verified"), F.round(F.coalesce(F.max("rel_diff"), F.lit(0.0)), 8).alias("worst"))


def _verify(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    return _verified(st.measure(emitted(spark, sf_dir, family)))


@query(f"""WITH {_CIRCLE}, f AS (SELECT DISTINCT k, side, answer FROM circle_j), g AS (SELECT *, k / 4.0 * side * side / tan(pi() / k) - pow(side / (2 * tan(pi() / k)), 2) * 2048 * sin(2 * pi() / 4096) AS measured FROM f)
SELECT count(*) AS problems, count(*) FILTER (WHERE abs(measured - answer) / greatest(abs(answer), 1) < 1e-4) AS verified, round(max(abs(measured - answer) / greatest(abs(answer), 1)), 8) AS worst FROM g""")
def circle_verify(spark, sf_dir):
    return _verify(spark, sf_dir, "inscribed_circle")


#: Both outlines' corners in SQL, and their areas by the shoelace sum; corner(label, sides, side).
_CORNERS = """c AS (SELECT signature, answer, idx, label, i, r * cos(t + i * 2 * pi() / k) AS x, r * sin(t + i * 2 * pi() / k) AS y, r * cos(t + (i + 1) % k * 2 * pi() / k) AS x2, r * sin(t + (i + 1) % k * 2 * pi() / k) AS y2 FROM (
  SELECT signature, answer, idx, label, k, pi() / k - pi() / 2 AS t, side / (2 * sin(pi() / k)) AS r FROM (SELECT signature, answer, idx, 'outer' AS label, n AS k, side_outer AS side FROM f UNION ALL SELECT signature, answer, idx, 'inner', m, side_inner FROM f)), range(0, 12) e(i) WHERE i < k),
a AS (SELECT signature, idx, any_value(answer) AS answer, abs(sum(x * y2 - x2 * y) FILTER (WHERE label = 'outer')) / 2 AS big, abs(sum(x * y2 - x2 * y) FILTER (WHERE label = 'inner')) / 2 AS small FROM c GROUP BY 1, 2)"""
_FIRST_NESTED = "f AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS idx FROM (SELECT * FROM nested_j WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ord) = 1))"


@query(f"""WITH {_NESTED}, {_FIRST_NESTED}, {_CORNERS}, d AS (SELECT abs(big - small - answer) / greatest(abs(answer), 1) AS rel FROM a)
SELECT count(*) AS problems, count(*) FILTER (WHERE rel < 1e-9) AS verified, round(max(rel), 8) AS worst FROM d""")
def nested_verify(spark, sf_dir):
    return _verify(spark, sf_dir, "nested_polygons")


@query(f"""WITH {_COMPOSITE}, f AS (SELECT * FROM composite_j WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ord) = 1),
e AS (SELECT signature, answer, unnest([[0, 0], [width, 0], [width, height - notch_h], [width - notch_w, height - notch_h], [width - notch_w, height], [0, height]]) AS p, unnest([[width, 0], [width, height - notch_h], [width - notch_w, height - notch_h], [width - notch_w, height], [0, height], [0, 0]]) AS q FROM f),
a AS (SELECT signature, any_value(answer) AS answer, abs(sum(p[1] * q[2] - q[1] * p[2])) / 2.0 AS area FROM e GROUP BY 1)
SELECT count(*) AS problems, count(*) FILTER (WHERE abs(area - answer) / greatest(abs(answer), 1) < 1e-9) AS verified, round(max(abs(area - answer) / greatest(abs(answer), 1)), 8) AS worst FROM a""")
def composite_verify(spark, sf_dir):
    return _verify(spark, sf_dir, "composite_rectilinear")


@query(f"""WITH {_NESTED}, {_FIRST_NESTED}, {_CORNERS}, d AS (SELECT idx % 5 AS spoiled, abs(CASE WHEN idx % 5 = 1 THEN big - small / 4 WHEN idx % 5 = 2 THEN big WHEN idx % 5 = 3 THEN NULL ELSE big - small END - answer) / greatest(abs(answer), 1) AS rel FROM a)
SELECT CAST(spoiled AS BIGINT) AS spoiled, count(*) AS problems, count(*) FILTER (WHERE rel < 1e-9) AS verified, count(rel) AS measured FROM d GROUP BY 1""")
def verify_spoiled_figures(spark, sf_dir):
    """Right parameters and answers, wrong figures: the inner outline shrunk (1), left out of the region (2), or missing (3)."""
    df = emitted(spark, sf_dir, "nested_polygons").withColumn("spoiled", F.col("index") % 5)
    half = F.transform("spec", lambda s: F.when(s["id"] == "inner", s.withField("points", F.transform(s["points"], lambda p: F.transform(p, lambda x: x / 2)))).otherwise(s))
    alone = F.transform("spec", lambda s: F.when(s["kind"] == "region", s.withField("operation", F.lit("union")).withField("of", F.array(F.lit("outer")))).otherwise(s))
    missing = F.filter("spec", lambda s: ~F.coalesce(s["id"] == "inner", F.lit(False)))
    df = df.withColumn("spec", F.when(F.col("spoiled") == 1, half).when(F.col("spoiled") == 2, alone).when(F.col("spoiled") == 3, missing).otherwise(F.col("spec")))
    return st.measure(df).groupBy("spoiled").agg(F.count("*").alias("problems"), F.count_if("verified").alias("verified"), F.count("measured").alias("measured"))


@query(f"""WITH {_COMPOSITE}, f AS (SELECT * FROM composite_j WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ord) = 1)
SELECT signature, CAST(edge AS BIGINT) AS edge, CAST(CASE edge WHEN 0 THEN width WHEN 1 THEN height - notch_h WHEN 2 THEN notch_w WHEN 3 THEN notch_h WHEN 4 THEN width - notch_w ELSE height END AS DOUBLE) AS length, edge NOT IN (1, 4) AS drawn FROM f, range(0, 6) e(edge)""")
def label_policy(spark, sf_dir):
    """Each edge's length, measured on its label's segment in the figure, and whether the label is drawn: two are left for the reader to find."""
    df = emitted(spark, sf_dir, "composite_rectilinear").select("signature", F.posexplode(S.of_kind(F.col("spec"), "length_label")).alias("edge", "e"))
    a, b = F.get("e.segment", F.lit(0)), F.get("e.segment", F.lit(1))
    return df.select("signature", F.col("edge").cast("long").alias("edge"), F.hypot(b[0] - a[0], b[1] - a[1]).alias("length"), F.col("e.draw").alias("drawn"))


# --- runs over all families -----------------------------------------------------------------------
@query(_ALL + """ SELECT family, count(*) AS draws, count(*) FILTER (WHERE reason IS NOT NULL) AS invalid, count(*) FILTER (WHERE reason IS NULL AND NOT em) AS duplicates, count(*) FILTER (WHERE em) AS emitted,
round(count(*) FILTER (WHERE reason IS NULL) / count(*), 6) AS acceptance_rate, round(coalesce(count(*) FILTER (WHERE reason IS NULL AND NOT em) / nullif(count(*) FILTER (WHERE reason IS NULL), 0), 0), 6) AS collision_rate FROM firsts GROUP BY 1""")
def collision_stats_by_family(spark, sf_dir):
    """Draws, rejections, duplicates and emissions, with acceptance over draws and collisions over valid draws."""
    counts = None
    for name in sorted(_SOURCES):
        df = judged_sets(spark, sf_dir, name).select(F.lit(name).alias("family"), "reject_code", "signature", "draws")
        counts = df if counts is None else counts.unionByName(df)
    # a family's duplicates are its valid draws less its signatures
    by = counts.groupBy("family", F.when(F.col("reject_code").isNull(), F.col("signature")).alias("signature")).agg(F.sum("draws").alias("n"))
    known = F.col("signature").isNotNull()
    out = by.groupBy("family").agg(F.sum("n").alias("draws"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("invalid"), F.count_if(known).alias("emitted"))
    duplicates = F.col("draws") - F.col("invalid") - F.col("emitted")
    return out.select("family", "draws", "invalid", duplicates.alias("duplicates"), "emitted", F.round((F.col("draws") - F.col("invalid")) / F.col("draws"), 6).alias("acceptance_rate"), F.round(F.coalesce(F.try_divide(duplicates, F.col("draws") - F.col("invalid")), F.lit(0.0)), 6).alias("collision_rate"))


@query(_ALL + " SELECT '[' || family || '] ' || reason AS cause, count(*) AS draws FROM firsts WHERE reason IS NOT NULL GROUP BY 1")
def rejections_by_cause(spark, sf_dir):
    out = None
    for name in sorted(_SOURCES):
        f = _SOURCES[name][0]
        df = st.judge(st.sets(source(spark, sf_dir, name), f), f).where("reject_code IS NOT NULL").select(F.concat(F.lit(f"[{name}] "), "reject_key").alias("cause"), "draws")
        out = df if out is None else out.unionByName(df)
    return out.groupBy("cause").agg(F.sum("draws").alias("draws"))


RUN = 200
#: Draws of a stretch within which emissions are compared in one task.
STRETCH = 1 << 16


def run_prefix(draws: DataFrame, n: int, max_draws: int | None = None, ceilings: dict[str, int] | None = None, streak: int = 5000, stretch: int = STRETCH) -> DataFrame:
    """The draws that a round-robin run makes until n problems are out, with number (of the draw in the run), done
    (problems that its family had out before it) and out (problems that are out with it).

    draws(family, turn, ord, is_first, ...): a family's draws in order. A family leaves for good at its
    ceiling or, where that is unknown, after `streak` draws without an emission; the run ends with its
    n-th emission, or after max_draws. All three are prefix scans: of a family's emissions, of its longest wait so far,
    and of the interleaved draws that are left; only the columns that decide take part.
    """
    # what can precede the end of a run: no more than max_draws draws of a family
    most = n * 200 if max_draws is None else max_draws
    narrow = draws.where(F.col("ord") <= most).select("family", "turn", "ord", "is_first")
    em = F.col("is_first").cast("long")
    own = scan(narrow, "ord", {"done": Fold(em, inclusive=False), "last": Fold(F.when(F.col("is_first"), F.col("ord").cast("long")), "max", False)}, ["family"], stretch=stretch, most=most)
    idle = F.col("ord") - 1 - F.coalesce("last", F.lit(0))
    waited = scan(own, "ord", {"waited": Fold(idle, "max")}, ["family"], stretch=stretch, most=most)
    limit = F.lit(None).cast("long")
    for name, c in (ceilings or {}).items():
        limit = F.when(F.col("family") == name, c).otherwise(limit)
    left = waited.where(F.when(limit.isNotNull(), F.col("done") < limit).otherwise(F.col("waited") < streak))
    run = scan(left, "ord", {"number": Fold(F.lit(1).cast("long")), "out": Fold(em)}, then=["turn"], stretch=stretch, most=most)
    stop = (F.col("out") < n) | ((F.col("out") == n) & F.col("is_first"))
    kept = run.where(stop & (F.col("number") <= most)).select("family", "ord", "done", "number", "out")
    return draws.join(kept, ["family", "ord"])


@query(_ALL + f""", o AS (SELECT *, sum(CAST(em AS INT)) OVER (ORDER BY ord, turn ROWS UNBOUNDED PRECEDING) AS c FROM firsts)
SELECT row_number() OVER (ORDER BY ord, turn) AS draw, family, signature, family || '_' || printf('%05d', row_number() OVER (PARTITION BY family, em ORDER BY ord) - 1) AS problem_id FROM o WHERE (c < {RUN} OR (c = {RUN} AND em)) AND em""".replace("SELECT row_number() OVER (ORDER BY ord, turn) AS draw,", "SELECT CAST(c AS BIGINT) AS place,"))
def round_robin_first_n(spark, sf_dir):
    """The first 200 problems of a round-robin run over the families, with their ids."""
    out = run_prefix(stored(problems(spark, sf_dir, 200 * RUN), "problems"), RUN).where("is_first")
    return out.select(F.col("out").cast("long").alias("place"), "family", "signature", st.problem_id(F.col("family"), F.col("done")).alias("problem_id"))


#: A run in which each way to stop comes up: families that reach a ceiling, one that waits too long, and more draws than it may make.
CAPPED = {"n": 5000, "max_draws": 12000, "ceilings": {"composite_rectilinear": 900, "inscribed_circle": 100, "nested_polygons": 1500}, "streak": 12}


@query(_ALL + f""", a AS (SELECT *, coalesce(sum(CAST(em AS INT)) OVER w, 0) AS done, ord - 1 - coalesce(max(CASE WHEN em THEN ord END) OVER w, 0) AS idle FROM firsts WHERE ord <= {CAPPED["max_draws"]} WINDOW w AS (PARTITION BY family ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, max(idle) OVER (PARTITION BY family ORDER BY ord ROWS UNBOUNDED PRECEDING) AS waited FROM a),
k AS (SELECT *, row_number() OVER w AS number, sum(CAST(em AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM b WHERE CASE family {" ".join(f"WHEN '{f}' THEN done < {c}" for f, c in CAPPED["ceilings"].items())} ELSE waited < {CAPPED["streak"]} END WINDOW w AS (ORDER BY ord, turn))
SELECT number, family, CAST(ord AS BIGINT) AS ord, em AS emitted, CAST(c AS BIGINT) AS problems FROM k WHERE number <= {CAPPED["max_draws"]} AND (c < {CAPPED["n"]} OR (c = {CAPPED["n"]} AND em))""")
def run_capped(spark, sf_dir):
    """Each draw of a run over the derived tables in which families leave at their ceilings, one leaves after too long a wait, and the draws are capped."""
    out = run_prefix(stored(problems(spark, sf_dir, CAPPED["max_draws"]), "problems"), **CAPPED, stretch=1 << 10)
    return out.select("number", "family", F.col("ord").cast("long").alias("ord"), F.col("is_first").alias("emitted"), F.col("out").alias("problems"))


@query(_ALL + """, s AS (SELECT family, ord, em, ord - 1 - coalesce(max(CASE WHEN em THEN ord END) OVER (PARTITION BY family ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idle FROM firsts)
SELECT family, CAST(max(idle) AS BIGINT) AS longest, count(*) FILTER (WHERE em AND idle > 0) AS streaks FROM s GROUP BY 1""")
def duplicate_streaks(spark, sf_dir):
    """The longest run of draws without an emission, and how many emissions ended one.

    Only emissions matter: a run lies between two of them, or behind the last. They are compared within stretches of ord
    and, by each stretch's least and greatest, across them.
    """
    out = None
    for name in sorted(_SOURCES):
        f = _SOURCES[name][0]
        draws = ordered(spark, sf_dir, name)
        ends = first_ords(draws, f).select("ord").unionByName(draws.agg((F.max("ord") + 1).alias("ord")).where("ord IS NOT NULL").withColumn("last", F.lit(True)), allowMissingColumns=True)
        one = ends.withColumn("stretch", F.floor(F.col("ord") / STRETCH))
        own = Window.partitionBy("stretch").orderBy("ord")
        within = one.withColumn("before", F.lag("ord").over(own))
        heads = one.groupBy("stretch").agg(F.max("ord").alias("high"))
        heads = heads.select("stretch", F.coalesce(F.lag("high").over(Window.orderBy("stretch")), F.lit(0)).alias("earlier"))  # a row for each stretch
        idle = F.col("ord") - 1 - F.coalesce("before", "earlier")
        one = within.join(heads, "stretch").select(F.lit(name).alias("family"), idle.alias("idle"), F.coalesce("last", F.lit(False)).alias("last"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("family").agg(F.greatest(F.max(F.when(~F.col("last"), F.col("idle"))), F.max(F.when(F.col("last"), F.col("idle") - 1))).cast("long").alias("longest"), F.count_if(~F.col("last") & (F.col("idle") > 0)).alias("streaks"))


@query(f"""WITH {_NESTED} SELECT count(DISTINCT signature) AS fresh FROM nested_j WHERE reason IS NULL AND l_orderkey % 2 = 1 AND signature NOT IN (SELECT signature FROM nested_j WHERE reason IS NULL AND l_orderkey % 2 = 0)""")
def prime_against_earlier_run(spark, sf_dir):
    """Problems of one run that an earlier run's manifest lacks."""
    f = fam.NESTED
    odd = source(spark, sf_dir, f.name).withColumn("later", F.col("l_orderkey") % 2 == 1)
    runs = odd.groupBy(*f.params).agg(F.bool_or("later").alias("later"), F.bool_or(~F.col("later")).alias("earlier"))
    valid = st.sign(st.judge(runs, f).where("reject_code IS NULL"), f)
    earlier = valid.where("earlier").select("signature").distinct()
    return valid.where("later").join(earlier, "signature", "left_anti").agg(F.countDistinct("signature").alias("fresh"))
