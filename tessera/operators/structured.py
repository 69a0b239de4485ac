"""Hand-entered problems: JSON rows checked in order, then judged, deduplicated, solved, and held against their expected answers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.functions.answers import with_fields
from tessera.operators import families as fam
from tessera.operators import records
from tessera.operators import stages as st
from tessera.operators.ordinals import first_of_repeated, numbered
from tessera.operators.storage import stored

REQUIRED, OPTIONAL = ("input_id", "family", "params", "expected_answer"), ("source", "notes")
#: Source key -> record field.
SOURCE_FIELDS = {"site": "source_site", "url": "source_url", "problem_id": "source_problem_id", "original_answer": "original_answer", "retrieved_at": "retrieved_at"}


STATUSES = ("emitted", "input_error", "geometry_rejected", "duplicate", "answer_mismatch", "error")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file's lines that aren't blank, numbered from 1; of a folder, its files' one behind the other.

    Files are split as Spark splits them; lines are numbered by file, by where their split begins, and by place in it.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    lines = numbered(text.select(at.alias("at"), F.regexp_replace("value", "\r$", "").alias("value")), ["at"], "line").select("line", "value").where(F.col("value").rlike(r"\S"))
    if not lines.head(1):
        raise ValueError(f"structured input {path} contains no rows")
    return lines


def _kind(path: str) -> Column:
    """VARIANT type of a value, null where it is missing."""
    return F.expr(f"schema_of_variant(try_variant_get(v, '{path}', 'variant'))")


def _array(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def _param_error(name: str, kind: str) -> Column:
    own = F.expr(f"schema_of_variant(try_variant_get(p, '$.{name}', 'variant'))")
    if kind == "integer":
        return F.when(~own.isin("BIGINT"), F.lit(f"params: {name} must be an integer"))
    if kind == "length":
        return F.when(~(own.isin("BIGINT", "DOUBLE", "FLOAT") | own.startswith("DECIMAL")), F.lit(f"params: {name} must be a number"))
    points = F.get_json_object("params", f"$.{name}")
    raw = F.from_json(points, "array<array<string>>")
    whole = F.forall(raw, lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.rlike("^-?[0-9]+$")))
    return F.when(~own.startswith("ARRAY") | ~F.coalesce(whole, F.lit(False)) | points.contains('"'), F.lit(f"params: {name} must be a list of integer pairs"))


def _length(raw: Column) -> Column:
    """A number of JSON as a length, by its own digits and exponent; null where it has more places or digits than a length."""
    value = raw.try_cast(exact.LENGTH)
    return F.when(value.cast("double") == raw.try_cast("double"), value)


def _first(chain: list) -> Column:
    """The reason of the first condition that holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r) if isinstance(r, str) else r) for c, r in chain])


def _forms(rows: DataFrame) -> DataFrame:
    """(form, typed parameters, expected, _b): each distinct family, params and expected answer of the rows, with the first check that it fails.

    Rows share few forms, so these checks, most of the work on a line, are done once for each; texts of answers are dealt over tasks there.
    """
    df = rows.where("_a IS NULL").select("form", "family", "params", "expected_answer").distinct()
    df = with_fields(df, "expected_answer", "expected")
    df = df.withColumns({"p": F.expr("try_parse_json(params)"), "_param_keys": F.array_sort(F.json_object_keys("params"))})
    lengths = sorted({k for name in fam.available() for k, t in fam.get(name).params.items() if t == "length"})
    df = df.withColumns({f"_len_{k}": _length(F.get_json_object("params", f"$.{k}")) for k in lengths})
    keys = F.col("_param_keys")
    family_keys, kind_error = F.lit(None), F.lit(None).cast("string")
    for name in fam.available():
        f = fam.get(name)
        family_keys = F.when(F.col("family") == name, _array(*sorted(f.params))).otherwise(family_keys)
        long = [k for k, t in f.params.items() if t == "length"]
        lost = [F.col(f"_len_{k}").isNull() for k in long]
        # a row whose lengths can't be worked out exactly is an input error, not a rounded one
        digits = [F.when(reduce(or_, lost) | exact.too_long(*[F.col(f"_len_{k}") for k in long]), F.lit(f"params: more than {exact.DIGITS} digits before and behind the point"))] if long else []
        kind_error = F.when(F.col("family") == name, F.coalesce(*[_param_error(k, t) for k, t in f.params.items()], *digits)).otherwise(kind_error)
    checks = [
        (F.col("family").isNull(), "family must be a string"),
        (~F.col("family").isin(*fam.available()), F.concat(F.lit("unknown family "), F.col("family"))),
        (~F.ltrim("params").startswith("{") | F.col("params").isNull(), "params must be a JSON object"),
        (keys != family_keys, F.concat(F.lit("params must have exactly the keys "), F.array_join(F.array_sort(family_keys), ", "))),
        (kind_error.isNotNull(), kind_error),
        (F.col("expected_answer").isNull() | ~F.col("expected_answer").rlike(r"\S"), "expected_answer must be a non-empty string"),
        (F.col("expected.error").isNotNull(), F.concat(F.lit("expected_answer: "), F.col("expected.error"))),
    ]
    # stored: its size is known then, and a filter on the checks would be pushed below them
    df = stored(df.withColumn("_b", _first(checks)).select("form", "params", "expected", "_b", *[f"_len_{k}" for k in lengths]), "forms")
    typed = {}
    for name in fam.available():
        for k, t in fam.get(name).params.items():
            raw = F.get_json_object("params", f"$.{k}")
            typed[k] = F.when(F.col("_b").isNull(), F.expr(f"try_cast(get_json_object(params, '$.{k}') AS bigint)") if t == "integer" else F.col(f"_len_{k}") if t == "length" else F.from_json(raw, "array<array<bigint>>"))
    return stored(df.withColumns(typed).drop("params", *[f"_len_{k}" for k in lengths]), "forms")


def load(lines: DataFrame) -> DataFrame:
    """line, input_id, family, typed parameters, expected, source fields and load_error, the first check that a row fails.

    An id is taken by the first row that loads with it; later rows of that id are duplicates.
    """
    df = lines.withColumn("v", F.expr("try_parse_json(value)")).withColumn("keys", F.json_object_keys("value"))
    get = lambda path: F.expr(f"try_variant_get(v, '{path}', 'string')")
    string = lambda path: F.when(_kind(path) == "STRING", get(path))
    has = lambda k: F.array_contains("keys", k)
    df = df.select("line", "value", "v", "keys", string("$.input_id").alias("input_id"), string("$.family").alias("family"), string("$.expected_answer").alias("expected_answer"), F.get_json_object("value", "$.params").alias("params"), F.when(has("source"), F.get_json_object("value", "$.source")).alias("_source"))
    df = df.withColumn("_source_keys", F.json_object_keys("_source"))
    unknown, missing = F.array_except("keys", _array(*REQUIRED, *OPTIONAL)), F.array_except(_array(*REQUIRED), F.col("keys"))
    listed = lambda label, a: F.concat(F.lit(label), F.array_join(F.array_sort(a), ", "))
    source, source_keys = F.col("_source"), F.col("_source_keys")
    bad_source = F.array_except(source_keys, _array(*SOURCE_FIELDS))
    before_id = [
        (F.col("v").isNull(), "invalid JSON"),
        (F.col("keys").isNull() | ~F.ltrim("value").startswith("{"), "row must be a JSON object"),
        (F.size(unknown) > 0, listed("unknown keys ", unknown)),
        (F.size(missing) > 0, listed("missing required keys ", missing)),
        (F.col("input_id").isNull() | ~F.col("input_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"), "input_id must be 1-128 letters, digits, '_', '.' or '-', starting with a letter or digit"),
    ]
    after_form = [
        (has("source") & (source.isNull() | ~F.ltrim(source).startswith("{")), "source must be a JSON object"),
        (F.size(bad_source) > 0, listed("unknown source keys ", bad_source)),
        *[(F.array_contains(source_keys, k) & (F.coalesce(_kind(f"$.source.{k}"), F.lit("VOID")) != "STRING"), f"source.{k} must be a string") for k in SOURCE_FIELDS],
        (has("notes") & ~F.coalesce(_kind("$.notes"), F.lit("VOID")).isin("STRING", "VOID"), "notes must be a string"),
    ]
    # one text for the three that a form is, with their lengths; a row that fails before them has none, but a key of its own for the join
    parts = [F.col(c) for c in ("family", "params", "expected_answer")]
    form = F.concat(*[F.concat(F.coalesce(F.length(c).cast("string"), F.lit("null")), F.lit(":")) for c in parts], *[F.coalesce(c, F.lit("")) for c in parts])
    df = df.withColumns({"_a": _first(before_id), "_c": _first(after_form), **provenance(source_keys, F.col("value"))})
    df = df.withColumn("form", F.when(F.col("_a").isNull(), form).otherwise(F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))))
    # stored: a filter on the checks would be pushed below them, and each check would parse its line anew
    df = stored(df.drop("value", "v", "keys", "_source", "_source_keys"), "checked")
    df = df.join(_forms(df), "form", "left").withColumn("_b", F.coalesce("_b", "_c")).drop("form", "_c")
    sound = F.col("_a").isNull() & F.col("_b").isNull()
    df = first_of_repeated(df, "input_id", F.col("line"), sound, "_taken")
    df = df.withColumn("load_error", F.coalesce("_a", F.when(F.col("_taken") < F.col("line"), F.concat(F.lit("duplicate input_id "), F.col("input_id"))), "_b"))
    typed = sorted({k for name in fam.available() for k in fam.get(name).params})
    return df.withColumns({k: F.when(F.col("load_error").isNull(), F.col(k)) for k in typed}).drop("_a", "_b", "_taken")


def provenance(keys: Column, value: Column) -> dict[str, Column]:
    """A row's source as record fields, null where a row has none."""
    return {field: F.when(F.array_contains(keys, key), F.get_json_object(value, f"$.source.{key}")) for key, field in SOURCE_FIELDS.items()}


def statuses(lines: DataFrame, precision: int = 6) -> DataFrame:
    """Every row with its status: emitted, input_error, geometry_rejected, duplicate, answer_mismatch or error.

    A signature is taken by the first row that would be emitted with it; a row whose answer doesn't match leaves it free.
    detail: why a row isn't emitted. Loaded rows are stored once and read by each family; source fields and typed parameters come
    along. Rows of a family share few parameter sets, so each set is judged, solved, drawn and measured once and joined back;
    figures aren't kept, `figures` draws those that are asked for.
    """
    loaded = stored(load(lines), "loaded")
    typed = sorted({k for name in fam.available() for k in fam.get(name).params})
    shared = ["line", "input_id", "family", "params", "expected_answer", "load_error", *SOURCE_FIELDS.values()]
    made = ["blocking", "blocking_key", "warnings", "signature", "stem", "answer_exact", "answer_decimal", "measured", "rel_diff", "verified"]
    # a row for each registered family at most: the others need no plan
    present = {r.family for r in loaded.where("load_error IS NULL").select("family").distinct().collect()}
    out = None
    for name in [n for n in fam.available() if n in present] or fam.available()[:1]:
        f = fam.get(name)
        own = loaded.where((F.col("family") == name) & F.col("load_error").isNull())
        sets = st.measure(st.solve(st.sign(st.judge(own.select(*f.params).distinct(), f), f, precision), f))
        sets = sets.select(*[F.col(k).alias(f"_{k}") for k in f.params], *made)
        same = F.lit(True)
        for k in f.params:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        one = own.join(sets, same).select(*shared, *typed, *made, F.col("expected.value").alias("expected_value"))
        out = one if out is None else out.unionByName(one)
    failed = loaded.where("load_error IS NOT NULL").select(*shared)
    df = out.unionByName(failed, allowMissingColumns=True)
    off = F.abs(F.col("answer_decimal") - F.col("expected_value")) / F.greatest(F.abs("expected_value"), F.lit(1.0))
    match = off < st.STRAIGHT
    sound = (F.col("answer_decimal") != 0) & ~F.isnan("answer_decimal")
    would = F.coalesce(F.col("load_error").isNull() & F.col("blocking").isNull() & match & sound, F.lit(False))
    df = first_of_repeated(stored(df.withColumn("_would", would), "judged"), "signature", F.col("line"), F.col("_would"), "_first").drop("_would")
    status = (
        F.when(F.col("load_error").isNotNull(), "input_error").when(F.col("blocking").isNotNull(), "geometry_rejected").when(F.col("_first") < F.col("line"), "duplicate")
        .when(~match, "answer_mismatch").when(~sound, "error").otherwise("emitted")
    )
    df = df.withColumn("status", status).withColumn("reason", F.coalesce("load_error", "blocking"))
    mismatch = F.format_string("computed %s = %s, expected %s = %s", "answer_exact", F.col("answer_decimal").cast("string"), "expected_answer", F.col("expected_value").cast("string"))
    detail = F.when(F.col("status") == "duplicate", "same family and params as an earlier row").when(F.col("status") == "answer_mismatch", mismatch).when(F.col("status") == "error", "answer_decimal is zero").otherwise(F.col("reason"))
    return df.withColumn("detail", detail).drop("_first")


def figures(found: DataFrame) -> DataFrame:
    """(problem_id, stem, spec): the figures of the rows of `statuses` that are emitted, drawn from their parameters."""
    out = None
    emitted = found.where("status = 'emitted'")
    present = {r.family for r in emitted.select("family").distinct().collect()}
    for name in [n for n in fam.available() if n in present] or fam.available()[:1]:
        f = fam.get(name)
        own = emitted.where(F.col("family") == name)
        one = own.select(F.col("input_id").alias("problem_id"), "stem", f.spec(f.columns(own)).alias("spec"))
        out = one if out is None else out.unionByName(one)
    return out


def emitted_records(found: DataFrame) -> DataFrame:
    """Manifest records of the rows of `statuses` that are emitted: their own ids, answers and sources. A row whose figure doesn't measure as solved ends the query."""
    emitted = F.col("status") == "emitted"
    rows = st.verified_or_fail(found, emitted).where(emitted & F.col("verified"))
    own = ("family", "stem", "answer_exact", "answer_decimal", "params", "signature", "expected_answer", *SOURCE_FIELDS.values())
    return records.record(
        rows, problem_id=F.col("input_id"), category=F.lit(1), image_path=records.image_path(F.col("input_id")), origin=F.lit("structured"), generator_version=F.lit(records.__version__), **{c: F.col(c) for c in own},
    )


def warning_counts(found: DataFrame) -> DataFrame:
    """(warning, n, rows): readability warnings by cause, most first."""
    each = found.select("line", F.explode("warnings").alias("w")).select("line", st.reason_key(F.col("w")).alias("warning"))
    return each.groupBy("warning").agg(F.count("*").alias("n"), F.min("line").alias("first")).orderBy(F.desc("n"), "first").select("warning", "n")


def rejection_counts(found: DataFrame) -> DataFrame:
    """(cause, n): input errors and geometry rejections by cause, most first; equal counts in the order of their first rows."""
    bad = found.where("status IN ('input_error', 'geometry_rejected')").select("line", F.coalesce("blocking_key", st.reason_key(F.col("detail"))).alias("cause"))
    return bad.groupBy("cause").agg(F.count("*").alias("n"), F.min("line").alias("first")).orderBy(F.desc("n"), "first").select("cause", "n")


def file_report(found: DataFrame) -> DataFrame:
    """One row: rows, a count for each status, rows with a readability warning, the worst difference, emissions by family."""
    emitted = F.col("status") == "emitted"
    by = found.where(emitted).groupBy("family").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "count")))).alias("by_family"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    totals = found.agg(F.count("*").alias("requested"), *counts, F.count_if(F.size("warnings") > 0).alias("warned"), F.coalesce(F.max(F.when(emitted, F.col("rel_diff"))), F.lit(0.0)).alias("worst_difference"))
    return totals.crossJoin(F.broadcast(by))  # one row each
