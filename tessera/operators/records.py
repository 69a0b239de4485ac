"""Manifest records: schema, checks in order, stems that give geometry away, and the JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import __version__
from tessera.functions import numbers
from tessera.operators import families as fam

ORIGINS = ("generated", "harvested", "structured", "given")
ANSWER_TYPES = ("exact", "unavailable")
PAPER_PROBLEMS = 200
#: Words that a stem may not hold, since they state a count or a side count.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
SHAPE_WORDS = ("triangle", "quadrilateral", "square", "rectangle", "rhombus", "trapezoid", "trapezium", "pentagon", "hexagon", "heptagon", "octagon", "nonagon", "decagon", "hendecagon", "dodecagon")
#: The record's fields in order.
FIELDS = {
    "problem_id": "string", "family": "string", "category": "int", "stem": "string", "image_path": "string", "answer_exact": "string", "answer_decimal": "double", "origin": "string", "seed": "bigint",
    "params": "string", "signature": "string", "generator_version": "string", "source_site": "string", "source_url": "string", "source_problem_id": "string", "retrieved_at": "string", "answer_source": "string",
    "original_answer": "string", "expected_answer": "string", "paper_index": "int", "source_image": "string", "answer_type": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
OMITTED_WHEN_NULL = ("expected_answer", "paper_index", "source_image", "answer_type")


def stem_leak(stem: Column) -> Column:
    """Why a stem gives geometry away, null if it doesn't: digits, then number words, then polygon names."""
    digits = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(stem, F.lit(r"([\p{Nd}\p{No}])"), F.lit(1)))), "")
    words = F.array_distinct(F.transform(F.split(stem, r"[\s\p{Z}]+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,;:!?()]+|[.,;:!?()]+$", ""))))
    found = lambda known: F.array_sort(F.array_intersect(words, F.array(*map(F.lit, known))))
    return (
        F.when(digits != "", F.concat(F.lit("stem contains digits "), digits))
        .when(F.size(found(NUMBER_WORDS)) > 0, F.concat(F.lit("stem contains number words "), F.array_join(found(NUMBER_WORDS), ", ")))
        .when(F.size(found(SHAPE_WORDS)) > 0, F.concat(F.lit("stem names shapes "), F.array_join(found(SHAPE_WORDS), ", ")))
    )


def _blank(c: str) -> Column:
    """Null or white space only."""
    return F.col(c).isNull() | ~F.col(c).rlike(r"[^\s\p{Z}]")


def invalid_reason() -> Column:
    """The first rule that a record breaks, null if none: origin, category with its image and stem, names, what its origin asks for, answer, parameters."""
    origin = F.col("origin")
    leak = stem_leak(F.col("stem"))
    missing = lambda *names: F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names])), ", ")
    present = F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in ("seed", "params", "signature", "generator_version")])), ", ")
    generated, structured, given = origin == "generated", origin == "structured", origin == "given"
    keys = F.array_sort(F.coalesce(F.json_object_keys("params"), F.array().cast("array<string>")))
    keys_fit = F.lit(False)
    for name in fam.available():
        keys_fit = F.when(F.col("family") == name, keys == F.array(*map(F.lit, sorted(fam.get(name).params)))).otherwise(keys_fit)
    unavailable = F.coalesce(given & (F.col("answer_type") == "unavailable"), F.lit(False))
    chain = [
        (origin.isNull() | ~origin.isin(*ORIGINS), "unknown origin"),
        (F.col("category").isNull() | ~F.col("category").isin(1, 2), "category must be 1 or 2"),
        ((F.col("category") == 1) & _blank("image_path"), "category 1 requires an image_path"),
        ((F.col("category") == 1) & leak.isNotNull() & ~given, "category 1 stem carries geometric information"),
        ((F.col("category") == 2) & F.col("image_path").isNotNull(), "category 2 must not carry a diagram"),
        *[(_blank(c), f"{c} must be non-empty") for c in ("problem_id", "family", "stem")],
        (generated & (missing("seed", "params", "signature", "generator_version") != ""), F.concat(F.lit("generated lacks "), missing("seed", "params", "signature", "generator_version"))),
        *[(generated & _blank(c), f"{c} must be non-empty") for c in ("signature", "generator_version")],
        (structured & (missing("params", "signature", "generator_version", "expected_answer") != ""), F.concat(F.lit("structured lacks "), missing("params", "signature", "generator_version", "expected_answer"))),
        *[(structured & _blank(c), f"{c} must be non-empty") for c in ("signature", "generator_version", "expected_answer")],
        (structured & F.col("seed").isNotNull(), "structured was not drawn from a seed"),
        (structured & ~F.col("family").isin(*fam.available()), "structured needs a registered family"),
        (structured & ~keys_fit, "params must have exactly the family's keys"),
        (given & (present != ""), F.concat(F.lit("given has no generator provenance: "), present)),
        (given & ~F.coalesce(F.col("paper_index").between(1, PAPER_PROBLEMS), F.lit(False)), f"given requires paper_index in 1..{PAPER_PROBLEMS}"),
        (given & ~F.coalesce(F.col("answer_type").isin(*ANSWER_TYPES), F.lit(False)), "given requires answer_type"),
        (given & F.col("source_image").isNotNull() & _blank("source_image"), "source_image must be non-empty when set"),
        (unavailable & (F.col("answer_exact").isNotNull() | F.col("answer_decimal").isNotNull()), "unavailable means there is no answer"),
        (~unavailable & _blank("answer_exact"), "answer_exact must be non-empty"),
        (~unavailable & F.col("answer_decimal").isNull(), "answer_decimal must be a real number"),
        (~unavailable & (F.isnan("answer_decimal") | (F.abs("answer_decimal") == float("inf"))), "answer_decimal must be finite"),
        (~unavailable & (F.col("answer_decimal") == 0), "answer_decimal is zero"),
        (F.col("params").isNotNull() & F.json_object_keys("params").isNull(), "params are not a JSON object"),
    ]
    out = F.lit(None).cast("string")
    for when, reason in reversed(chain):
        out = F.when(F.coalesce(when, F.lit(False)), F.lit(reason) if isinstance(reason, str) else reason).otherwise(out)
    return out


def stem_warning() -> Column:
    """A given record's leaking stem warns and doesn't reject."""
    return F.when((F.col("origin") == "given") & (F.col("category") == 1), stem_leak(F.col("stem")))


def record(df: DataFrame, carry: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """All fields of a record, null where not given. carry: columns of df that come along."""
    return df.select(*[columns.get(k, F.lit(None)).cast(v).alias(k) for k, v in FIELDS.items()], *carry)


def image_path(problem_id: Column, root: str = "") -> Column:
    """Where a problem's figure is: images/<id>.png, below `root` where one is given; forward slashes."""
    return F.concat(F.lit(f"{root.rstrip('/')}/images/" if root else "images/"), problem_id, F.lit(".png"))


def with_images(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Records with their figures, images(problem_id, image), by problem_id; null where there is none."""
    return rows.join(images.select("problem_id", "image"), "problem_id", "left")


def params_map(params: Column) -> Column:
    """A record's parameters as a map of JSON texts, empty where it has none."""
    return F.coalesce(F.from_json(params, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def generated(df: DataFrame, family: Column, params: Column, seed: Column, problem_id: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Generated records of solved rows."""
    return record(
        df, carry, problem_id=problem_id, family=family, category=F.lit(1), stem=F.col("stem"), image_path=image_path(problem_id), answer_exact=F.col("answer_exact"),
        answer_decimal=F.col("answer_decimal"), origin=F.lit("generated"), seed=seed, params=params, signature=F.col("signature"), generator_version=F.lit(__version__),
    )


def to_line(df: DataFrame, *carry: str) -> DataFrame:
    """One JSON object a record, keys in order, parameters as an object, raw Unicode; nulls kept but for fields that are left out when null. carry: further columns that stay."""
    names = sorted(FIELDS)
    always = [n for n in names if n not in OMITTED_WHEN_NULL]

    def value(n: str) -> Column:
        if n == "params":
            return F.coalesce(F.col("params"), F.lit("null"))
        return F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(n).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("")) if FIELDS[n] == "string" else numbers.text(F.col(n)) if FIELDS[n] == "double" else F.col(n).cast("string")

    parts = []
    for n in names:
        shown = F.concat(F.lit(f'"{n}": '), F.when(F.col(n).isNull(), "null").otherwise(value(n)))
        parts.append(shown if n in always else F.when(F.col(n).isNotNull(), shown))
    return df.select(*carry, F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))


def from_line(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Records of JSON lines(value), with an error for lines that aren't objects of the known fields.

    strict=False tolerates a bad last line, which an interrupted writer leaves: lines need a column ord then.
    """
    keys = F.json_object_keys("value")
    required = [n for n in FIELDS if n not in OMITTED_WHEN_NULL]
    unknown, missing = F.array_except(keys, F.array(*map(F.lit, FIELDS))), F.array_except(F.array(*map(F.lit, required)), keys)
    # an object's keys are read as far as it goes, so the whole line has to parse too
    whole = F.expr("try_parse_json(value)").isNotNull()
    error = F.when(~whole | keys.isNull(), "invalid JSON").when(F.size(unknown) > 0, F.concat(F.lit("unknown fields "), F.array_join(unknown, ", "))).when(F.size(missing) > 0, F.concat(F.lit("missing fields "), F.array_join(missing, ", ")))
    out = lines.withColumn("error", error).withColumn("r", F.from_json("value", SCHEMA))
    carried = [c for c in out.columns if c not in ("value", "r", "error")]
    read = [F.get_json_object("value", "$.params").alias("params") if n == "params" else F.col(f"r.{n}").alias(n) for n in FIELDS]
    out = out.select(*carried, *read, "error")
    if strict:
        return out
    last = lines.agg(F.max("ord").alias("last"))
    return out.crossJoin(F.broadcast(last)).where(~((F.col("ord") == F.col("last")) & F.col("error").isNotNull())).drop("last")
