"""The dataflow's stages: judge, sign, solve, measure. Each adds columns; rejected rows stay rows until a caller drops them.

Tables of draws hold few distinct parameter sets (a family with a space has no more than that), so
`sets` comes first where a query needs no single draw: what follows is then done once for each set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import canonical, exact
from tessera.functions import spec as S
from tessera.functions.regions import measured_spec
from tessera.operators.families import GEOMETRY, READABILITY, Family, reason_key  # noqa: F401  reason_key is part of this interface

STRAIGHT, CURVED = 1e-9, 1e-4


def sets(df: DataFrame, family: Family, order: list[str] | None = None) -> DataFrame:
    """Each distinct parameter set: draws, how many rows have it, and with an order `first`, the least of its rows in it.

    Aggregated before the shuffle, so a set that a third of the rows share is one row of each task.
    """
    out = [F.count("*").alias("draws")]
    if order:
        out.append(F.min(F.col(order[0]) if len(order) == 1 else F.struct(*order)).alias("first"))
    return df.groupBy(*family.params).agg(*out)


def judge(df: DataFrame, family: Family) -> DataFrame:
    """reject_code (place of the first check that holds, null if none does), reject_reason and reject_key of it;
    blocking (the reason of the first geometry issue); warnings (reasons of readability issues before it); issues.

    Checks are flags first; text is made for the check that a caller asks about, and only if its column is read.
    """
    checks = family.checks(family.columns(df))
    flags = [f"_flag{i}" for i in range(len(checks))]
    df = df.withColumns({f: F.coalesce(c.when, F.lit(False)) for f, c in zip(flags, checks, strict=True)})
    none = F.lit(None).cast("int")
    first = lambda kinds: F.coalesce(*[F.when(F.col(f), F.lit(i)) for i, (f, c) in enumerate(zip(flags, checks, strict=True)) if c.severity in kinds], none)
    df = df.withColumns({"reject_code": first((GEOMETRY, READABILITY)), "_block": first((GEOMETRY,))})

    def of(code: Column, what: str) -> Column:
        out = F.lit(None).cast("string")
        for i, c in enumerate(checks):
            out = F.when(code == i, getattr(c, what)).otherwise(out)
        return out

    shown = lambda i: F.col(flags[i]) & (F.col("_block").isNull() | (F.col("_block") >= i))
    issues = [F.when(shown(i), F.struct(F.lit(i).alias("ord"), F.lit(c.severity).alias("severity"), c.reason.alias("reason"))) for i, c in enumerate(checks)]
    warned = [F.when(shown(i), c.reason) for i, c in enumerate(checks) if c.severity == READABILITY]
    return df.withColumns(
        {
            "reject_reason": of(F.col("reject_code"), "reason"),
            "reject_key": of(F.col("reject_code"), "key"),
            "blocking": of(F.col("_block"), "reason"),
            "blocking_key": of(F.col("_block"), "key"),
            "warnings": F.array_compact(F.array(*warned)) if warned else F.array().cast("array<string>"),
            "issues": F.array_compact(F.array(*issues)),
        }
    ).drop(*flags, "_block")


def payload(family: Family, precision: int = 6) -> Column:
    """The canonical text of a parameter set: keys in order, numbers with a fixed number of places."""
    if precision < 0:
        raise ValueError(f"precision must be non-negative; got {precision}")
    number = lambda x: F.concat(F.lit('["n","'), F.round(x.cast(exact.LENGTH), precision).cast(f"decimal(38,{min(precision, 18)})").cast("string"), F.lit('"]'))

    def value(name: str, kind: str) -> Column:
        if kind != "lattice_points":
            return number(F.col(name))
        point = lambda p: F.concat(F.lit('["l",['), F.array_join(F.transform(p, number), ","), F.lit("]]"))
        return F.concat(F.lit('["l",['), F.array_join(F.transform(F.col(name), point), ","), F.lit("]]"))

    parts = [F.concat(F.lit(f'["{k}",'), value(k, family.params[k]), F.lit("]")) for k in sorted(family.params)]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def variant_payload(value: str, precision: int = 6) -> Column:
    """The canonical text of any JSON value given as the text column `value`, however deep and long; null where it has none (canonical.fields says why)."""
    return canonical.fields(F.col(value), precision)["payload"]


def signed_values(df: DataFrame, value: str, family: Column, precision: int = 6) -> DataFrame:
    """The rows with signature, of the family and the JSON text `value`, and unsigned, why a value can't be signed: one side is null.

    Each distinct text is worked through once. Objects within values, numbers that no double holds, repeated keys, and what isn't JSON have no signature; nor has null.
    """
    texts = df.select(F.col(value).alias("_said")).where("_said IS NOT NULL").distinct().select("_said", canonical.fields(F.col("_said"), precision).alias("_f"))
    joined = df.join(texts, F.col(value) == F.col("_said"), "left")
    signature = F.sha2(F.concat(family, F.lit("\0"), F.col("_f.payload")), 256)
    return joined.withColumns({"signature": signature, "unsigned": F.when(F.col(value).isNull(), "no value").otherwise(F.col("_f.error"))}).drop("_said", "_f")


def sign(df: DataFrame, family: Family, precision: int = 6) -> DataFrame:
    """signature: SHA-256 of the family, a zero byte and the canonical text."""
    return df.withColumn("signature", F.sha2(F.concat(F.lit(family.name), F.lit("\0"), payload(family, precision)), 256))


def first_of_signature(df: DataFrame, order: list[str], among: Column | None = None) -> DataFrame:
    """is_first: the row is the first of its signature in the given order, among rows for which `among` holds.

    The first is found by an aggregate that is combined before its shuffle and joined back, so a
    signature that a third of the rows share isn't sorted in one task; ties of the order share the flag.
    """
    key = F.struct(*order)
    eligible = df if among is None else df.where(among)
    firsts = eligible.groupBy("signature").agg(F.min(key).alias("_first"))
    joined = df.join(firsts, "signature", "left")
    flag = F.coalesce(F.col("_first") == key, F.lit(False))
    return joined.withColumn("is_first", flag if among is None else flag & among).drop("_first")


def solve(df: DataFrame, family: Family) -> DataFrame:
    """stem, answer_exact, answer_decimal, and spec, the figure that goes with them."""
    p = family.columns(df)
    df = df.withColumn("_terms", family.terms(p))
    return df.withColumns({"stem": F.lit(family.stem), "answer_exact": exact.as_text(F.col("_terms")), "answer_decimal": family.decimal(p), "spec": family.spec(p)}).drop("_terms")


def measure(df: DataFrame, tolerance: float | None = None, general: bool = False) -> DataFrame:
    """measured: the area of df's figure by its column spec alone; rel_diff against the answer; verified: below the tolerance.

    Figures of one shape, or of a convex polygon less a shape in it, are measured by built-in
    expressions. Others have no measure and aren't verified, unless `general` sends them through the
    region measure (Arrow). A figure that can't be built isn't verified either; figure_fault says why.
    """
    df = df.withColumn("_regions", S.regions_of(F.col("spec"))).withColumn("measured", S.plain_area(F.col("_regions"))).drop("_regions")
    if general:
        df = df.withColumn("_general", measured_spec(F.when(F.col("measured").isNull(), S.as_json(F.col("spec")))))
        df = df.withColumn("measured", F.coalesce("measured", F.col("_general.measured"))).drop("_general")
    rel = F.abs(F.col("measured") - F.col("answer_decimal")) / F.greatest(F.abs("answer_decimal"), F.lit(1.0))
    most = F.lit(tolerance) if tolerance is not None else F.when(S.has_curve(F.col("spec")), CURVED).otherwise(STRAIGHT)
    return df.withColumn("rel_diff", rel).withColumn("verified", F.coalesce(F.col("rel_diff") < most, F.lit(False)))


def figure_fault(df: DataFrame) -> DataFrame:
    """fault: the first thing that keeps the figure from being built, null if there is none."""
    return df.withColumn("fault", S.fault(F.col("spec")))


def verified_or_fail(df: DataFrame, among: Column | None = None) -> DataFrame:
    """The same rows; reading one that isn't verified ends the query. among: which rows that holds for; a filter that comes
    before this call may be evaluated behind it, so a caller that drops rows names those it keeps here."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nothing"))
    text = F.concat(F.lit("the drawn figure doesn't measure as solved: "), shown("measured"), F.lit(" against "), shown("answer_decimal"))
    wrong = ~F.coalesce("verified", F.lit(False))
    if among is not None:
        wrong = F.coalesce(among, F.lit(False)) & wrong
    return df.withColumn("verified", F.when(wrong, F.raise_error(text).cast("boolean")).otherwise(F.col("verified")))


def problem_id(family: Column | str, index: Column) -> Column:
    """family_00000, five digits at least."""
    return F.concat(F.lit(family) if isinstance(family, str) else family, F.lit("_"), F.format_string("%05d", index))
