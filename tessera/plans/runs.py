"""Whole runs: draws to emitted problems, with the statistics of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import families as fam
from tessera.operators import records
from tessera.operators import stages as st
from tessera.operators.storage import stored
from tessera.plans.queries import ceiling, run_prefix
from tessera.sources.draws import draws


def _drawn(spark: SparkSession, family: str, turn: int, count: int, seed: int, mixed: bool, precision: int = 6) -> DataFrame:
    f = fam.get(family)
    judged = st.sign(st.judge(draws(spark, family, count, seed, mixed), f), f, precision).drop("issues", "warnings")
    df = st.measure(st.solve(st.first_of_signature(judged, ["ord"], F.col("reject_code").isNull()), f))
    params = F.to_json(F.struct(*sorted(f.params)))
    return df.select(F.lit(family).alias("family"), F.lit(turn).alias("turn"), "ord", "reject_reason", "reject_key", "signature", "stem", "answer_exact", "answer_decimal", "measured", "rel_diff", "verified", "spec", params.alias("params"), "is_first")


def run(spark: SparkSession, families: list[str], n: int, seed: int = 0, max_draws: int | None = None, mixed: bool | None = None, precision: int = 6) -> DataFrame:
    """The draws of a run until n problems are out, in order (number), problem ids on those that are emitted.

    Streams are drawn to a bounded length and extended while the run isn't over: twice as far each time, up to max_draws.
    """
    families = sorted(families)
    mixed = len(families) > 1 if mixed is None else mixed
    most = max_draws or 200 * n
    ceilings = {f: c for f in families if (c := ceiling(spark, fam.get(f), precision).first().ceiling) is not None}
    count = min(most, max(64, 4 * n))
    while True:
        all_draws = None
        for turn, f in enumerate(families):
            one = _drawn(spark, f, turn, count, seed, mixed, precision)
            all_draws = one if all_draws is None else all_draws.unionByName(one)
        all_draws = stored(all_draws, "draws")  # its order is found from a few columns, and then joined back
        prefix = stored(run_prefix(all_draws, n, most, ceilings), "run")  # a run is counted, reported and written from one pass
        if count >= most or prefix.agg(F.max("out")).first()[0] == n:
            break
        count = min(most, 2 * count)
    return prefix.withColumn("problem_id", F.when(F.col("is_first"), st.problem_id(F.col("family"), F.col("done"))))


def records_of(prefix: DataFrame, seed: int) -> DataFrame:
    """Manifest records of a run's emitted problems, in their order's columns; one whose figure doesn't measure as solved ends the query."""
    rows = st.verified_or_fail(prefix, F.col("is_first")).where("is_first AND verified")
    return records.generated(rows, F.col("family"), F.col("params"), F.lit(seed), F.col("problem_id"), ("out",))  # out: the record's place in the run


def causes(prefix: DataFrame) -> DataFrame:
    """(cause, n): rejections by cause, most first; equal counts in the order of their first draws. With several families causes name theirs."""
    several = prefix.select("family").distinct().count() > 1
    cause = F.concat(F.lit("["), "family", F.lit("] "), "reject_key") if several else F.col("reject_key")
    bad = prefix.where("reject_reason IS NOT NULL").select(cause.alias("cause"), "number")
    return bad.groupBy("cause").agg(F.count("*").alias("n"), F.min("number").alias("first")).orderBy(F.desc("n"), "first").select("cause", "n")


def report(prefix: DataFrame) -> DataFrame:
    """One row: draws, invalid, duplicates, emitted, rates, the worst difference, and emissions by family."""
    valid = F.col("reject_reason").isNull()
    by = prefix.where("is_first").groupBy("family").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "count")))).alias("by_family"))
    totals = prefix.agg(
        F.count("*").alias("draws"), F.count_if(~valid).alias("invalid"), F.count_if(valid & ~F.col("is_first")).alias("duplicates"), F.count_if("is_first").alias("emitted"),
        F.coalesce(F.try_divide(F.count_if(valid), F.count("*")), F.lit(0.0)).alias("acceptance_rate"),
        F.coalesce(F.try_divide(F.count_if(valid & ~F.col("is_first")), F.count_if(valid)), F.lit(0.0)).alias("collision_rate"),
        F.max(F.when(F.col("is_first"), F.col("rel_diff"))).alias("worst_difference"),
    )
    return totals.crossJoin(F.broadcast(by))
