"""Manifests: JSON lines in a folder, written by Spark's commit protocol and read with or without tolerance.

A manifest may be written in parts, folders `part=000000`, `part=000001` and so on, each committed on its own: a writer that
is stopped leaves whole parts, and one that goes on writes only those that are missing. What was left of a part that wasn't committed
is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import records
from tessera.operators.scans import Fold, scan
from tessera.operators.stages import problem_id
from tessera.operators.storage import stored


def _lines(df: DataFrame) -> DataFrame:
    """Records as lines; an invalid record ends the write."""
    reason = records.invalid_reason()
    checked = df.withColumn("_ok", F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("problem_id"), F.lit(": "), reason)).cast("boolean"))).where("_ok").drop("_ok")
    return checked


def write(df: DataFrame, path: str, overwrite: bool = False, order: str = "problem_id") -> None:
    """Valid records as JSON lines in order; refuses a path that exists, unless told to overwrite. An invalid record ends the write."""
    lines = records.to_line(_lines(df).repartitionByRange(order).sortWithinPartitions(order))
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _part(path: str, k: int) -> str:
    return f"{path.rstrip('/')}/part={k:06d}"


def committed(spark: SparkSession, path: str) -> int:
    """How many parts stand one behind the other from the first: a part that isn't committed ends the count."""
    k = 0
    while _exists(spark, f"{_part(path, k)}/_SUCCESS"):
        k += 1
    return k


def write_parts(df: DataFrame, path: str, number: str, size: int = 100_000, resume: bool = False, overwrite: bool = False) -> int:
    """Records with a column `number` (from 1 on, without gaps) in parts of so many, in its order; how many parts were written now.

    A path that exists is refused, unless it is to be overwritten or carried on. Carried on, committed parts stay as they are, and
    only the rows of the others are read: since a run's draws follow from its seed, the manifest is that of a run that
    wasn't stopped. An invalid record ends the write behind the parts before its own. The last part says how many there are.
    """
    spark = df.sparkSession
    if resume and overwrite:
        raise ValueError("a manifest is either carried on or overwritten")
    if _exists(spark, path) and not (resume or overwrite):
        raise ValueError(f"{path} exists; carry it on or overwrite it")
    done = committed(spark, path) if resume else 0
    if overwrite and _exists(spark, path):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    most = df.agg(F.max(number)).first()[0] or 0
    parts = -(-most // size)
    for k in range(done, parts):
        own = df.where(F.col(number).between(k * size + 1, (k + 1) * size))
        lines = records.to_line(_lines(own).repartitionByRange(max(1, spark.sparkContext.defaultParallelism), number).sortWithinPartitions(number))
        lines.write.mode("overwrite").text(_part(path, k))
    return max(0, parts - done)


def append(df: DataFrame, path: str, family: str = "family", order: str = "ord") -> int:
    """Add the records whose signature the manifest lacks, as its next part, and say how many those are.

    Of the new records with one signature the first in `order` stays. Their ids go on where their family's stop: family_00007
    behind family_00006. Records without a signature are added as they are. Calling it again with the same records adds nothing.
    """
    spark = df.sparkSession
    known = read_parts(spark, path).where("error IS NULL").select("signature", "problem_id", "family")
    fresh = merge_earlier(df, known).withColumn("_key", F.coalesce("signature", F.concat(F.lit("\0"), "problem_id")))
    firsts = fresh.groupBy("_key").agg(F.min(order).alias("_first"))
    fresh = fresh.join(firsts, "_key").where(F.col(order) == F.col("_first")).drop("_key", "_first")
    used = known.groupBy("family").agg(F.max(F.regexp_extract("problem_id", "_([0-9]+)$", 1).try_cast("long")).alias("_last")).withColumnRenamed("family", "_of")
    placed = scan(fresh, order, {"_n": Fold(F.lit(1).cast("long"))}, [family]).join(used, F.col(family).eqNullSafe(F.col("_of")), "left")
    named = F.when(F.col("signature").isNull(), F.col("problem_id")).otherwise(problem_id(F.col(family), F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_n") - 1))
    moved = F.when(F.col("image_path") == records.image_path(F.col("problem_id")), records.image_path(named)).otherwise(F.col("image_path"))
    made = stored(placed.withColumns({"image_path": moved, "problem_id": named}), "appended")
    n = made.count()
    if n:
        lines = records.to_line(_lines(made).repartitionByRange(max(1, spark.sparkContext.defaultParallelism), "problem_id").sortWithinPartitions("problem_id"))
        lines.write.mode("overwrite").text(_part(path, committed(spark, path)))
    return n


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Records of the committed parts with an error column."""
    paths = [_part(path, k) for k in range(committed(spark, path))]
    lines = spark.read.text(paths) if paths else spark.createDataFrame([], "value string")
    return records.from_line(lines.select("value").where("trim(value) <> ''"))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records with an error column. Tolerant reading drops a bad last line of each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord")).where("trim(value) <> ''")
    if strict:
        return records.from_line(lines.select("value"))
    out = records.from_line(lines)
    last = lines.groupBy("file").agg(F.max("ord").alias("last"))
    return out.join(last, "file").where(~((F.col("ord") == F.col("last")) & F.col("error").isNotNull())).drop("file", "ord", "last")


def merge_earlier(df: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows whose signature an earlier manifest lacks."""
    return df.join(earlier.select("signature").where("signature IS NOT NULL").distinct(), "signature", "left_anti")
