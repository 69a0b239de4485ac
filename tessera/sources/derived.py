"""Problems derived from ordinary tables by fixed formulas, so that every query has input at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordinals import numbered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.lit(4) + F.col("l_partkey") % 9).alias("n"))
    return df.select(
        "*", (F.lit(3) + F.col("l_suppkey") % (F.col("n") - 3)).alias("m"), (F.lit(1) + F.col("l_quantity").cast("int") % 20).cast("long").alias("side_outer"), (F.lit(1) + F.col("l_orderkey") % 20).alias("side_inner")
    )


NESTED_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", (F.lit(3) + F.col("p_partkey") % 6).alias("k"), (F.lit(1) + F.col("p_size") % 20).cast("long").alias("side"))


CIRCLE_ORDER = ["p_partkey"]


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("t"), (F.lit(4) + F.col("o_orderkey") % 17).alias("width"), (F.lit(4) + F.col("o_custkey") % 17).alias("height"))
    return df.select("o_orderkey", "width", "height", (F.lit(1) + F.col("t") % (F.col("width") - 1)).alias("notch_w"), (F.lit(1) + F.floor(F.col("t") / 7).cast("long") % (F.col("height") - 1)).alias("notch_h"))


COMPOSITE_ORDER = ["o_orderkey"]


def coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in groups of four by time, groups of three or four kept.

    An event's place among its user's is its place among all less its user's first, so a user with very many events is in
    no single task.
    """
    df = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.round(F.col("value") * 100).cast("long") % 13 - 6).alias("x"), (F.get_json_object("props", "$.k").cast("long") % 13 - 6).alias("y"))
    df = numbered(df, ["user_id", "ts", "event_id"], "place")
    first = df.groupBy(F.col("user_id").alias("_user")).agg(F.min("place").alias("_first"))
    df = df.join(first, df["user_id"].eqNullSafe(first["_user"])).withColumn("grp", F.floor((F.col("place") - F.col("_first")) / 4))
    points = df.groupBy("user_id", "grp").agg(F.array_sort(F.collect_list(F.struct("event_id", F.array("x", "y").alias("p")))).alias("own"))
    return points.where(F.size("own") >= 3).select("user_id", "grp", F.transform("own", lambda e: e["p"]).alias("points"))


COORDINATE_ORDER = ["user_id", "grp"]
