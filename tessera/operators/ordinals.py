"""Order as data: dense numbers in a total order, and firsts of groups, neither with all rows or a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.storage import stored

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str], name: str = "ord", start: int = 1) -> DataFrame:
    """The rows with a dense number in the given order; rows that agree in it are numbered in any order.

    Rows are dealt by ranges of the order, which a sample balances, sorted within, and stored with
    their partition and place. A partition's rows are numbered behind those of the partitions before
    it: one count for each partition is summed and broadcast, and no window spans the rows.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("_at")), "ordered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + start).drop("_part", "_at", "_before")


def least_by(df: DataFrame, key: str, value: Column, among: Column, name: str) -> DataFrame:
    """The rows with the least `value` of those rows of their key for which `among` holds, null where there are none.

    The least ones are aggregated before the shuffle and joined back. Rows of a null key have none; each
    is given a key of its own for the join, so that they don't meet in one task.
    """
    least = df.where(among & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(value).alias(name))
    own = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    return df.withColumn("_own", own).join(least, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")


def first_of_repeated(df: DataFrame, key: str, value: Column, among: Column, name: str) -> DataFrame:
    """The rows with the least `value` of their key's rows for which `among` holds, null for keys of one row and null keys.

    The keys that several rows have are stored first: where they are few, the planner sees that and the rows aren't shuffled.
    """
    groups = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.when(among, value)).alias(name), F.count("*").alias("_n"))
    repeated = stored(groups.where(F.col("_n") > 1).where(F.col(name).isNotNull()).drop("_n"), "repeated")
    own = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    return df.withColumn("_own", own).join(repeated, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")
