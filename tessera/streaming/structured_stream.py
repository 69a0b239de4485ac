"""An extension: hand-entered rows as a stream, each new problem appended to a manifest once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import exact
from tessera.operators import families as fam
from tessera.operators import stages as st

SCHEMA = "input_id string, family string, params string, at timestamp"


def problems(spark: SparkSession, folder: str, family: str, late: str = "1 hour") -> DataFrame:
    """Valid problems of a family from JSON files that arrive in a folder, each signature once while its watermark lasts."""
    f = fam.get(family)
    types = {"integer": "bigint", "length": exact.LENGTH, "lattice_points": "array<array<bigint>>"}
    rows = spark.readStream.schema(SCHEMA).json(folder).where(F.col("family") == family).withWatermark("at", late)
    typed = rows.select("input_id", "at", F.from_json("params", ", ".join(f"{k} {types[t]}" for k, t in f.params.items())).alias("p")).select("input_id", "at", "p.*")
    valid = st.solve(st.sign(st.judge(typed, f), f).where("reject_code IS NULL"), f)
    return valid.dropDuplicatesWithinWatermark(["signature"]).select("input_id", "at", "signature", "stem", "answer_exact", "answer_decimal")


def append(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what is there as JSON lines, once each, and stop."""
    return df.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
