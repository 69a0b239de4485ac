"""Helpers that the training-data operators share: shared storage, partition counts, text batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.storage import shared_dir, stored  # noqa: F401  part of this module's interface

#: Bytes of text that a worker holds at once; an Arrow batch is cut into blocks of about this size.
BLOCK_BYTES = 4 << 20


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle gets; sized to the input by whoever starts the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_key(text: Column) -> Column:
    """128 bits of a text as a string, null for null: equal for equal texts only, up to chance far below disk errors."""
    return F.md5(text)


def blocks(batch, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow batch with about `most` bytes of text each; one long text may exceed it."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield begin, batch.num_rows


def texts_of(batch, text: str) -> list[str]:
    """The texts of a batch as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


def with_columns(batch, names: list[str], extra: list[tuple[str, object]]):
    """A record batch of some columns of `batch` and new arrays."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [a for _, a in extra], names=names + [n for n, _ in extra])


def release_memory() -> None:
    """Give what this process has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), after whose tasks a worker gives its memory back: idle workers stay beside the next stage's."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(trimmed, schema)


def quiet_tokenizers() -> None:
    """One thread for each task: Spark already runs a task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
