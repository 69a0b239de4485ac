"""Operator 8, sharding: a hierarchical weighted hash tree, descended by region, rack and shard.

At each level a row draws a score -ln(u) / weight for each child, u from a hash of the row's key and
the child's name, and goes to the child with the least. A child whose weight grows only gains rows and
one whose weight shrinks only loses them, so what moves stays within the subtrees whose weights
change. The law is `key`: the key and the shard count decide. A tree of more shards than the base
layout holds takes each further shard as a region of its own, so one more shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import partitions


@dataclass(frozen=True)
class Node:
    """A shard (with its number) or a group of nodes. The name seeds the draws, so it must never change."""

    name: int
    weight: float
    children: tuple[Node, ...] = field(default=())
    shard: int = -1


def tree(shards: int, racks: int = 2, per_rack: int = 4, weights: dict[int, float] | None = None, base: int = 24) -> Node:
    """Regions of `racks` racks of `per_rack` shards up to `base` shards; each further one is a region of its own.

    weights: of shards by number, 1 where not given; a group weighs as much as its shards.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    weight = lambda k: float((weights or {}).get(k, 1.0))
    leaf = lambda k: Node(1 + k, weight(k), (), k)
    group = lambda name, own: Node(name, sum(x.weight for x in own), tuple(own))
    held = min(shards, base)
    regions = []
    for r, start in enumerate(range(0, held, racks * per_rack)):
        own = range(start, min(start + racks * per_rack, held))
        regions.append(group(1_000_000 + r, [group(2_000_000 + r * racks + q, [leaf(k) for k in own[q * per_rack : (q + 1) * per_rack]]) for q in range(racks) if own[q * per_rack : (q + 1) * per_rack]]))
    regions += [group(3_000_000 + k, [leaf(k)]) for k in range(held, shards)]
    return group(0, regions)


def _score(key: Column, node: Node) -> Column:
    """-ln(u) / weight, u in (0, 1] from 53 bits of a hash of key and name."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11) + F.lit(1)).cast("double") / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard of a key, as one expression: the least score of each level decides which child's expression counts."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError("a group needs a weight above 0")
    if len(live) == 1:
        return descend(key, live[0])
    drawn = F.array_min(F.array(*[F.struct(_score(key, c).alias("s"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
    out = F.when(drawn == 0, descend(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(drawn == i, descend(key, c))
    return out


def numbered(df: DataFrame, group: str, by: list[str], name: str, buckets: int) -> DataFrame:
    """Gapless numbers from 0 in each group, in no task more than a bucket: numbers within (group, bucket) behind those of the buckets before.

    Rows that agree in all of `by` share a bucket. The buckets' counts are (groups x buckets) rows.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(group, "_bucket", (F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*by)) - 1
    return df.withColumn("_own", own).join(starts, [group, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def shard(docs: DataFrame, shards: int = 24, weights: dict[int, float] | None = None, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", **layout: int) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text and 8), text_crc32, law `key`, shard, slot (gapless in its shard) and
    grown_shard, where the row goes with one more shard.

    Texts are read by built-in expressions only; what is shuffled is a few numbers of each row. Null
    texts have size 8 and the CRC of nothing, 0. Rows of a null id draw by the tree alone and so share a
    shard; repeated ids share one too, and their slots differ. Other columns are not read.
    """
    key = F.col("_key")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", descend(key, tree(shards, weights=weights, **layout)).alias("shard"), descend(key, tree(shards + 1, weights=weights, **layout)).alias("grown_shard"))
    rows = numbered(rows, "shard", ["_key", "text_crc32", "size"], "slot", buckets or partitions(docs.sparkSession))
    return rows.select(key.alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
