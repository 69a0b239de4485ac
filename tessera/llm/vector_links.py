"""Operator 13, embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

1. Equal vectors are one node. Nodes that lie close together are gathered into balls, so that a group of many copies is a
   few rows from then on: in a few rounds the nodes of equal signs (as many as leave chance company rare) are held against
   one reference vector, and join its ball if they are within half the angle of a link. Two members of a ball are linked.
2. Tables. In each table a node's signs towards a few random planes are its bucket. A bucket holds each ball once, with the
   reference's vector in bytes. Pairs of balls go on whose references are within the angle of a link and of their members'
   distances; rounding of the bytes is bounded and added. The number of tables follows from the number of signs,
   so that a pair at the least cosine shares a bucket with a probability of 1 - MISSED.
3. Cosines. For each pair of balls, a member is held against the other ball's reference: it is linked with all members, with
   none, or it is compared with each of them in double precision. So all links between two balls that were
   found together are counted exactly, and only those that are in doubt are listed.
4. Components of the graph of balls, by the labels' least neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_map, stored
from tessera.llm.near_dups import _C, components, mix

COSINE = 0.9
#: The share of pairs at the least cosine that no table holds together.
MISSED = 1e-4
#: Nodes that a bucket has by chance.
BUCKET = 256
#: Rounds of gathering.
ROUNDS = 3
#: Balls of a bucket that are compared in one task; a larger bucket is cut into squares of so many.
SLICE = 4096
#: Angles are apart by more than the rounding of doubles if they differ by this.
NARROW = 1e-6


def planes(dim: int, n: int, seed: int) -> np.ndarray:
    """Normals of random planes through the origin, the same in all tasks."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def tables_for(bits: int, cosine: float, missed: float = MISSED) -> int:
    """How many tables of so many signs miss a pair at this cosine with a probability of `missed` at most."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if together >= 1 else math.ceil(math.log(missed) / math.log1p(-together))


def _matrix(vectors: list[bytes], kind: type) -> np.ndarray:
    """Vectors of one length in bytes, as doubles; of wide numbers, times powers of two so that no square overflows."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return x if kind is np.float32 else np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _by_length(column: pa.Array) -> list[np.ndarray]:
    """Places of a column of bytes that have the same length."""
    sizes = pc.fill_null(pc.binary_length(column), -1).to_numpy(zero_copy_only=False)
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x and y, in doubles, symmetric to the last bit."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _cosines_of(a: pa.Array, b: pa.Array, kind: type) -> np.ndarray:
    """Of two columns of vectors in bytes; a row's two vectors are of one length."""
    out = np.empty(len(a))
    for own in _by_length(a):
        took = pa.array(own)
        out[own] = cosines(*(_matrix(c.take(took).to_pylist(), kind) for c in (a, b)))
    return out


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def sign_keys(unit: np.ndarray, normals: np.ndarray, bits: int) -> np.ndarray:
    """(vectors x tables) bucket of each vector in each table; a bucket's number is mixed with its table's."""
    signs = (unit @ normals > 0).astype(np.int64).reshape(len(unit), -1, bits)
    codes = (signs << np.arange(bits)).sum(2).astype(np.uint64)
    return mix(mix(codes + np.uint64(1)) + np.arange(1, codes.shape[1] + 1, dtype=np.uint64) * _C[0]).view(np.int64)


def bytes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, step, error) of vectors: each unit vector is `step` times its bytes, but for a vector no longer than `error`."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    step = np.abs(unit).max(1, initial=1e-300) / 127
    small = np.rint(unit / step[:, None])
    return small.astype(np.int8), step.astype(np.float32), (np.sqrt(((unit - small * step.astype(np.float32)[:, None]) ** 2).sum(1)) + 1e-6).astype(np.float32)


def _vectors_of(rows: DataFrame, kind: type) -> DataFrame:
    """(id, v): v, the numbers in bytes, is null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            vectors = []
            for v in batch.column("v"):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # -0 is 0
                vectors.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vectors, pa.binary())], names=["id", "v"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, v binary")


def _gathered(nodes: DataFrame, rounds: int, bits: int, half: float, kind: type) -> DataFrame:
    """(node, v, weight, ball, angle, w): w is the vector of the ball's reference, `angle` the node's to it."""

    def keyed(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, rounds), np.int64)
            for own in _by_length(batch.column("v")):
                x = _matrix(batch.column("v").take(pa.array(own)).to_pylist(), kind)
                out[own] = sign_keys(x, planes(x.shape[1], bits * rounds, 1), bits)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * rounds, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "v", "weight")), keys], names=["node", "v", "weight", "keys"])

    def moved(batches):
        for batch in batches:
            ball, angle, ref = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("ball", "angle", "ref"))
            w = batch.column("w").to_pylist()
            new = np.flatnonzero(batch.column("rv").is_valid().to_numpy(zero_copy_only=False))
            if len(new):
                took = pa.array(new)
                own = _angle(_cosines_of(batch.column("v").take(took), batch.column("rv").take(took), kind))
                near = own <= half - NARROW
                ball[new[near]], angle[new[near]] = ref[new[near]], own[near]
                for i, v in zip(new[near].tolist(), batch.column("rv").take(took).filter(pa.array(near)).to_pylist(), strict=True):
                    w[i] = v
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "v", "weight", "keys")), pa.array(ball.astype(np.int64)), pa.array(angle), pa.array(w, pa.binary())], names=["node", "v", "weight", "keys", "ball", "angle", "w"])

    state = arrow_map(nodes.select("node", "v", "weight"), keyed, "node bigint, v binary, weight bigint, keys array<bigint>").select("*", F.col("node").alias("ball"), F.lit(0.0).alias("angle"), F.col("v").alias("w"))
    state = stored(state, "balls")
    for t in range(rounds):
        # of a bucket's balls one is the reference, by an order that is the same in each round: groups grow together
        chosen = state.groupBy(F.col("keys")[t].alias("key")).agg(F.min(F.struct(F.xxhash64("ball").alias("rank"), "ball")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", F.col("m.ball").alias("ref"))
        chosen = chosen.join(nodes.select(F.col("node").alias("ref"), F.col("v").alias("rv")), "ref")
        side = state.join(chosen, state["keys"][t] == chosen["key"], "left")
        stays = F.coalesce(F.col("ref") == F.col("ball"), F.lit(True))
        side = side.select("node", "v", "weight", "keys", "ball", "angle", "w", F.coalesce("ref", F.lit(0)).alias("ref"), F.when(~stays & (F.length("rv") == F.length("v")), F.col("rv")).alias("rv"))
        state = stored(arrow_map(side, moved, "node bigint, v binary, weight bigint, keys array<bigint>, ball bigint, angle double, w binary"), "balls")
    return state.drop("keys")


def _bucketed(balls: DataFrame, bits: int, tables: int, kind: type) -> DataFrame:
    """(key, ball, small, step, error, reach): each ball of a bucket once; reach is the largest angle that a member there has to the reference."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                for at in _by_length(part.column("v")):
                    own = part.take(pa.array(at))
                    x, w = (_matrix(own.column(c).to_pylist(), kind) for c in "vw")
                    keys = sign_keys(x, planes(x.shape[1], bits * tables, 2), bits)
                    small, step, error = bytes_of(w)
                    many = np.repeat(np.arange(len(x)), tables)
                    took = pa.array(many)
                    columns = [pa.array(keys.ravel()), own.column("ball").take(took), pa.array([s.tobytes() for s in small], pa.binary()).take(took), pa.array(step[many]), pa.array(error[many]), own.column("angle").take(took)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "ball", "small", "step", "error", "angle"])

    sent = arrow_map(balls.select("v", "ball", "angle", "w"), run, "key bigint, ball bigint, small binary, step float, error float, angle double")
    return sent.groupBy("key", "ball", "small", "step", "error").agg(F.max("angle").alias("reach"))


def _paired(buckets: DataFrame, limit: float, slice_rows: int) -> DataFrame:
    """(a, b), a < b: balls of a bucket some members of which may be linked. A bucket over `slice_rows` is cut into squares."""
    crowded = stored(buckets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows).select("key", F.ceil(F.col("n") / slice_rows).cast("int").alias("cuts")), "crowded")
    placed = buckets.join(crowded, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("ball"), F.col("cuts")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    placed = placed.select("key", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), "own", "ball", "small", "step", "error", "reach")

    def near(held):
        by = {}
        for i, r in enumerate(held):
            by.setdefault(len(r[5]), []).append(i)
        for at in by.values():
            if len(at) < 2:
                continue
            rows = [held[i] for i in at]
            x = np.frombuffer(b"".join(r[5] for r in rows), np.int8).reshape(len(rows), -1).astype(np.float32)
            own, ball = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64)
            step, error, reach = (np.array([r[k] for r in rows]) for k in (6, 7, 8))
            low = rows[0][1]  # this square's row and column: pairs of one slice are found in its own square alone
            square = rows[0][1] != rows[0][2]
            left, right = (np.flatnonzero(own == low), np.flatnonzero(own != low)) if square else (np.arange(len(rows)), np.arange(len(rows)))
            for a in range(0, len(left), 1024):
                i = left[a : a + 1024]
                for b in range(0, len(right), 1024):
                    j = right[b : b + 1024]
                    if not square and j[-1] < i[0]:
                        continue
                    got = (x[i] @ x[j].T) * step[i][:, None] * step[j][None]
                    most = got + error[i][:, None] * (1 + error[j][None]) + error[j][None] + 1e-4
                    p, q = np.nonzero(most >= np.cos(np.minimum(np.pi, limit + reach[i][:, None] + reach[j][None])))
                    u, v = ball[i[p]], ball[j[q]]
                    new = u < v if not square else u != v
                    if new.any():
                        yield np.minimum(u, v)[new], np.maximum(u, v)[new]

    def run(batches):
        held, last, out, size = [], None, [], 0

        def flush():
            if not out:
                return
            pairs = np.unique(np.concatenate([np.stack(p, 1) for p in out]), axis=0)
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != last:
                    for p in near(held):
                        out.append(p)
                        size += len(p[0])
                    held, last = [], row[:3]
                    if size > 1 << 18:
                        yield from flush()
                        size = 0
                held.append(row)
        out.extend(near(held))
        yield from flush()

    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(n, "key", "row", "col").sortWithinPartitions("key", "row", "col", "ball")
    return arrow_map(dealt, run, "a bigint, b bigint").distinct()


def _counted(pairs: DataFrame, balls: DataFrame, cosine: float, kind: type) -> DataFrame:
    """(node, ball, other, links): how many vectors of another ball a node is linked with, where there are any."""
    limit = math.acos(cosine)
    refs = balls.groupBy("ball", "w").agg(F.sum("weight").alias("total"), F.count("*").alias("members"), F.max("angle").alias("reach"))
    directed = pairs.union(pairs.select("b", "a")).toDF("ball", "other")
    other = refs.select(F.col("ball").alias("other"), F.col("w").alias("ref"), "total", "members", "reach")
    met = balls.select("node", "v", "ball").join(directed.join(other, "other"), "ball")

    def judged(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                found = _cosines_of(part.column("v"), part.column("ref"), kind)
                apart = _angle(found)
                reach = part.column("reach").to_numpy()
                alone = (part.column("members").to_numpy() == 1) & (reach == 0)  # the reference itself; one that has joined another ball isn't its ball's member
                all_ = np.where(alone, found >= cosine, apart + reach <= limit - NARROW)
                none = np.where(alone, ~all_, apart - reach > limit + NARROW)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "v", "ball", "other")), pa.array(np.where(all_, part.column("total").to_numpy(), 0)), pa.array(~all_ & ~none)], names=["node", "v", "ball", "other", "links", "open"])

    first = stored(arrow_map(met, judged, "node bigint, v binary, ball bigint, other bigint, links bigint, open boolean").where("links > 0 OR open"), "met")
    # what is still open is compared with each member
    each = first.where("open").select("node", "v", "ball", "other").join(balls.select(F.col("ball").alias("other"), F.col("v").alias("u"), "weight", F.col("node").alias("n2")), "other")

    def compared(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                near = _cosines_of(part.column("v"), part.column("u"), kind) >= cosine
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(near)) for c in ("node", "ball", "other", "weight")], names=["node", "ball", "other", "links"])

    listed = arrow_map(each, compared, "node bigint, ball bigint, other bigint, links bigint").groupBy("node", "ball", "other").agg(F.sum("links").alias("links"))
    return stored(first.where("links > 0").select("node", "ball", "other", "links").unionByName(listed), "links")


def vector_links(rows: DataFrame, cosine: float = COSINE, missed: float = MISSED, bucket: int = BUCKET, rounds: int = ROUNDS, slice_rows: int = SLICE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Rows of equal vectors are linked with each other. Vectors that are null, empty or zero or that hold null, NaN or
    infinite components are linked with nothing and are their own component; so are vectors of different lengths to each
    other. Repeated rows and ids are rows like any other: each counts as another vector. component_id is the least id that isn't
    null, null where there is none; kept holds for all rows of that id. An empty table gives an empty one; other columns aren't read.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine: between 0 and 1")
    kind = np.float32 if isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType) else np.float64
    base = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    known = stored(_vectors_of(base, kind), "vectors")
    # numbered as they are written: every later reader sees the same numbers
    nodes = stored(known.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("weight"), F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = nodes.count()
    limit = math.acos(cosine)
    balls = _gathered(nodes, rounds, max(1, math.ceil(math.log2(max(2, total)))) + 2, limit / 2, kind)
    bits = max(1, round(math.log2(max(2, total / bucket))))
    pairs = stored(_paired(_bucketed(balls, bits, tables_for(bits, cosine, missed), kind), limit, slice_rows), "pairs")
    links = _counted(pairs, balls, cosine, kind)
    labels = components(links.select(F.col("ball").alias("a"), F.col("other").alias("b")).where("a < b").distinct())
    sizes = balls.groupBy("ball").agg(F.sum("weight").alias("inside"))
    placed = balls.select("node", "ball").join(sizes, "ball").join(labels.withColumnRenamed("node", "ball"), "ball", "left").select("node", "inside", F.coalesce("label", "ball").alias("label"))
    outside = links.groupBy("node").agg(F.sum("links").alias("outside"))
    found = placed.join(nodes.select("node", "v", "least"), "node").join(outside, "node", "left").select("v", "label", "least", (F.col("inside") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    found = stored(found, "found")
    least = found.groupBy("label").agg(F.min("least").alias("component"))
    table = found.join(least, "label").select("v", "n_links", "component")
    out = known.join(table, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
