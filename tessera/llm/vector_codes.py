"""Operator 12, vector code compression: product codes whose codebooks are fitted by the filtering form of Lloyd's rounds.

Each component x is the integer floor(1024 x), and all sums and distances are exact. Every partition cuts its vectors into
blocks and builds a kd-tree over each part of a block once: a node caches its points' bounding box, sum and count. In a
round, the codebook's entries go down the tree. At a node, the entry nearest to the box's middle stands; another entry
that no point of the box can prefer (the corner that favours it most is still no nearer to it, or as near and of
a greater index) is eliminated. Where one entry is left, the node's cached sum and count go to it at once, points unseen.
Leaves compare their points with what is left. A task sends one sum and count for each entry; Spark adds them up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points of a leaf, at most.
LEAF = 32
#: Components of a block.
BLOCK = 1 << 20
#: Integers must be below, so that 64 bits hold all sums of squares.
BOUND = 1 << 24
#: Pairs of node and entry that are compared at once, times components.
AT_ONCE = 1 << 20
_TREE = "struct<order: binary, points: binary, low: binary, high: binary, sums: binary>"


def levels_of(n: int) -> int:
    """Levels of a tree of n points, the root's included."""
    return max(0, -(-n // LEAF) - 1).bit_length() + 1


def edges_of(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: a node halves its points."""
    return np.arange((1 << level) + 1) * n >> level


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, high, sums) of a kd-tree; nodes from the root on, level by level. Points are halved along the box's longest side."""
    n, order = len(points), np.arange(len(points), dtype=np.int32)
    lows, highs, sums = [], [], []
    depth = levels_of(n)
    for level in range(depth):
        edge = edges_of(n, level)
        held = points[order]
        low, high = np.minimum.reduceat(held, edge[:-1]), np.maximum.reduceat(held, edge[:-1])
        lows.append(low)
        highs.append(high)
        sums.append(np.add.reduceat(held, edge[:-1]))
        if level + 1 < depth and points.shape[1]:
            middle = edges_of(n, level + 1)[1::2]
            for a, m, b, side in zip(edge[:-1].tolist(), middle.tolist(), edge[1:].tolist(), np.argmax(high - low, axis=1).tolist(), strict=True):
                order[a:b] = order[a:b][np.argpartition(held[a:b, side], m - a)]
    return order, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums)


def _survivors(book: np.ndarray, low: np.ndarray, high: np.ndarray, node: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which pairs (node of a level, entry) stay. Pairs are ordered by node, then entry."""
    bounds = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
    step = max(1, AT_ONCE // max(1, book.shape[1]))
    cuts = np.unique(np.concatenate([[0], bounds[np.searchsorted(bounds, np.arange(step, len(node), step))], [len(node)]])).tolist()
    keep = np.ones(len(node), bool)
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        own, e = node[x:y], entry[x:y]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        z = book[e]
        off = 2 * z - (low[own] + high[own])
        far = (off * off).sum(1)
        # the entry nearest to the middle, of each node
        nearest = np.minimum.reduceat(far, first)
        runs = np.diff(np.append(first, len(own)))
        at = np.flatnonzero(far == np.repeat(nearest, runs))
        star = e[at[np.searchsorted(at, first)]]
        star = np.repeat(star, runs)
        s = book[star]
        corner = np.where(z > s, high[own], low[own])
        gain = ((z - s) * (z + s - 2 * corner)).sum(1)  # distance to z less distance to s, at the corner that favours z most
        keep[x:y] = (e == star) | (gain < 0) | ((gain == 0) & (e < star))
    return keep


def assign(points: np.ndarray, low: np.ndarray, high: np.ndarray, book: np.ndarray):
    """Yields (level, nodes, entries) of whole nodes that have one entry left, and (None, (a, b), entries) of leaves' points, in the tree's order."""
    n, depth = len(points), levels_of(len(points))
    node = np.zeros(len(book), np.int64)
    entry = np.arange(len(book))
    for level in range(depth):
        if not len(node):
            return
        at = (1 << level) - 1
        keep = _survivors(book, low[at : at + (1 << level)], high[at : at + (1 << level)], node, entry)
        node, entry = node[keep], entry[keep]
        begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        left = np.diff(np.append(begin, len(node)))
        yield level, node[begin[left == 1]], entry[begin[left == 1]]
        more = np.repeat(left > 1, left)
        node, entry, left = node[more], entry[more], left[left > 1]
        if level + 1 < depth:
            # both children get what their parent has left
            twice = np.repeat(np.arange(len(left)), 2)
            start = np.concatenate([[0], np.cumsum(left)])[:-1]
            length = left[twice]
            pick = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start[twice], length)
            node, entry = 2 * node[pick] + np.repeat(np.tile([0, 1], len(left)), length), entry[pick]
        else:
            edge = edges_of(n, level)
            square = (book * book).sum(1)
            # products of doubles are exact while they are below 2**53, and faster
            exact = np.float64 if 4 * max(1, points.shape[1]) * max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0))) ** 2 < 1 << 53 else np.int64
            p, z = points.astype(exact), book.astype(exact)
            start = np.concatenate([[0], np.cumsum(left)])
            for i in range(len(left)):
                a, b = edge[node[start[i]]], edge[node[start[i]] + 1]
                e = entry[start[i] : start[i + 1]]
                yield None, (a, b), e[np.argmin(square[e] - 2 * (p[a:b] @ z[e].T), axis=1)]


def _numbers(points: np.ndarray) -> np.ndarray:
    out = np.floor(points * float(SCALE))
    if len(out) and not np.abs(out).max(initial=0) < BOUND:
        raise ValueError(f"components of {BOUND // SCALE} and more: scale the vectors down")
    return out.astype(np.int64)


def _cut(dim: int, parts: int) -> int:
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    return dim // parts


def _trees(rows: DataFrame, dim: int, parts: int, block: int) -> DataFrame:
    """(ids, labels, trees): a row for each block of a partition's vectors, with a tree for each part."""
    width, most = _cut(dim, parts), max(ENTRIES, block // max(1, dim))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    tree = pa.struct([(c, pa.binary()) for c in ("order", "points", "low", "high", "sums")])

    def packed(held):
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        sizes = table.column("v").value_lengths().to_numpy(zero_copy_only=False)
        if (sizes != dim).any():
            raise ValueError("vectors of different lengths")
        numbers = _numbers(table.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), dim))
        trees = []
        for k in range(parts):
            points = numbers[:, k * width : (k + 1) * width]
            order, low, high, sums = build(points)
            trees.append({"order": order.tobytes(), "points": points[order].astype(np.int32).tobytes(), "low": low.astype(np.int32).tobytes(), "high": high.astype(np.int32).tobytes(), "sums": sums.tobytes()})
        lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), table.column(c)) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(tree))], names=["ids", "labels", "trees"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - size)
                held.append(part)
                size, at = size + part.num_rows, at + part.num_rows
                if size == most:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return arrow_map(rows, run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees array<{_TREE}>")


def _opened(tree: dict, n: int, width: int) -> tuple[np.ndarray, ...]:
    """(order, points, low, high, sums) of a stored tree."""
    numbers = lambda c, kind=np.int32: np.frombuffer(tree[c], kind).astype(np.int64).reshape(-1, width) if width else np.zeros((n if c == "points" else (1 << levels_of(n)) - 1, 0), np.int64)
    return np.frombuffer(tree["order"], np.int32), numbers("points"), numbers("low"), numbers("high"), numbers("sums", np.int64)


def _summed(trees: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, n, sums) of all parts by their nearest entry."""
    k = len(books[0])

    def run(batches):
        sums, counts = np.zeros((len(books), k, width), np.int64), np.zeros((len(books), k), np.int64)
        for batch in batches:
            for ids, own in zip(batch.column("ids"), batch.column("trees"), strict=True):
                n = len(ids)
                for j, tree in enumerate(own.as_py()):
                    _, points, low, high, cached = _opened(tree, n, width)
                    for level, where, entries in assign(points, low, high, books[j]):
                        if level is None:
                            a, b = where
                            np.add.at(sums[j], entries, points[a:b])
                            counts[j] += np.bincount(entries, minlength=k)
                        else:
                            edge = edges_of(n, level)
                            np.add.at(sums[j], entries, cached[(1 << level) - 1 + where])
                            np.add.at(counts[j], entries, edge[where + 1] - edge[where])
        part, entry = np.nonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(sums[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), flat], names=["part", "entry", "n", "sums"])

    sent = arrow_map(trees, run, "part int, entry int, n bigint, sums array<bigint>")
    added = [F.sum(F.col("sums")[i]) for i in range(width)]
    return sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *([F.array(*added).alias("sums")] if width else [F.lit(None).cast("array<bigint>").alias("sums")]))


def _coded(trees: DataFrame, books: list[np.ndarray], width: int, kinds: tuple[str, str]) -> DataFrame:
    """(id, label, code, error) of all vectors."""

    def run(batches):
        for batch in batches:
            for ids, labels, own in zip(batch.column("ids"), batch.column("labels"), batch.column("trees"), strict=True):
                n = len(ids)
                codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for j, tree in enumerate(own.as_py()):
                    order, points, low, high, _ = _opened(tree, n, width)
                    found = np.zeros(n, np.int64)
                    for level, where, entries in assign(points, low, high, books[j]):
                        if level is None:
                            found[where[0] : where[1]] = entries
                        else:
                            edge = edges_of(n, level)
                            for node, e in zip(where.tolist(), entries.tolist(), strict=True):
                                found[edge[node] : edge[node + 1]] = e
                    off = points - books[j][found]
                    codes[order, j] = found
                    error[order] += (off * off).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["id", "label", "code", "error"])

    return arrow_map(trees, run, f"id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def clean(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, v, label) of the rows whose vector is there and holds finite numbers only."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.col(f"`{label_col}`").alias("label")).where(F.col("v").isNotNull() & finite)


def fit_codebooks(trees: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds. A round brings at most one row for each entry to the driver."""
    width = books[0].shape[1]
    for _ in range(rounds):
        new = [b.copy() for b in books]
        for r in _summed(trees, books, width).collect():
            if width:
                new[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
        books = new
    return books


def vector_codes(rows: DataFrame, parts: int = PARTS, rounds: int = ROUNDS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null, NaN or infinite components are dropped. A codebook starts with the vectors of
    the 256 least ids (null ids last, repeated ids in the order of their vectors); of fewer vectors it has as many entries,
    and entries that are equal stay so: the first takes all. Vectors without components are all alike, with errors of 0. Vectors of
    different lengths, of lengths that `parts` doesn't divide, and components of 16384 or more end with an error that says so.
    Null labels are one label; repeated rows are coded each; an empty table gives an empty one. Other columns aren't read.
    """
    kept = clean(rows, id_col, vector_col, label_col)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    names = [F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256"]
    kinds = tuple(kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    if not first:
        return kept.select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false").select(*names)
    dim = len(first[0]["v"])
    width = _cut(dim, parts)
    if any(len(r["v"]) != dim for r in first):
        raise ValueError("vectors of different lengths")
    start = _numbers(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim))
    trees = stored(_trees(kept, dim, parts, block), "trees")
    books = fit_codebooks(trees, [start[:, k * width : (k + 1) * width].copy() for k in range(parts)], rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = stored(_coded(trees, books, width, kinds), "codes")
    errors = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    out = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return out.withColumn("codebooks_sha256", F.lit(digest)).select(*names)
