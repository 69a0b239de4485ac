"""Operator 6, MinHash near-dedup: DartMinHash signatures, banded joining, exact checks and connected classes.

A document is the multiset of its five-word shingles; similarity is the weighted Jaccard index, sum of least over
sum of greatest counts. Darts: an element's weights are cut into regions, [0, 1), [1, 2), [2, 4) and so on up to 64 and every
64 from there; in a region times an interval of ranks, hashed darts fall as a Poisson process of density 1, each with a weight,
a rank and a coordinate of its own. A document sees the darts below its element's weight, whole or not, up
to a rank at which about k ln k + 2k have fallen; each coordinate keeps its earliest. Two documents agree in a coordinate with a
probability equal to their similarity, and the work is that of the darts, not of elements times coordinates.

Equal texts are one node. Nodes that agree in a band are candidates. First each node is compared
with one other only, the least node of all its buckets, so a group makes no more pairs than it has
nodes; further rounds compare one member of each class that is still apart in a bucket, with the
bucket's first and last class. Classes are joined by their labels: a round's links are those
between classes, not all that were found before. What is still apart then is joined exactly: two sets this similar share one of their rarest units (prefix
filter), so all such pairs of different classes are listed by a shared rare unit and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, blocks, stored, texts_of

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Rank cells: up to 2**-6, then doubling up to 1, then one wide each.
FIRST_CELL = 2.0**-6
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * _C[1]
    x = (x ^ x >> np.uint64(27)) * _C[2]
    return x ^ x >> np.uint64(31)


def _times(k: int, c: np.uint64) -> np.uint64:
    """A product modulo 2**64."""
    return np.uint64(k * int(c) & (1 << 64) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0xD1342543DE82EF95
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1 << 12)


def _reach(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) <= n:
        _UP, _DOWN = _powers(2 * n)


#: Bytes of a text whose words are hashed at once.
CHUNK = 1 << 16


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (runs of anything but the six ASCII spaces), many words at once."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    first, end = edge[::2], edge[1::2]
    out, a = [], 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(end, first[a] + CHUNK, side="right")))
        low, f, e = first[a], first[a:b] - first[a], end[a:b] - first[a]
        part = raw[low : end[b - 1]].astype(np.uint64)
        _reach(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * _UP[: len(part)], dtype=np.uint64)])
        out.append(mix((total[e] - total[f]) * _DOWN[f] + (e - f).astype(np.uint64) * _C[0]))
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the five-word shingles; fewer words are one shingle, none are none."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w, np.zeros(0)
    k = min(n, SHINGLE)
    s = sum(w[i : n - k + 1 + i] * _C[i] for i in range(k)) + np.uint64(k)
    s = np.sort(mix(s))
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s))).astype(float)


def units(text: str) -> np.ndarray:
    """Hashes of (shingle, copy) for each copy of each shingle."""
    s, count = shingle_counts(text)
    if not len(s) or count.max() == 1:
        return mix(s + _C[5]) if len(s) else s
    many = count.astype(np.int64)
    copy = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return mix(np.repeat(s, many) + (copy.astype(np.uint64) + np.uint64(1)) * _C[5])


@lru_cache(1 << 10)
def _poisson_steps(mean: float) -> np.ndarray:
    """Where a uniform number passes from k to k + 1 darts."""
    p, total, out = np.exp(-mean), 0.0, []
    for k in range(1, 14 + int(mean + 12 * mean**0.5)):
        total += p
        out.append(total)
        p *= mean / k
    return np.array(out)


#: Regions of weights are as wide as their beginning up to this width.
WIDEST = 64.0


def regions_of(most: float) -> Iterator[tuple[float, float]]:
    """(from, to) of the regions of weights below `most`."""
    low, high = 0.0, 1.0
    while low < most:
        yield low, high
        low, high = high, high + min(high, WIDEST)


def signatures(documents: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """(documents x k) earliest ranks. documents: (hashes, weights) of distinct elements, weights above 0. Rows of documents without any are infinite."""
    out = np.full(len(documents) * k, np.inf)
    total = np.array([float(w.sum()) for _, w in documents])
    live = np.flatnonzero(total > 0)
    if not len(live):
        return out.reshape(-1, k)
    own = np.concatenate([documents[i][0] for i in live])
    weight = np.concatenate([documents[i][1] for i in live])
    of = np.repeat(live, [len(documents[i][0]) for i in live])
    # a region's darts are its own, whichever documents reach into it: each knows its element, its region and its width
    seeds, owners, tops, lows, wides = [], [], [], [], []
    for r, (begin, end) in enumerate(regions_of(float(weight.max()))):
        into = weight > begin
        seeds.append(mix(own[into] + _times(r + 1, _C[5])))
        owners.append(of[into])
        tops.append(weight[into])
        lows.append(np.full(len(owners[-1]), begin))
        wides.append(np.full(len(owners[-1]), end - begin))
    region, owner, top, base, wide = (np.concatenate(x) for x in (seeds, owners, tops, lows, wides))
    reach = np.zeros(len(documents))
    reach[live] = 2.0 ** np.ceil(np.log2((k * np.log(k) + 2 * k) / total[live]))
    low, high, cell = 0.0, FIRST_CELL, 0
    while len(region):
        seen = reach[owner] > low
        if not seen.all():
            region, owner, top, base, wide = (x[seen] for x in (region, owner, top, base, wide))
        if not len(region):
            break
        seed = mix(region + _times(cell + 1, _C[3]))
        u = (seed >> np.uint64(11)).astype(float) * 2.0**-53
        n = np.zeros(len(region), np.int64)
        for w in np.unique(wide):
            same = wide == w
            n[same] = np.searchsorted(_poisson_steps(float(w) * (high - low)), u[same], side="right")
        for d in range(int(n.max())):
            has = np.flatnonzero(n > d)
            h = mix(seed[has] + _times(d + 1, _C[4]))
            part = top[has] < base[has] + wide[has]  # of a region that the weight ends in, some darts lie above it
            if part.any():
                at = (mix(h + _C[2]) >> np.uint64(11)).astype(float) * 2.0**-53
                below = ~part | (base[has] + wide[has] * at < top[has])
                has, h = has[below], h[below]
            rank = low + (high - low) * ((h >> np.uint64(11)).astype(float) * 2.0**-53)
            np.minimum.at(out, owner[has] * k + (mix(h + _C[6]) % np.uint64(k)).astype(np.int64), rank)
        low, high, cell = high, high * 2 if high < 1 else high + 1, cell + 1
        # a document whose coordinates aren't all hit by its rank goes on to twice that
        short = np.unique(owner[reach[owner] <= low])
        short = short[np.isinf(out.reshape(-1, k)[short]).any(1)]
        reach[short] *= 2
    return out.reshape(-1, k)


def band_keys(ranks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents x bands) keys of neighbouring coordinates."""
    bits = ranks.view(np.uint64).reshape(len(ranks), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C[0], bits.shape[:2])
    for i in range(rows):
        key = mix(key + bits[:, :, i] * _C[i + 1])
    return key.view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, node, keys): keys is empty for texts without words."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch, "text", 2 << 20):
                part = batch.slice(a, b - a)
                own = [shingle_counts(t) for t in texts_of(part, "text")]
                keys = band_keys(signatures(own, bands * rows), bands, rows)
                sizes = np.array([bands if len(o) else 0 for o, _ in own])
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[sizes > 0].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("node"), flat], names=["id", "node", "keys"])

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, node binary, keys array<bigint>")


def _unit_arrays(texts: DataFrame) -> DataFrame:
    """(node, units): 32 bits of each unit, for exact comparison."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch, "text", 2 << 20):
                part = batch.slice(a, b - a)
                own = [(units(t) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in texts_of(part, "text")]
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(o) for o in own])]), pa.int32()), pa.array(np.concatenate(own) if own else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("node"), flat], names=["node", "units"])

    return arrow_map(texts, run, "node binary, units array<int>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges(a, b): the least node of each connected class.

    Each round takes the least label of the neighbours and then the label's own label, so a path's
    length halves at least; labels are stored in the shared folder after each round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = stored(new.join(up, F.col("new") == F.col("n2"), "left").select("node", F.col("label").alias("old"), F.least("new", "l2").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("old != label").head(1):
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after further links(a, b): classes are connected by their labels, one link for each pair of classes."""
    if labels is None:
        return components(links)
    old = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
    between = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a != b").distinct()
    new = components(between).select(F.col("node").alias("_of"), F.col("label").alias("_to"))
    # a class's label is its least node; nodes without a class so far come in by the links themselves
    nodes = labels.select("node", "label").union(between.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    return stored(nodes.join(new, nodes["label"] == new["_of"], "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")


def crossing_pairs(arrays: DataFrame, contested: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of nodes with different labels that may be similar: no pair of `contested`(node, label) that is goes missing.

    Units are put in one order, rarest first. Of two sets with n <= m units and at least t = `similarity`,
    the first shared unit is among the first n - ceil(2t / (1 + t) n) + 1 of the smaller and m - ceil(t m) + 1 of the
    larger one, and enough units follow it in both.
    """
    t = similarity
    own = arrays.join(contested, "node").select("node", "label", F.size("units").alias("n"), F.explode("units").alias("unit"))
    # a unit that only one class has makes no pair, but counts where it stands
    often = stored(own.groupBy("unit").agg(F.count("*").alias("df"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("df > 1").select("unit", "df", (F.col("l0") != F.col("l1")).alias("mixed")), "frequencies")
    placed = own.join(often, "unit", "left").withColumn("p", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "unit")))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    prefix = placed.where(F.col("mixed") & (F.col("p") <= first(t))).select("unit", "node", "label", "n", "p", (F.col("p") <= first(2 * t / (1 + t))).alias("short"))
    prefix = stored(prefix, "prefixes")
    # a pair has a member outside the unit's largest class, so no pairs within that class are tried
    classes = prefix.groupBy("unit", "label").agg(F.count("*").alias("k")).groupBy("unit").agg(F.max(F.struct("k", "label")).alias("most"), F.count("*").alias("classes")).where("classes > 1")
    outside = prefix.join(classes.select("unit", F.col("most.label").alias("largest")), "unit").where("label != largest")
    x, y = (d.select("unit", *[F.col(c).alias(c + k) for c in ("node", "label", "n", "p", "short")]) for d, k in ((outside, "_x"), (prefix, "_y")))
    smaller = F.when((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y"))), F.col("short_x")).otherwise(F.col("short_y"))
    follow = F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y")) + 1
    fits = (F.col("label_x") != F.col("label_y")) & (F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * t - 1e-9) & smaller & (follow >= (F.col("n_x") + F.col("n_y")) * (t / (1 + t)) - 1e-9)
    return x.join(y, "unit").where(fits).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (the least id of its class), copies (rows of equal text), is_kept (the class's first row), _node.

    Rows of equal text are in one class; so are texts that a chain of similarities of at least
    `similarity` connects. Null texts count as empty ones, and all empty texts are equal; texts of
    other spaces only have no shingles and match their equals alone. A class whose ids are all null
    has a null class_id. Of repeated rows (equal id and text) is_kept holds for each.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("node", F.unhex(F.md5("text")))
    signed = stored(_signed(base, bands, rows), "signatures")
    nodes = stored(signed.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.any_value("keys").alias("keys")), "nodes")
    members = nodes.select("node", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    held = stored(members.join(buckets, "key"), "buckets")
    pairs = held.groupBy("node").agg(F.min("low").alias("a")).select("a", F.col("node").alias("b")).where("a != b")
    # texts of all that share a bucket, each once; how many grows with the input, so they are merged at every size
    wanted = stored(held.select("node").distinct(), "candidates")
    texts = base.select("node", "text").join(wanted.hint("merge"), "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    arrays = stored(_unit_arrays(texts), "units")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (arrays.select(F.col("node").alias(k), F.col("units").alias(f"units_{k}")) for k in "ab")
        common = F.size(F.array_intersect("units_a", "units_b"))
        return pairs.join(left, "a").join(right, "b").where(common / (F.size("units_a") + F.size("units_b") - common) >= similarity).select("a", "b")

    tried = stored(pairs, "pairs")
    labels = merged(None, stored(verified(tried), "links"))
    for turn in range(1, rounds + 1):
        # of each class in a bucket one member, another each time; it meets those of the bucket's first and last class
        labelled = held.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        chosen = labelled.groupBy("key", "label").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
        ends = chosen.groupBy("key").agg(F.min(F.struct("label", "node")).alias("f"), F.max(F.struct("label", "node")).alias("l"), F.count("*").alias("n")).where("n > 1").select("key", F.explode(F.array_distinct(F.array("f.node", "l.node"))).alias("a0"))
        new = chosen.join(ends, "key").where("node != a0").select(F.least("a0", "node").alias("a"), F.greatest("a0", "node").alias("b")).distinct()
        new = stored(new.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stored(verified(new), "links")
        if not found.head(1):
            break
        tried, labels = tried.union(new), merged(labels, found)
    # buckets that still hold several classes: each similar pair across them
    labelled = held.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("key")
    contested = stored(labelled.join(apart, "key").select("node", "label").distinct(), "contested")
    if contested.head(1):
        new = stored(crossing_pairs(arrays, contested, similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = stored(verified(new), "links")
        if found.head(1):
            labels = merged(labels, found)
    classes = nodes.join(labels, "node", "left").select("node", "first_id", "copies", F.coalesce("label", "node").alias("label"))
    firsts = classes.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("n"), F.col("first_id").alias("id"), "node")).alias("f"))
    table = classes.join(firsts, "label").select("node", "copies", F.col("f.id").alias("class_id"), F.col("f.node").alias("kept"))
    out = signed.select("id", "node").join(table, "node")
    return out.select(F.col("id").alias(id_col), "class_id", "copies", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept"))).alias("is_kept"), F.col("node").alias("_node"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with their own columns, one of each class: the first by id; of repeated rows one."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("is_kept").select(F.col(id_col).alias("_id"), F.col("_node").alias("_n")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_i"), F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("_m"))
    kept = rows.join(found, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_n")), "left_semi")
    return kept.dropDuplicates(["_i", "_m"]).select("_row.*")
