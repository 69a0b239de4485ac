"""Operator 7, suffix-array dedup: remove every byte that a string of `length` bytes covers which also starts elsewhere.

1. Anchors. Of all grams (64 bytes for strings of 400) in the string that starts at a place, the one of least hash (the
   first of equal ones) is its anchor. Equal strings have equal anchors at equal offsets. Neighbouring places share an
   anchor, so a document gives one row for about 170 bytes: the gram's hash, which starts it
   anchors, and the hash of the region (all bytes of those strings). A gram is long enough that common phrases
   make no anchor in common.
2. Classes. Rows are counted by (gram, region hash), combined before the shuffle. Grams seen once are
   dropped, and only rows of the others go on; a region seen twice repeats throughout; grams with several regions need their bytes.
3. Shards. One region of each class is fetched; the regions of a gram meet in one shard, and each
   shard is searched by its suffix array and common prefixes. A gram with more than SPLIT regions
   is spread over several shards, whose sorted keys are then merged by binary search.
4. Repeats go back to all rows of their class, are put together for each document, and are cut out.

Nothing is compared pair by pair, no group is gathered whole, and no text is cut short.

Passages of so many words are found in the same way, over texts coded as WIDTH bytes of each word's hash: there a
symbol is a word, and places, lengths and grams count words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, blocks, partitions, stored
from tessera.llm.near_dups import _SPACE, word_hashes
from tessera.llm.suffix_array import repeated

#: The shortest gram, in bytes.
GRAM = 16
#: Symbols of a document that are worked through at once.
SEGMENT = 1 << 20
#: Bytes of regions in one suffix array.
SHARD_BYTES = 1 << 15
#: Regions of one gram in one shard.
SPLIT = 512
#: Keys that are merged at once where a gram's regions are spread.
BUCKET_KEYS = 1 << 18
#: Bytes of a word's hash.
WIDTH = 4
_LOW = np.uint64((1 << 24) - 1)


def word_codes(text: str) -> bytes:
    """WIDTH bytes for each word."""
    return (word_hashes(text) >> np.uint64(64 - 8 * WIDTH)).astype(f"<u{WIDTH}").tobytes()


@dataclass(frozen=True)
class Coding:
    """How a text becomes symbols of `unit` bytes, and how many of them a gram has for strings of a length."""

    code: Callable[[str], bytes]
    unit: int
    gram: Callable[[int], int]


BYTES = Coding(str.encode, 1, lambda length: GRAM * min(4, max(1, length // (6 * GRAM))))
WORDS = Coding(word_codes, WIDTH, lambda length: min(8, max(1, length // 6)))


def word_spans(text: str, spans: list[tuple[int, int]], words: int, length: int) -> list[tuple[int, int]]:
    """Spans of words as spans of a text's bytes, in the form of `cut` with `length`: words go with the spaces after them."""
    if not spans:
        return []
    raw = np.frombuffer(text.encode(), np.uint8)
    word = ~_SPACE[raw]
    starts = np.append(np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])), len(raw)).tolist()
    return [(starts[a], starts[b + words] - length) for a, b in spans]


def _joined(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """At each place, a hash of a's value there and b's value `by` places on."""
    n = min(len(a), len(b) - by)
    h = a[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += b[by : by + n]
    return h


def gram_hashes(symbols: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` symbols from each place on."""
    if symbols.itemsize == 1:
        held = np.ndarray((len(symbols) - 7,), "<u8", np.ascontiguousarray(symbols).data, strides=(1,)).astype(np.uint64)
        step, width = 8, gram // 8
    else:
        held, step, width = symbols.astype(np.uint64), 1, gram
    # hashes of 1, 2, 4... parts, each of two of the former; those of the gram's binary digits are joined
    h, at = None, 0
    while True:
        if width & 1:
            h = held[at:] if h is None else _joined(h, held, at)
            at += step
        width >>= 1
        if not width:
            break
        held, step = _joined(held, held, step), 2 * step
    h = h[: len(symbols) - gram + 1].copy()
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values: running minima of blocks from both sides, combined."""
    n = len(values)
    filled = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    filled[:n] = values
    rows = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, length: int, coding: Coding = BYTES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, anchor, first start, last start) of the anchors of a document's code, a segment at a time; all in symbols."""
    gram = coding.gram(length)
    out, width = [], length - gram + 1
    whole = np.frombuffer(data, f"<u{coding.unit}")
    for a in range(0, max(0, len(whole) - length + 1), SEGMENT):
        h = gram_hashes(whole[a : a + SEGMENT + length - 1], gram)
        places = np.arange(len(h), dtype=np.uint64)
        least = sliding_least(h & ~_LOW | places, width)
        edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (least[edge] & _LOW).astype(np.int64)
        out.append((h[at].view(np.int64), at + a, edge + a, np.append(edge[1:], len(least)) - 1 + a))
    return out


def _rows(docs: DataFrame, length: int, coding: Coding) -> DataFrame:
    """(id, h, gram, region, first, last) of all anchors. h: hash of the text, which tells rows of one id apart."""
    unit = coding.unit

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for x, y in blocks(batch, "text"):
                part = batch.slice(x, y - x)
                owner, columns = [], ([], [], [], [], [])
                for k, text in enumerate(part.column("text")):
                    data = coding.code(text.as_py() or "")
                    for gram, at, first, last in anchors(data, length, coding) if len(data) >= length * unit else ():
                        view = memoryview(data)
                        # the seed: where the region's strings stand to the anchor
                        seeds = ((at - first) << 20 | (at - last + length)).tolist()
                        region = [digest(view[a:b], s) for a, b, s in zip((first * unit).tolist(), ((last + length) * unit).tolist(), seeds, strict=True)]
                        owner.append(np.full(len(gram), k))
                        for c, v in zip(columns, (gram, np.array(region, np.uint64).view(np.int64), first, last), strict=False):
                            c.append(v)
                if owner:
                    took = pa.array(np.concatenate(owner))
                    names = ["gram", "region", "first", "last"]
                    yield pa.RecordBatch.from_arrays([part.column(c).take(took) for c in ("id", "h")] + [pa.array(np.concatenate(c)) for c in columns[:4]], names=["id", "h", *names])

    kind = docs.schema["id"].dataType.simpleString()
    return arrow_map(docs, run, f"id {kind}, h bigint, gram bigint, region bigint, first bigint, last bigint")


def _regions(docs: DataFrame, wanted: DataFrame, length: int, coding: Coding) -> DataFrame:
    """(gram, region, salt, salts, data) of the wanted classes, cut from one document of each."""
    unit = coding.unit

    def run(batches):
        def table(rows):
            gram, region, salt, salts, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(region, pa.int64()), pa.array(salt, pa.int32()), pa.array(salts, pa.int32()), pa.array(data, pa.binary())], names=["gram", "region", "salt", "salts", "data"])

        out = []
        for batch in batches:
            for text, own in zip(batch.column("text"), batch.column("own"), strict=True):
                data = coding.code(text.as_py())
                for w in own.as_py():
                    out.append((w["gram"], w["region"], w["salt"], w["salts"], data[w["first"] * unit : (w["last"] + length) * unit]))
                    if len(out) == 2000:
                        yield table(out)
                        out = []
        if out:
            yield table(out)

    by = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("gram", "region", "salt", "salts", "first", "last")).alias("own"))  # a document's own anchors
    # rows of one id and text hash, however many, are one document here: only such rows are brought together
    many = stored(docs.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("h").alias("_h")), "copies")
    same = docs["id"].eqNullSafe(many["_id"]) & (docs["h"] == many["_h"])
    once = docs.join(many, same, "left_anti").unionByName(docs.join(many, same, "left_semi").groupBy("id", "h").agg(F.any_value("text").alias("text")))
    one = once.join(by, once["id"].eqNullSafe(by["id"]) & (once["h"] == by["h"])).select("text", "own")
    return arrow_map(one, run, "gram bigint, region bigint, salt int, salts int, data binary")


_SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64())])
_FOUND = "gram bigint, region bigint, spans array<struct<a: bigint, b: bigint>>"


def _searched(regions: DataFrame, length: int, split: int, coding: Coding) -> DataFrame:
    """(gram, region, spans): first starts' ranges (from, to) that repeat within the shard. Where a gram is spread over
    shards, also rows with a bucket: a shard's distinct strings of that bucket in order, as 16-byte keys, with the
    region and place of each that is single in its shard (place -1 for the others)."""
    unit = coding.unit
    wide = length * unit
    kind = pa.schema([("gram", pa.int64()), ("region", pa.int64()), ("spans", pa.list_(_SPAN)), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("keys", "owners", "places")]])

    def keyed(gram, salts, own):
        # own: (region, data, starts that repeat) of one shard of a gram
        keys = np.array([xxhash.xxh3_128_digest(data[k : k + wide]) for _, data, _ in own for k in range(0, len(data) - wide + 1, unit)], "S16")
        counts = [(len(data) - wide) // unit + 1 for _, data, _ in own]
        owners, places = np.repeat(np.array([r for r, _, _ in own], np.int64), counts), np.concatenate([np.arange(n) for n in counts]).astype(np.int32)
        known = np.concatenate([np.isin(np.arange(n), starts) for n, (_, _, starts) in zip(counts, own, strict=True)])
        keys, at = np.unique(keys, return_index=True)
        owners, places = owners[at], np.where(known[at], -1, places[at]).astype(np.int32)
        most = 1 + salts * split * (length - coding.gram(length)) // BUCKET_KEYS
        bucket = (np.frombuffer(keys.astype("S4").tobytes(), ">u4").astype(np.uint64) * np.uint64(most) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
        for a, b in zip(edge, [*edge[1:], len(keys)], strict=True):
            yield {"gram": gram, "bucket": int(bucket[a]), "keys": keys[a:b].tobytes(), "owners": owners[a:b].tobytes(), "places": places[a:b].tobytes()}

    def flush(held):
        out, spread = [], {}
        for (gram, region, salt, salts, data), starts in zip(held, repeated([h[4] for h in held], wide, unit), strict=True):
            starts = starts // unit
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1) + 1
                out.append({"gram": gram, "region": region, "spans": [{"a": int(p[0]), "b": int(p[-1])} for p in np.split(starts, cut)]})
            if salts > 1:
                spread.setdefault((gram, salt, salts), []).append((region, data, starts))
        yield pa.RecordBatch.from_pylist(out, kind)
        for (gram, _, salts), own in spread.items():
            yield pa.RecordBatch.from_pylist(list(keyed(gram, salts, own)), kind)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for x, y in blocks(batch, "data", 1 << 20):
                part = batch.slice(x, y - x)
                for row in zip(*(part.column(c).to_pylist() for c in ("gram", "region", "salt", "salts", "data")), strict=True):
                    if size >= SHARD_BYTES and (row[0], row[2]) != last:  # rows are in order: a gram's regions stay together
                        yield from flush(held)
                        held, size = [], 0
                    held.append(row)
                    size, last = size + len(row[4]), (row[0], row[2])
        if held:
            yield from flush(held)

    dealt = regions.repartition(partitions(regions.sparkSession), "gram", "salt").sortWithinPartitions("gram", "salt")
    return arrow_map(dealt, run, _FOUND + ", bucket int, keys binary, owners binary, places binary")


def _merged(spread: DataFrame) -> DataFrame:
    """(gram, region, spans) of strings that repeat across the shards of a spread gram: each shard's sorted keys of a
    bucket are looked up by binary search in the sorted keys of all shards."""

    def found(gram, runs):
        keys = [np.frombuffer(k, "S16") for k, _, _ in runs]
        every = np.sort(np.concatenate(keys), kind="stable")
        owners, places = [], []
        for own, (_, owner, place) in zip(keys, runs, strict=True):
            more = np.searchsorted(every, own, "right") - np.searchsorted(every, own, "left") > 1  # a shard has a key once
            place = np.frombuffer(place, np.int32)
            new = more & (place >= 0)
            owners.append(np.frombuffer(owner, np.int64)[new])
            places.append(place[new].astype(np.int64))
        owner, place = np.concatenate(owners), np.concatenate(places)
        by = np.lexsort((place, owner))
        owner, place = owner[by], place[by]
        # neighbouring places of a region are one range of starts
        edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])) if len(owner) else np.zeros(0, np.int64)
        last = np.append(edge[1:], len(owner)) - 1
        for i in range(0, len(edge), 4096):
            e, f = edge[i : i + 4096], last[i : i + 4096]
            spans = pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1), pa.int32()), pa.StructArray.from_arrays([pa.array(place[e]), pa.array(place[f])], names=["a", "b"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), gram)), pa.array(owner[e]), spans], names=["gram", "region", "spans"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            for gram, bucket, *shard in zip(*(batch.column(c).to_pylist() for c in ("gram", "bucket", "keys", "owners", "places")), strict=True):
                if (gram, bucket) != last:
                    if held:
                        yield from found(last[0], held)
                    held, last = [], (gram, bucket)
                held.append(shard)
        if held:
            yield from found(last[0], held)

    dealt = spread.select("gram", "bucket", "keys", "owners", "places").repartition(partitions(spread.sparkSession), "gram", "bucket").sortWithinPartitions("gram", "bucket")
    return arrow_map(dealt, run, _FOUND)


def repeat_spans(docs: DataFrame, length: int = 400, split: int = SPLIT, coding: Coding = BYTES) -> DataFrame:
    """(id, h, spans): for each document of docs(id, h, text) with repeats, the ranges of starts of repeated strings of so many symbols."""
    rows = stored(_rows(docs, length, coding), "anchors")
    # counts alone are shuffled first; what a gram of several rows needs is then fetched from the rows once
    classes = rows.groupBy("gram", "region").agg(F.count("*").alias("m"))
    grams = classes.groupBy("gram").agg(F.sum("m").alias("total"), F.count("*").alias("kinds"), F.count_if(F.col("m") == 1).alias("open")).where("total > 1")
    kept = classes.join(grams, "gram").select("gram", "region", "m", "kinds", "open")
    hits = stored(rows.join(kept, ["gram", "region"]), "hits")
    # where each region of a gram occurs twice, nothing is open
    wanted = hits.where("kinds > 1 AND open > 0").groupBy("gram", "region").agg(F.min(F.struct("id", "h", "first", "last")).alias("at"), F.ceil(F.max("kinds") / split).cast("int").alias("salts"))
    wanted = wanted.select("gram", "region", "at.*", "salts", F.pmod(F.xxhash64("region"), F.col("salts")).cast("int").alias("salt"))
    searched = stored(_searched(_regions(docs, wanted, length, coding), length, split, coding), "searched")
    parts = searched.where("region IS NOT NULL").select("gram", "region", "spans").unionByName(_merged(searched.where("bucket IS NOT NULL")))
    single = hits.where("m = 1").join(parts, ["gram", "region"]).select("id", "h", F.explode(F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))).alias("s"))
    # a region that occurs twice repeats throughout
    found = single.unionByName(hits.where("m > 1").select("id", "h", F.struct(F.col("first").alias("a"), F.col("last").alias("b")).alias("s")))
    return found.groupBy("id", "h").agg(F.collect_set("s").alias("spans"))  # rows of one id and text have the same spans: once


def cut(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs), given ranges of starts of strings to remove."""
    left, removed, runs, at = [], 0, 0, 0
    for a, b in sorted(spans):
        end = b + length
        if runs and a <= at:
            if end > at:
                removed, at = removed + end - at, end
            continue
        left.append(data[at:a])
        removed, runs, at = removed + end - a, runs + 1, end
    left.append(data[at:])
    return b"".join(left), removed, runs


def drop_repeats(docs: DataFrame, length: int = 400, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, words: int | None = None, keep: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, with `carry` a struct `carried` of those columns, and with `keep` kept_bytes and kept_text.

    Strings are judged on the input, within a document as well as between documents; rows of one id,
    repeated rows and null ids are documents like any other. Null and empty texts have nothing to
    remove; a very long text is worked through a segment at a time and judged whole. kept_bytes may hold parts of
    characters that a cut splits; kept_text is without them, and null for a null text. With `words`, kept_text also
    loses each run of so many words (whatever spaces are between) that occurs more than once, judged on the input too;
    the other columns don't follow those runs. Columns of docs keep apart from those made here, whatever their names.
    """
    if length <= GRAM:
        raise ValueError(f"length: more than {GRAM}")
    if words is not None and words < 2:
        raise ValueError("words: 2 at least")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    judged = rows.where("text IS NOT NULL").select("id", "h", "text")
    spans = repeat_spans(judged, length, split)
    if words:
        none = F.lit(None).cast(spans.schema["spans"].dataType)
        runs = repeat_spans(judged, words, split, WORDS).select("id", "h", none.alias("spans"), F.col("spans").alias("runs"))
        both = spans.withColumn("runs", none).unionByName(runs)
        spans = both.groupBy("id", "h").agg(F.max("spans").alias("spans"), F.max("runs").alias("runs"))
    joined = rows.join(spans, rows["id"].eqNullSafe(spans["id"]) & (rows["h"] == spans["h"]), "left").select(rows["id"], "text", "spans", *(["runs"] if words else []), *(["carried"] if carry else []))
    kept = ["kept_bytes", "kept_text"] if keep else []

    def run(batches):
        long = lambda v: pa.array(v, pa.int64())
        for batch in batches:
            for x, y in blocks(batch, "text"):
                part = batch.slice(x, y - x)
                plain = part.column("text").to_pylist()
                texts = [(t or "").encode() for t in plain]
                pairs = lambda column: [[(v["a"], v["b"]) for v in s or ()] for s in part.column(column).to_pylist()]  # noqa: B023, E731
                gone = pairs("spans")
                done = [cut(t, s, length) for t, s in zip(texts, gone, strict=True)]
                columns = [part.column("id"), long([len(t) for t in texts]), long([d[1] for d in done]), long([d[2] for d in done]), pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())]
                if carry:
                    columns.append(part.column("carried"))
                if keep:
                    left = [d[0] for d in done]
                    columns.append(pa.array(left, pa.binary()))
                    for k, r in enumerate(pairs("runs") if words else ()):
                        if r:
                            left[k] = cut(texts[k], gone[k] + word_spans(plain[k], r, words, length), length)[0]
                    columns.append(pa.array([None if t is None else t if len(b) == len(raw) else b.decode("utf-8", "ignore") for t, b, raw in zip(plain, left, texts, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["carried"] if carry else []), *kept])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if carry:
        schema += f", carried {rows.schema['carried'].dataType.simpleString()}"
    if keep:
        schema += ", kept_bytes binary, kept_text string"
    out = arrow_map(joined, run, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["carried"] if carry else []), *kept)


def without_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id", words: int | None = None) -> DataFrame:
    """The rows with their own columns, repeats (with `words` also runs of so many words) cut from their texts; characters that a cut splits go whole. Null texts stay null."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    others = [own[c] for c in docs.columns if c != text_col]
    out = drop_repeats(docs.toDF(*names), length, id_col=own[id_col], text_col=own[text_col], carry=others, words=words)
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col(f"carried.{own[c]}").alias(c) for c in docs.columns])
