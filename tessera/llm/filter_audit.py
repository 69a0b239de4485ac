"""Operator 11, filter interaction audit: what each of five filters removes, alone and behind the others, in every order.

Texts are read in place from Arrow's buffers. One lookup gives each byte its classes; prefix sums over them count
code points, capitals and symbols between the documents' offsets, and the edges of the class of spaces are the words.
Distinct words: each document's word hashes are sorted, and neighbours of equal hash are compared byte by byte, so a
hash decides nothing alone; a document in which two words share one is counted by its words. Failed filters are a
mask of five bits. Masks are counted by part before anything is shuffled, and a product of 32 counts with fixed
matrices gives all orders and steps.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, blocks, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
_SPACE, _CAPITAL, _SYMBOL, _INNER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[65:91] = _CAPITAL
_CLASS[[ord(c) for c in "#$%&*|"]] = _SYMBOL
_CLASS[128:192] = _INNER  # a byte inside a character
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a long text that are scanned at once; a piece ends where a space does.
PIECE = 1 << 22
#: Words of more bytes are hashed and compared one by one.
LONG = 64


def _eight(raw: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, without those beyond `left`. raw: eight bytes longer than its text."""
    held = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    return held[at] & _KEEP[np.minimum(left, 8)]


def word_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    size = end - first
    h = (_eight(raw, first, size) + size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    rest, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(rest):
        x = (h[rest] ^ _eight(raw, first[rest] + k, size[rest] - k)) * np.uint64(0xBF58476D1CE4E5B9)
        h[rest] = x ^ x >> np.uint64(29)
        k += 8
        rest = rest[size[rest] > k]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[first[i] : end[i]].data)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def same_words(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a are those from b."""
    same = _eight(raw, a, size) == _eight(raw, b, size)
    rest, k = np.flatnonzero((size > 8) & (size <= LONG) & same), 8
    while len(rest):
        same[rest] = _eight(raw, a[rest] + k, size[rest] - k) == _eight(raw, b[rest] + k, size[rest] - k)
        k += 8
        rest = rest[same[rest] & (size[rest] > k)]
    for i in np.flatnonzero((size > LONG) & same):
        same[i] = raw[a[i] : a[i] + size[i]].tobytes() == raw[b[i] : b[i] + size[i]].tobytes()
    return same


def _grouped(raw: np.ndarray, first: np.ndarray, end: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, which words repeat one of their document, documents in which two words share a hash). Words of document i have owner i < n."""
    h = word_hashes(raw, first, end)
    bits = (n - 1).bit_length()
    key = h >> np.uint64(bits) | owner.astype(np.uint64) << np.uint64(64 - bits) if bits else h
    order = np.argsort(key)
    equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[equal], order[equal + 1]
    size = end - first
    differ = (size[a] != size[b]) | ~same_words(raw, first[a], first[b], np.minimum(size[a], size[b]))
    repeat = np.zeros(len(h), bool)
    repeat[b] = True
    return h, repeat, np.unique(owner[a[differ]])


def _words_of(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> set[bytes]:
    return {raw[a:b].tobytes() for a, b in zip(first.tolist(), end.tolist(), strict=True)}


def scan(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(5 x documents): words, distinct words, code points, capitals, symbols. Document i: raw[offsets[i]:offsets[i + 1]]; raw ends in eight further bytes."""
    n = len(offsets) - 1
    kinds = _CLASS[raw[: offsets[-1]]]
    totals = []
    for kind in (_INNER, _CAPITAL, _SYMBOL):
        sums = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(kinds & kind != 0, out=sums[1:])
        totals.append(np.diff(sums[offsets]))
    word = kinds & _SPACE == 0
    edge = np.zeros(len(word) + 1, bool)  # where a document begins, a word can't go on
    edge[offsets] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    end = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    owner = np.searchsorted(offsets, first, side="right") - 1
    words = np.bincount(owner, minlength=n)
    _, repeat, unsure = _grouped(raw, first, end, owner, n)
    distinct = words - np.bincount(owner[repeat], minlength=n)
    for i in unsure:
        own = owner == i
        distinct[i] = len(_words_of(raw, first[own], end[own]))
    return np.stack([words, distinct, np.diff(offsets) - totals[0], totals[1], totals[2]])


def scan_long(raw: np.ndarray, size: int, piece: int = PIECE) -> np.ndarray:
    """`scan` of one text, a piece at a time: of each piece its distinct words go on, and are then told apart in the same way."""
    total, found, a = np.zeros(5, np.int64), [], 0
    while a < size:
        b = min(size, a + piece)
        while b < size:  # on to the next space
            space = np.flatnonzero(_CLASS[raw[b : min(size, b + piece)]] & _SPACE)
            if len(space):
                b += int(space[0])
                break
            b = min(size, b + piece)
        part = raw[a : b + 8]
        if b < size:  # what follows the piece isn't of its words
            part = np.concatenate([raw[a:b], np.zeros(8, np.uint8)])
        kinds = _CLASS[part[: b - a]]
        word = np.concatenate([[False], kinds & _SPACE == 0, [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        first, end = edge[::2], edge[1::2]
        _, repeat, unsure = _grouped(part, first, end, np.zeros(len(first), np.int64), 1)
        single = ~repeat if not len(unsure) else np.ones(len(first), bool)
        found.append((first[single] + a, end[single] + a))
        total += [len(first), 0, b - a - np.count_nonzero(kinds & _INNER), np.count_nonzero(kinds & _CAPITAL), np.count_nonzero(kinds & _SYMBOL)]
        a = b
    if found:
        first, end = (np.concatenate(x) for x in zip(*found, strict=True))
        _, repeat, unsure = _grouped(raw, first, end, np.zeros(len(first), np.int64), 1)
        total[1] = len(_words_of(raw, first, end)) if len(unsure) else len(first) - np.count_nonzero(repeat)
    return total


def masks(stats: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that fail, of the rows of `scan`."""
    words, distinct, points, capitals, symbols = stats
    failed = [words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes and eight more, offsets) of an array of strings without nulls, whose bytes lie one after the other."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if data is not None:
        raw[:-8] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def _scanned(rows: DataFrame, piece: int) -> DataFrame:
    """(id, part, mask, key) of rows(id, part, text) without null texts. key: 128 bits of the text."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch, "text", piece):
                part = batch.slice(a, b - a)
                raw, offsets = _buffer(part.column("text"))
                stats = scan_long(raw, len(raw) - 8, piece)[:, None] if b - a == 1 and len(raw) > 2 * piece else scan(raw, offsets)
                keys = [hashlib.sha256(raw[x:y].data).digest()[:16] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("part"), pa.array(masks(stats), pa.int32()), pa.array(keys, pa.binary())], names=["id", "part", "mask", "key"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, part string, mask int, key binary")


def _matrices() -> dict[str, np.ndarray]:
    """(orders x steps, masks) weights with which the counts of masks are summed."""
    m = np.arange(MASKS)
    ones = np.array([x.bit_count() for x in range(MASKS)])
    out: dict[str, list] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in ORDERS:
        before = 0
        for letter in order:
            own = 1 << FILTERS.index(letter)
            fails, gone = m & own != 0, m & before != 0
            out["kept"].append(~fails & ~gone)
            out["removed"].append(fails & ~gone)
            out["redundant"].append(fails & gone)
            out["unique_fails"].append(m == own)
            # of the orders, in as many as fall to each failing filter this one comes first
            out["shapley"].append(np.where(fails, len(ORDERS) // np.maximum(ones, 1), 0))
            before |= own
    return {k: np.array(v).astype(np.int64) for k, v in out.items()}


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", piece: int = PIECE) -> DataFrame:
    """One row per (part, filter_order, step): part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts count as empty, a null part as the empty string. E holds a text against those of all smaller ids of the
    whole table; repeated ids aren't smaller than each other, and a null id is neither smaller nor larger than any. A document
    with several labels is good or toxic if one of them says so; labels of no document and null ids of labels do nothing.
    Repeated rows count each. A long text is scanned in pieces and counted whole. Of an empty table there are no parts
    and so no rows. Further columns of docs and labels aren't read, whatever their names.
    """
    # a window of rows by text would meet in one task where a text is common: the least id is aggregated and joined back
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    scanned = stored(_scanned(rows, piece), "scanned")
    firsts = scanned.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    flag = lambda c: F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).cast("int"))
    known = labels.select(F.col(f"`{id_col}`").alias("label_id"), "quality", "toxic").groupBy("label_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    judged = scanned.join(firsts, "key", "left").join(known, F.col("id") == F.col("label_id"), "left")
    mask = F.col("mask") + F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    counted = judged.select("part", mask.alias("mask"), "good", "toxic").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most
    return _reduced(parts)


def _reduced(parts: DataFrame) -> DataFrame:
    matrices = _matrices()
    steps = len(FILTERS)
    lost = {"good_lost": ("removed", 1), "toxic_lost": ("removed", 2)}
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    orders = pa.array([o for o in ORDERS for _ in o])
    places = pa.array(list(range(1, steps + 1)) * len(ORDERS), pa.int32())
    letters = pa.array([f for o in ORDERS for f in o])

    def run(batches):
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held = np.zeros((3, MASKS), np.int64)  # documents, good ones, toxic ones
                for c in counts:
                    held[:, c["mask"]] += [c["n"], c["good"], c["toxic"]]
                sums = [matrices[lost.get(c, (c, 0))[0]] @ held[lost.get(c, (c, 0))[1]] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders)), orders, places, letters, *[pa.array(s) for s in sums]], names=["part", "filter_order", "step", "filter", *columns])

    return arrow_map(parts, run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} bigint" for c in columns))
