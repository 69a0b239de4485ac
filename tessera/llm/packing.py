"""Operator 9, packing: non-negative least squares over the lengths of pieces, then greedy packing of what is left.

Each task works through its rows in blocks of bounded size. A document's full windows are sequences
of their own. The remainders' histogram is then matched by combinations of two or three lengths that
fill a window exactly: repeat counts x >= 0 that minimise |A x - histogram| are found by projected
gradient, rounded down and trimmed so that no length is used more often than it occurs. What no
combination takes is laid end to end, cut at the window's end, and carried to the next block; the
last carried tokens of a task are cut into sequences of powers of two, which need no padding.
No shuffle and nothing global: a sequence's id holds its task's number and its number in the task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map, blocks
from tessera.llm.library_ids import CACHE, library_ids

#: Combinations of three lengths are enumerated where the shortest is a multiple of this.
STEP = 16
#: Sequences in a task have numbers below this.
_TASK = 1 << 40


@lru_cache(4)
def combinations(window: int) -> np.ndarray:
    """Ascending length triples that fill a window exactly; pairs have 0 as their first length."""
    rows = [np.stack([np.zeros(window // 2, np.int64), np.arange(1, window // 2 + 1), window - np.arange(1, window // 2 + 1)], 1)]
    for a in range(STEP, window // 3 + 1, STEP):
        b = np.arange(a, (window - a) // 2 + 1)
        rows.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(rows)


def repeat_counts(histogram: np.ndarray, window: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, how often each is used): non-negative least squares, rounded so that no length is overdrawn.

    histogram[k]: pieces of length k, 0 < k < window.
    """
    sets = combinations(window)
    have = histogram > 0
    have[0] = True
    sets = sets[have[sets].all(1)]
    if not len(sets):
        return sets, np.zeros(0, np.int64)
    goal = histogram.astype(float)
    goal[0] = 0

    def product(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(sets[:, k], x, len(goal)) for k in range(3))
        y[0] = 0
        return y

    # the step is 1 / (a bound of the largest eigenvalue of A'A): rows' sums times columns' sums
    step = 1 / (3 * max(1.0, product(np.ones(len(sets))).max()))
    x = np.zeros(len(sets))
    y, t = x, 1.0
    for _ in range(rounds):
        gap = product(y) - goal
        gap[0] = 0
        new = np.maximum(0, y - step * gap[sets].sum(1))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(sets), np.int64)
    # rounding: the largest solved counts first, each as often as solved; then once more for what is left
    order = np.argsort(-x, kind="stable")
    for most in (np.floor(x[order] + 0.5).astype(np.int64), None):
        for k, i in enumerate(order.tolist()):
            own = [z for z in sets[i].tolist() if z]
            uses = {z: own.count(z) for z in own}
            n = min(left[z] // m for z, m in uses.items())
            n = min(n, int(most[k])) if most is not None else n
            if n > 0:
                counts[i] += n
                for z, m in uses.items():
                    left[z] -= n * m
    return sets[counts > 0], counts[counts > 0]


class Packer:
    """Packs one task's documents. add() and finish() give rows (document, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, task: int):
        if window < 8 or window & (window - 1):
            raise ValueError("window: a power of two from 8 on")
        self.window, self.next = window, task * _TASK
        self.carried: list[tuple] = []

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, documents: list[tuple[object, np.ndarray]]) -> list[tuple]:
        w, out, rest = self.window, [], defaultdict(list)
        for name, ids in documents:
            n = len(ids)
            full = n // w * w
            for a in range(0, full, w):
                out.append((name, a, ids[a : a + w], n, self._sequence(), 0))
            if full < n:
                rest[n - full].append((name, full, ids[full:], n))
        for piece in self.carried:  # carried pieces take part again
            rest[len(piece[2])].append(piece)
        histogram = np.zeros(w, np.int64)
        for k, v in rest.items():
            histogram[k] = len(v)
        sets, counts = repeat_counts(histogram, w)
        for own, n in zip(sets.tolist(), counts.tolist(), strict=True):
            for _ in range(n):
                s, at = self._sequence(), 0
                for k in own:
                    if k:
                        name, start, ids, total = rest[k].pop()
                        out.append((name, start, ids, total, s, at))
                        at += k
        # greedy: the longest first, end to end, cut where the window ends
        left = [p for k in sorted(rest, reverse=True) for p in rest[k]]
        room, self.carried = sum(len(p[2]) for p in left) // w * w, []
        at, s = 0, -1
        for name, start, ids, total in left:
            while len(ids) and room:
                if at == 0:
                    s = self._sequence()
                take = min(len(ids), w - at)
                out.append((name, start, ids[:take], total, s, at))
                start, ids, at, room = start + take, ids[take:], (at + take) % w, room - take
            if len(ids):
                self.carried.append((name, start, ids, total))
        return out

    def finish(self) -> list[tuple]:
        """What is carried goes to sequences of powers of two, the largest first."""
        n, out = sum(len(p[2]) for p in self.carried), []
        size, at, s = 0, 0, -1
        for name, start, ids, total in self.carried:
            while len(ids):
                if at == size:
                    size, at, s = 1 << (n.bit_length() - 1), 0, self._sequence()
                take = min(len(ids), size - at)
                out.append((name, start, ids[:take], total, s, at))
                start, ids, at, n = start + take, ids[take:], at + take, n - take
        self.carried = []
        return out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, chunks: int = CACHE) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with `keep`, the ids themselves.

    Each document is its ids with `end_id` behind; null and empty texts are the end id alone. Each id
    lies in exactly one piece; sequences are full windows but for at most a few of each task, whose
    totals are smaller powers of two, so nothing is padded. A very long text is encoded whole and cut into windows. Ties, repeated rows and null ids pass
    through; other columns are not read. Rows of an empty table give no rows. chunks: how many a worker remembers.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        source, packer = library_ids(tokenizer, chunks), Packer(window, TaskContext.get().partitionId())
        id_type = None

        def table(rows):
            names, starts, ids, totals, sequences, offsets = zip(*rows, strict=True)
            raw = [x.astype("<u4").tobytes() for x in ids]
            long = lambda x: pa.array(x, pa.int64())
            columns = [pa.array(names, id_type), long(starts), long([len(x) for x in ids]), long([zlib.crc32(x) for x in raw]), long(totals), long(sequences), long(offsets), *([pa.array(raw, pa.binary())] if keep else [])]
            return pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep else [])])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for a, b in blocks(batch, "text", block_bytes):
                part = batch.slice(a, b - a)
                flat, sizes = source.encode_column(part.column("text"), end_id)
                ids = np.split(flat, np.cumsum(sizes)[:-1])
                if rows := packer.add(list(zip(part.column("id").to_pylist(), ids, strict=True))):
                    yield table(rows)
        if rows := packer.finish():
            yield table(rows)

    out = arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * keep)
    return out.withColumnRenamed("id", id_col)
