"""Operator 5, token-id output: a wavelet matrix for each shard, in one compressed file.

File: magic, length of a JSON header, header, then zstd-compressed parts: the documents' ids (Arrow
stream), the documents' lengths, the alphabet (ids that occur), and for each bit of an id's number in it, highest first,
a rank directory (ones before each 512-bit block), a select directory (the blocks of every 1024th one and zero) and the
bit-plane in pieces of 65,536 bits. Behind plane k come the ids with a 0 in it, then those with a 1, each in their former
order. Parts are decompressed when they are first asked for: a reader that needs one token, one count or one
occurrence opens the directories and at most two pieces of each plane, and reads a block of each.
"""

from __future__ import annotations

import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import arrow_map, blocks, partitions, stored
from tessera.llm.library_ids import library_ids

MAGIC = b"WVMX0002"
#: Tokens after which a shard is closed; documents are not split over shards.
SHARD_TOKENS = 1 << 18
_BLOCK, _PIECE, _STEP = 512, 1 << 16, 1 << 10
#: Parts of a plane before its pieces.
_DIRECTORIES = 3


def build(ids: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """(zeros, packed bits) of each plane, highest bit first."""
    planes, now = [], np.ascontiguousarray(ids)
    for k in range(bits - 1, -1, -1):
        ones = (now >> k & 1).astype(bool)
        zeros = np.flatnonzero(~ones)
        planes.append((len(zeros), np.packbits(ones, bitorder="little")))
        if k:
            now = now[np.concatenate([zeros, np.flatnonzero(ones)])]
    return planes


def write_file(names: pa.Array, lengths: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    """One shard's file. names: the documents' ids; ids: all their tokens, one document after the other."""
    # a shard's own alphabet spares planes: ids are numbered among those that occur
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present)
    codes = (np.cumsum(present, dtype=np.uint32) - 1).astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    bits = max(1, (len(alphabet) - 1).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("id", names.type)])) as out:
        out.write_batch(pa.record_batch([names], names=["id"]))
    parts = [pack(sink.getvalue()), pack(np.asarray(lengths, "<u8").tobytes()), pack(alphabet.astype("<u4").tobytes())]
    planes = build(codes[ids] if len(ids) else np.zeros(0, np.uint16), bits)
    for _, plane in planes:
        ranks = rank_directory(plane, len(ids))
        places = np.arange(len(ranks)) * _BLOCK
        parts += [pack(x.astype("<u4").tobytes()) for x in (ranks, select_directory(ranks), select_directory(np.minimum(places, len(ids)) - ranks))]
        parts += [pack(plane[i : i + _PIECE // 8].tobytes()) for i in range(0, max(1, len(plane)), _PIECE // 8)]
    head = json.dumps({"tokens": len(ids), "bits": bits, "zeros": [z for z, _ in planes], "parts": [len(x) for x in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def rank_directory(plane: np.ndarray, n: int) -> np.ndarray:
    """Ones before each block of a plane of n bits, and in all of it."""
    padded = np.zeros(-(-max(1, n) // _BLOCK) * _BLOCK // 8, np.uint8)
    padded[: len(plane)] = plane
    return np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, _BLOCK // 8).sum(1, dtype=np.int64))])


def select_directory(before: np.ndarray) -> np.ndarray:
    """The block of every _STEP-th bit of a kind, given how many are before each block."""
    return np.searchsorted(before, np.arange(0, int(before[-1]), _STEP), side="right") - 1


class WaveletFile:
    """A reader of one file. opened: the parts that were decompressed so far."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<I", data, 8)
        self.head = json.loads(data[12 : 12 + size])
        self.n, self.bits, self.zeros = self.head["tokens"], self.head["bits"], self.head["zeros"]
        self._data, self._ends = data, (np.cumsum(self.head["parts"]) + 12 + size).tolist()
        self._pieces = max(1, -(-self.n // _PIECE))
        self.opened: dict[int, bytes] = {}

    def _part(self, i: int) -> bytes:
        if i not in self.opened:
            end = self._ends[i]
            self.opened[i] = zstandard.ZstdDecompressor().decompress(self._data[end - self.head["parts"][i] : end])
        return self.opened[i]

    @property
    def names(self) -> pa.ChunkedArray:
        return pa.ipc.open_stream(self._part(0)).read_all().column("id")

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._part(1), "<u8").astype(np.int64)

    @property
    def alphabet(self) -> np.ndarray:
        return np.frombuffer(self._part(2), "<u4")

    def _directory(self, k: int, which: int) -> np.ndarray:
        """Of plane k: 0 the ranks, 1 and 2 the blocks of ones and zeros."""
        return np.frombuffer(self._part(3 + k * (_DIRECTORIES + self._pieces) + which), "<u4")

    def _bits(self, k: int, start: int, end: int) -> np.ndarray:
        """Bits of plane k from a block's start on, within a block."""
        piece, at = divmod(start, _PIECE)
        raw = np.frombuffer(self._part(3 + k * (_DIRECTORIES + self._pieces) + _DIRECTORIES + piece), np.uint8)
        return np.unpackbits(raw[at // 8 : at // 8 + -(-(end - start) // 8)], bitorder="little")[: end - start]

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block, rest = divmod(i, _BLOCK)
        return int(self._directory(k, 0)[block]) + (int(self._bits(k, i - rest, i).sum()) if rest else 0)

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Place in plane k of the nth (from 0) bit of that kind: the directory gives a stretch of blocks, their ranks one block, its bits the place."""
        ranks, samples = self._directory(k, 0), self._directory(k, 1 if bit else 2)
        low = int(samples[nth // _STEP])
        high = int(samples[nth // _STEP + 1]) + 1 if nth // _STEP + 1 < len(samples) else len(ranks) - 1
        before = ranks[low : high + 1].astype(np.int64)
        if not bit:
            before = np.arange(low, high + 1) * _BLOCK - before
        block = low + int(np.searchsorted(before[:-1], nth, side="right")) - 1
        own = self._bits(k, block * _BLOCK, min(self.n, (block + 1) * _BLOCK))
        return block * _BLOCK + int(np.flatnonzero(own == bit)[nth - int(before[block - low])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            ones, block = self._ones(k, i), i - i % _BLOCK
            bit = int(self._bits(k, block, i + 1)[-1])
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return int(self.alphabet[value])

    def _code(self, token: int) -> int:
        """A token's number in the alphabet, -1 if it doesn't occur."""
        alphabet = self.alphabet
        k = int(np.searchsorted(alphabet, token))
        return k if k < len(alphabet) and alphabet[k] == token else -1

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token before place `end` stand behind the last plane; by its number in the alphabet."""
        a, b = 0, end
        if token < 0:
            return 0, 0
        for k in range(self.bits):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (self.bits - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before place `end`, by default in all."""
        a, b = self._range(self._code(token), self.n if end is None else end)
        return b - a

    def find(self, token: int, nth: int = 0) -> int:
        """Place of the nth (from 0) occurrence of a token, -1 if there is none."""
        token = self._code(token)
        a, b = self._range(token, self.n)
        if nth < 0 or a + nth >= b:
            return -1
        i = a + nth
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens, in order: the planes undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            base = 3 + k * (_DIRECTORIES + self._pieces) + _DIRECTORIES
            plane = np.frombuffer(b"".join(map(self._part, range(base, base + self._pieces))), np.uint8)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            was = np.empty(self.n, kind)
            was[np.flatnonzero(~ones)] = now[: self.zeros[k]]
            was[np.flatnonzero(ones)] = now[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            now = was
        return self.alphabet[now]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, each with `end_id` behind it, into wavelet files in ascending order of the id.

    Result, stored in the shared folder by Spark's own commit protocol so that a lost task leaves no
    half file: part, shard (order of the files), n_docs, n_tokens, file. Null ids come first; rows of
    one id are ordered by their text's hash; null and empty texts hold the end id alone. Documents are
    dealt by range of (id, text hash), so repeated ids do not gather in a task; a task holds one shard.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, source = TaskContext.get().partitionId(), library_ids(tokenizer)
        names, held, lengths, shard, n = [], [], [], 0, 0

        def close():
            ids, sizes = np.concatenate(held), np.concatenate(lengths)
            file = write_file(pa.concat_arrays(names), sizes, ids)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_docs": len(sizes), "n_tokens": len(ids), "file": file}], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())]))

        for batch in batches:
            for a, b in blocks(batch, "text", 4 << 20):
                rows = batch.slice(a, b - a)
                names.append(rows.column("id"))
                ids, sizes = source.encode_column(rows.column("text"), end_id)
                held.append(ids)
                lengths.append(sizes)
                n += len(ids)
                if n >= SHARD_TOKENS:
                    yield close()
                    names, held, lengths, shard, n = [], [], [], shard + 1, 0
        if held:
            yield close()

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return stored(arrow_map(rows, run, "part int, shard int, n_docs bigint, n_tokens bigint, file binary"), "wavelet").withMetadata("file", {"id_type": kind})


def read_shards(shards: DataFrame, id_col: str = "doc_id", keep: bool = True) -> DataFrame:
    """Per document, from the files alone: its id, start (tokens of all documents before it), n_tokens, crc32 and, with `keep`, the ids.

    Starts need the tokens of each partition only: one row for each partition of the writer, broadcast.
    """
    kind = shards.schema["file"].metadata["id_type"]
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    order = Window.partitionBy("part").orderBy("shard")
    starts = shards.select("part", "shard", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("shard_start")).join(F.broadcast(before), "part")
    starts = starts.select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("before"))

    def run(batches):
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "file")), strict=True):
                file = WaveletFile(data)
                ids, lengths = file.tokens(), file.lengths
                ends = np.cumsum(lengths)
                begins = ends - lengths
                raw = [ids[a:b].data for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(raw)
                columns = [file.names.combine_chunks(), pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(begins), pa.array(lengths), pa.array([zlib.crc32(x) for x in raw], pa.int64()), *([pa.array([x.tobytes() for x in raw], pa.binary())] if keep else [])]
                for a in range(0, n, 2000):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 2000) for x in columns], names=["id", "part", "shard", "at", "n_tokens", "ids_crc32", *(["ids"] if keep else [])])

    read = arrow_map(shards.select("part", "shard", "file"), run, f"id {kind}, part int, shard int, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep)
    return read.join(starts, ["part", "shard"]).select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep else []))
