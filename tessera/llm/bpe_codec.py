"""Operator 2, BPE encoding and decoding: a contiguous rank array for each short word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.bpe import Chunks, chunk_lists, ids_by_scan, vocabulary
from tessera.llm.common import arrow_map, blocks, texts_of, with_columns

#: Chunks that a worker remembers.
CACHE = 400_000
_CACHES: dict[str, Chunks] = {}


def _encoded(path: str) -> Chunks:
    """From chunk to its ids as little-endian unsigned 32-bit integers."""
    if path not in _CACHES:
        v = vocabulary(path)
        words = Chunks(lambda piece: np.array(ids_by_scan(v.symbols(piece), v.merges), "<u4").tobytes(), CACHE // 4)
        _CACHES[path] = Chunks(lambda chunk: b"".join([words[p] for p in v.pieces(chunk)]), CACHE)
    return _CACHES[path]


def encode(path: str, text: str) -> bytes:
    """The ids of a text, little-endian unsigned 32-bit; special tokens' strings become their own ids."""
    v, chunks_of = vocabulary(path), _encoded(path)
    out = []
    for special, chunks in chunk_lists(v, text):
        out.append(np.array([v.special[chunks[0]]], "<u4").tobytes() if special else b"".join(map(chunks_of.__getitem__, chunks)))
    return b"".join(out)


_TOKENS: dict[str, np.ndarray] = {}


def decode(path: str, ids: bytes) -> str:
    """The text of ids as the library gives it for a file without a decoder: tokens with a space between, special ones included."""
    if path not in _TOKENS:
        v = vocabulary(path)
        names = np.empty(max(v.tokens) + 1, object)
        for i, t in v.tokens.items():
            names[i] = t
        _TOKENS[path] = names
    return " ".join(_TOKENS[path][np.frombuffer(ids, "<u4")].tolist())


def bpe_codec(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: its id, the number of ids, the ids' and the decoded text's SHA-256 and, where `keep`, both themselves.

    tokenizer: path of a word-end BPE file of the tokenizers library, present on each machine.
    Null and empty texts encode to no ids and decode to the empty text. Rows are neither joined nor
    reordered: ties, repeated rows and null ids pass through; other columns are not read. One pass, no shuffle.
    """

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch, "text"):
                part = batch.slice(a, b - a)
                ids = [encode(tokenizer, t) for t in texts_of(part, "text")]
                said = [decode(tokenizer, x) for x in ids]
                extra = [
                    ("n_tokens", pa.array([len(x) // 4 for x in ids], pa.int64())),
                    ("ids_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())),
                    ("decoded_sha256", pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said], pa.string())),
                ]
                if keep:
                    extra += [("ids", pa.array(ids, pa.binary())), ("decoded", pa.array(said, pa.string()))]
                yield with_columns(part, ["id"], extra)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids binary, decoded string" if keep else ""
    out = arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)
