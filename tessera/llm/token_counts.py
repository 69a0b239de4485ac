"""Operator 1, token counts: heap-and-linked-list byte-pair merging that counts and emits no ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.bpe import Chunks, chunk_lists, count_by_heap, vocabulary
from tessera.llm.common import arrow_map, blocks, texts_of, with_columns

#: Chunks that a worker remembers.
CACHE = 700_000
_CACHES: dict[str, Chunks] = {}


def _counts(path: str) -> Chunks:
    if path not in _CACHES:
        v = vocabulary(path)
        words = Chunks(lambda piece: count_by_heap(v.symbols(piece), v.merges), CACHE // 4)
        _CACHES[path] = Chunks(lambda chunk: sum([words[p] for p in v.pieces(chunk)]), CACHE)
    return _CACHES[path]


def count_text(path: str, text: str) -> int:
    """Tokens of one text."""
    v, counts = vocabulary(path), _counts(path)
    total = 0
    for special, chunks in chunk_lists(v, text):
        total += 1 if special else sum(map(counts.__getitem__, chunks))
    return total


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, UTF-8 bytes, tokens, and whether the tokens exceed `limit`.

    tokenizer: path of a word-end BPE file of the tokenizers library, present on each machine.
    Null and empty texts have 0 bytes and 0 tokens. Rows are neither joined nor reordered, so ties,
    repeated rows and null ids pass through; other columns are not read. One pass, no shuffle.
    """

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch, "text"):
                part = batch.slice(a, b - a)
                texts = texts_of(part, "text")
                n = [count_text(tokenizer, t) for t in texts]
                sizes = [len(t.encode()) for t in texts]
                yield with_columns(part, ["id"], [("n_bytes", pa.array(sizes, pa.int64())), ("n_tokens", pa.array(n, pa.int64())), ("over_limit", pa.array([x > limit for x in n]))])

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
