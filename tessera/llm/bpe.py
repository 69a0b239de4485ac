"""Byte-pair encoding over the word vocabulary: shared reading of its file, splitting of texts into words, and both merge loops.

Texts are cut at white space into chunks. The normaliser (NFC, lower case) and the pre-tokeniser
never look across white space, so each chunk has its own result, and a bounded cache of chunks
spares nearly all merging. Chunks beyond ASCII are normalised and split by the tokenizers library
itself, so its Unicode tables hold.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable

import regex

from tessera.llm.common import quiet_tokenizers

#: Restatements of the file's split pattern for chunks without white space, all letters lower case.
_ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_LATIN_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+").findall
#: Beyond Latin letters, which are all composed, or white space of any kind: the library's own tables decide.
_BEYOND = re.compile("[^!-~\xa1-\u024f]").search
#: White space for Python's split() but not for the vocabulary's pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]").search
_PLACE = (1 << 40) - 1
_END = "</w>"
_NONE = 1 << 62


class Vocabulary:
    """What a tokenizers JSON file of the word-end BPE kind holds, laid out for merging."""

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END or spec["decoder"] is not None:
            raise ValueError(f"{path} is no BPE vocabulary with word ends")
        self.library = Tokenizer.from_file(path)
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        #: left << 20 | right -> rank << 20 | merged
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.ids[left] << 20 | self.ids[right], rank << 20 | self.ids[left + right])
        alphabet = byte_alphabet()
        self.text_as_bytes = {c: b for b, c in enumerate(alphabet)}
        self.first, self.last = [self.ids[c] for c in alphabet], [self.ids[c + _END] for c in alphabet]

    def pieces(self, chunk: str) -> list[bytes]:
        """The words of a chunk (or of any text), lower-cased, as bytes."""
        if not _BEYOND(chunk):
            return _ASCII_PIECES(chunk.lower().encode()) if chunk.isascii() else [x.encode() for x in _LATIN_PIECES(chunk.lower())]
        normal = self.library.normalizer.normalize_str(chunk)
        return [bytes(map(self.text_as_bytes.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def symbols(self, piece: bytes) -> list[int]:
        """Ids of a word's initial symbols, one for each byte, the last one with the word end."""
        found = [*map(self.first.__getitem__, piece)]
        found[-1] = self.last[piece[-1]]
        return found


def byte_alphabet() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


def count_by_heap(symbols: list[int], merges: dict[int, int]) -> int:
    """Tokens of one word: a heap of adjacent pairs by rank, then place, over a doubly linked list of symbols.

    Only the number of merges is kept: the count is the initial symbols less the merges.
    """
    return len(symbols) - _merge_by_heap(list(symbols), merges)


def ids_by_heap(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """The ids of one word by the same heap; for words too long for scanning."""
    own = list(symbols)
    _merge_by_heap(own, merges)
    return [x for x in own if x >= 0]


def _merge_by_heap(own: list[int], merges: dict[int, int]) -> int:
    """Merge in place and say how often; a symbol that is merged into its left neighbour becomes -1."""
    n = len(own)
    get, push, pop = merges.get, heapq.heappush, heapq.heappop
    heap = [(m >> 20) << 40 | i for i, pair in enumerate(zip(own, own[1:])) if (m := get(pair[0] << 20 | pair[1])) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merged = 0
    while heap:
        top = pop(heap)
        i = top & _PLACE
        j = after[i]
        if own[i] < 0 or j >= n:
            continue
        m = get(own[i] << 20 | own[j])
        if m is None or m >> 20 != top >> 40:
            continue  # the pair has changed since it was pushed
        made = own[i] = m & 0xFFFFF
        own[j] = -1
        merged += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (m := get(made << 20 | own[k])) is not None:
                push(heap, (m >> 20) << 40 | i)
        h = before[i]
        if h >= 0 and (m := get(own[h] << 20 | made)) is not None:
            push(heap, (m >> 20) << 40 | h)
    return merged


#: Words of more symbols go by the heap: scanning takes time with the square of the length.
SCAN_SYMBOLS = 96


def ids_by_scan(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """The ids of one short word: contiguous arrays of parts and of the ranks of adjacent parts, scanned for the least."""
    if len(symbols) > SCAN_SYMBOLS:
        return ids_by_heap(symbols, merges)
    parts = list(symbols)
    get = merges.get
    ranks = [get(parts[i] << 20 | parts[i + 1], _NONE) for i in range(len(parts) - 1)]
    while ranks:
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        parts[i] = least & 0xFFFFF
        del parts[i + 1], ranks[i]  # the boundary between the two goes
        if i < len(ranks):
            ranks[i] = get(parts[i] << 20 | parts[i + 1], _NONE)
        if i:
            ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], _NONE)
    return parts


class Chunks(dict):
    """A bounded cache from chunk to result. Once full it keeps what it has, and starts anew after as many misses as entries:
    frequent chunks come early, and texts of another kind still get their turn."""

    def __init__(self, make: Callable[[str], object], most: int):
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, chunk: str):
        made = self.make(chunk)
        if len(self) < self.most:
            if len(chunk) <= 64:
                self[chunk] = made
        else:
            self.missed += 1
            if self.missed >= self.most:
                self.clear()
                self.missed = 0
        return made


def chunk_lists(vocabulary: Vocabulary, text: str) -> list[tuple[bool, list[str]]]:
    """A text as (special, chunks) runs. Special tokens' strings stand for themselves; other runs are cut at white space."""
    if "<|" not in text:
        return [(False, text.split() if not _ODD_SPACE(text) else [text])]
    out = []
    for k, run in enumerate(vocabulary.split_special(text)):
        if k % 2:
            out.append((True, [run]))
        elif run:
            out.append((False, run.split() if not _ODD_SPACE(run) else [run]))
    return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A worker reads each file once."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]
