"""Ids of whole texts as the tokenizers library gives them, with a bounded cache of chunks in front of it.

Both vocabularies split texts at white space before merging, so a text's ids are those of its
chunks, one after the other. Only unseen chunks are sent to the library. Where
a text holds something that reaches across chunks (runs of white space for the byte-level pattern,
strings of special tokens, unusual separators), the whole text goes to the library instead.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tessera.llm.bpe import Chunks, byte_alphabet
from tessera.llm.common import quiet_tokenizers

#: Chunks that a worker remembers.
CACHE = 1_200_000
#: The split patterns of the two kinds of file, for chunks of Latin letters.
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
_BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
#: Beyond Latin letters, space and line feed: the library's own tables decide.
_BEYOND = re.compile("[^\n -~\xa1-\u024f]").search

_WHITE = "[\\s\x0b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What reaches across chunks of the byte-level pattern: a space before white space, runs of three, runs at the end.
_REACHING = f"[\x1c-\x1f]| {_WHITE}|{_WHITE}{{3}}|{_WHITE}{{2}}$"


class LibraryIds:
    def __init__(self, path: str, most: int = CACHE):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library.no_padding()
        self.library.no_truncation()
        kinds = json.dumps(spec["pre_tokenizer"])
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.byte_level = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.words = not self.byte_level and '"Split"' in kinds and '"invert": true' in kinds and "\\\\s\\\\p{L}" in kinds
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if size <= 1 << 16 else "I"
        self.model, self.pieces = self.library.model, _WORD_PIECES if self.words else _BYTE_PIECES
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.known = Chunks(self._chunk, most)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that isn't known: Latin ones are split here, and each piece goes to the library's merging; others go whole."""
        if chunk.isascii():  # a word, or one with a comma or full stop behind it
            body = chunk[1:] if chunk[:1] == " " else chunk
            if body.isalpha():
                if self.words and not chunk.islower():
                    return self.known[chunk.lower()]
                return self._merged("Ġ" + body if body is not chunk else chunk)
            if body[-1:] in (",", ".") and body[:-1].isalpha():
                return self.known[chunk[:-1]] + self.known[chunk[-1]]
        if _BEYOND(chunk) or not chunk:
            return self._library(chunk)
        pieces = self.pieces(chunk.lower() if self.words else chunk)
        if pieces != [chunk]:
            return b"".join(map(self.known.__getitem__, pieces))
        if not chunk.isascii() or not chunk.isalnum():
            chunk = "Ġ" + chunk[1:] if chunk[0] == " " and chunk[1:].isalnum() and chunk.isascii() else chunk.encode().decode("latin-1").translate(self.alphabet)
        return self._merged(chunk)

    def _merged(self, piece: str) -> bytes:
        return array(self.code, [x.id for x in self.model.tokenize(piece)]).tobytes()

    def encode_column(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, `end` behind each, one after the other; how many each has). Null counts as empty.

        Chunks are cut and numbered by Arrow, so that each different one of a block is looked up once; their ids are then gathered at once.
        """
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not (self.words or self.byte_level):
            raw = [self._library(t) for t in texts.to_pylist()]
            flat, sizes = np.frombuffer(b"".join(raw), self.dtype), np.array([len(x) // self.dtype.itemsize for x in raw], np.int64)
        else:
            odd = pc.match_substring_regex(texts, "[\x1c-\x1f]" if self.words else _REACHING)
            for x in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, x))
            plain = pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts
            # where no odd run is about, a line feed begins a chunk as a space does; it is marked by a character that only odd texts hold
            cut = pc.ascii_split_whitespace(plain) if self.words else pc.split_pattern(pc.replace_substring(plain, "\n", " \x1d"), " ")
            at = cut.offsets.to_numpy().astype(np.int64)
            coded = cut.flatten().dictionary_encode()
            which, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if self.words:
                found = list(map(self.known.__getitem__, words))
            else:  # chunks but the first of a text begin with the space before them
                known = self.known
                found = [known["\n" + x[1:] if x[:1] == "\x1d" else " " + x] for x in words] + [known[words[k]] for k in which[at[:-1] - at[0]]]
                which = which.copy()
                which[at[:-1] - at[0]] = len(words) + np.arange(n)
            at -= at[0]
            size = self.dtype.itemsize
            own = np.fromiter(map(len, found), np.int64, len(found)) // size
            pool, starts = np.frombuffer(b"".join(found), self.dtype), np.cumsum(own) - own
            sizes = own[which]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            # a block's places fit 32 bits
            place = np.repeat((starts[which] - upto[:-1]).astype(np.int32), sizes)
            place += np.arange(upto[-1], dtype=np.int32)
            flat = pool[place]
            sizes = upto[at[1:]] - upto[at[:-1]]
            if plain is not texts:
                parts = np.split(flat, np.cumsum(sizes)[:-1])
                for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                    parts[k] = np.frombuffer(self._library(texts[k].as_py()), self.dtype)
                flat, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        sizes = sizes + 1
        out = np.empty(len(flat) + n, self.dtype)
        last = np.cumsum(sizes) - 1
        inside = np.ones(len(out), bool)
        inside[last] = False
        out[inside], out[last] = flat, end
        return out, sizes


_KEPT: dict[tuple[str, int], LibraryIds] = {}


def library_ids(path: str, most: int = CACHE) -> LibraryIds:
    """A worker reads each file once. most: chunks that it remembers, also while it waits for the next stage's tasks."""
    if (path, most) not in _KEPT:
        _KEPT[path, most] = LibraryIds(path, most)
    return _KEPT[path, most]
