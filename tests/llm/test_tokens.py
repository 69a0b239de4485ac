"""Operators 1, 2, 5 and 9 against the tokenizers library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import Vocabulary, count_by_heap, ids_by_heap, ids_by_scan
from tessera.llm.bpe_codec import bpe_codec
from tessera.llm.packing import Packer, pack, repeat_counts
from tessera.llm.token_counts import token_counts
from tessera.llm.wavelet import WaveletFile, read_shards, write_file, write_shards

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def u32(x):
    return np.array(x, "<u4").tobytes()


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in ((r.doc_id, r.text or "") for r in docs.collect()):
        n = len(library.encode(t, add_special_tokens=False).ids)
        want[i, len(t.encode()), n, n > 2048] += 1
    assert Counter(map(tuple, token_counts(docs, WORDS).collect())) == want
    assert token_counts(empty, WORDS).count() == 0


def test_codec(docs, empty):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in docs.collect():
        x = library.encode(r.text or "", add_special_tokens=False).ids
        said = library.decode(x, skip_special_tokens=False)
        want[r.doc_id, len(x), hashlib.sha256(u32(x)).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), u32(x), said] += 1
    assert Counter((*r[:4], bytes(r[4]), r[5]) for r in bpe_codec(docs, WORDS).collect()) == want
    assert bpe_codec(empty, WORDS).count() == 0


def test_merge_loops_agree():
    v = Vocabulary(WORDS)
    for word in [b"a", b"unbelievable", b"aaaaaaaaaaaaaaaaaaaaaaa", b"internationalization" * 3, "éèê".encode() * 20]:
        s = v.symbols(word)
        assert ids_by_scan(s, v.merges) == ids_by_heap(s, v.merges)
        assert count_by_heap(s, v.merges) == len(ids_by_scan(s, v.merges))


def test_wavelet_output(docs, empty):
    shards = write_shards(docs, WORDS)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in read_shards(shards).collect())
    want = Counter((r.doc_id, u32([*ids(WORDS, r.text), 2])) for r in docs.select("doc_id", "text").collect())
    assert Counter((i, x) for _, i, _, _, x in got) == want
    at = 0
    for start, _, n, crc, x in got:
        assert (start, n, crc) == (at, len(x) // 4, zlib.crc32(x))
        at += n
    named = [i for _, i, *_ in got if i is not None]
    assert named == sorted(named)
    assert read_shards(write_shards(empty, WORDS)).count() == 0


@pytest.mark.parametrize("n,most", [(0, 1), (1, 1), (700, 3), (5000, 49_407), (4096, 1)])
def test_wavelet_file(n, most):
    x = np.random.default_rng(n).integers(0, most + 1, n).astype(np.uint16)
    f = WaveletFile(write_file(pa.array([7], pa.int64()), [n], x))
    assert (f.tokens() == x).all() and f.names.to_pylist() == [7]
    for i in range(0, n, max(1, n // 40)):
        token = int(x[i])
        where = np.flatnonzero(x == token)
        assert f.access(i) == token
        assert f.count(token) == len(where) and f.count(token, i) == (where < i).sum()
        k = int((where < i).sum())
        assert f.find(token, k) == i and f.find(token, len(where)) == -1
    assert f.count(60_000) == 0 and f.find(60_000) == -1


def check_pieces(rows, want):
    """rows: (id, start, ids, total, sequence, offset); want: how many ids there are."""
    by_sequence = defaultdict(list)
    for _, _, x, _, s, at in rows:
        by_sequence[s].append((at, len(x)))
    padding = 0
    for own in by_sequence.values():
        end = 0
        for at, n in sorted(own):
            assert at == end and n > 0
            end += n
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding == 0
    assert sum(len(r[2]) for r in rows) == want


def test_pack(docs, empty):
    rows = pack(docs, BYTES).collect()
    want = Counter((r.doc_id, u32([*ids(BYTES, r.text), 0])) for r in docs.select("doc_id", "text").collect())
    check_pieces([(r.doc_id, r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens, r.sequence_id, r.offset) for r in rows], sum(len(x) // 4 for _, x in want.elements()))
    assert all(r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    once = {i: x for (i, x), n in want.items() if n == 1 and i is not None and sum(m for (j, _), m in want.items() if j == i) == 1}
    for i, x in once.items():
        own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == i)
        assert b"".join(b for _, b in own) == x and [a for a, _ in own] == [sum(len(b) // 4 for _, b in own[:k]) for k in range(len(own))]
    assert pack(empty, BYTES).count() == 0


@pytest.mark.parametrize("lengths", [[600] * 50, [1], [512] * 7, list(range(1, 1024)), [1024, 2048, 5000, 3], [1, 1023] * 9 + [300, 300, 424]])
def test_packer(lengths):
    docs = [(i, np.full(n, i % 60_000, np.uint16)) for i, n in enumerate(lengths)]
    p = Packer(1024, 3)
    rows = p.add(docs[: len(docs) // 2]) + p.add(docs[len(docs) // 2 :]) + p.finish()
    check_pieces(rows, sum(lengths))
    for i, x in docs:
        assert sum(len(r[2]) for r in rows if r[0] == i) == len(x)


def test_repeat_counts_never_overdraw():
    h = np.random.default_rng(1).poisson(3, 1024)
    h[0] = 0
    sets, counts = repeat_counts(h, 1024)
    used = np.zeros(1024, int)
    for own, n in zip(sets, counts, strict=True):
        assert own.sum() == 1024
        for k in own[own > 0]:
            used[k] += n
    assert (used <= h).all() and used.sum() > 0.6 * h.sum()


def test_a_wavelet_file_opens_only_what_it_reads():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 900, 300_000).astype(np.uint32) ** 2 // 900
    f = WaveletFile(write_file(pa.array([7, 8], pa.int64()), [100_000, 200_000], x))
    assert not f.opened
    assert f.access(123_456) == x[123_456]
    pieces, planes = f._pieces, f.bits
    assert pieces == 5 and len(f.opened) <= 1 + 2 * planes  # the alphabet; of each plane its ranks and a piece
    token = int(x[200_000])
    places = np.flatnonzero(x == token)
    for nth in (0, len(places) // 2, len(places) - 1):
        g = WaveletFile(write_file(pa.array([7, 8], pa.int64()), [100_000, 200_000], x))
        assert g.find(token, nth) == places[nth] and g.count(token, 200_001) == (places <= 200_000).sum()
        assert len(g.opened) <= 1 + planes * (2 + 4)  # ranks, one select directory, pieces at the ends of the range and at the place
    assert (f.tokens() == x).all() and f.find(token, len(places)) == -1
    for y in (np.zeros(0, np.uint32), np.full(512, 3, np.uint32), np.arange(513, dtype=np.uint32) % 2):
        h = WaveletFile(write_file(pa.array([1], pa.int64()), [len(y)], y))
        assert (h.tokens() == y).all() and [h.access(i) for i in range(len(y))] == y.tolist()
        assert [h.find(int(t), n) for t in set(y.tolist()) for n in range((y == t).sum())] == [int(p) for t in set(y.tolist()) for p in np.flatnonzero(y == t)]
