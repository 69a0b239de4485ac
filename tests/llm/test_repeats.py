"""Operator 7 against brute force over all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm.repeats import GRAM, anchors, drop_repeats, repeat_spans, without_repeats
from tessera.llm.suffix_array import Shard, repeated


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(d)]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(300)] + ["é", "ñandú"]
    say = lambda k: " ".join(rng.choice(words, k))
    shared = [say(40) for _ in range(4)]
    texts = []
    for i in range(n):
        t = say(int(rng.integers(0, 80)))
        if i % 3 == 0:
            t += shared[i % 4] + say(10)
        if i % 7 == 0:
            t += shared[(i + 1) % 4][5:]
        if i % 5 == 0 and texts:
            t = texts[-1][: len(texts[-1]) // 2] + "#" + texts[-1][len(texts[-1]) // 2 :]
        texts.append(t)
    return texts + [texts[0], texts[3], "ab" * 200, "z" * 333, "", None]


@pytest.mark.parametrize("seed,length,split", [(1, 60, 4000), (2, 100, 3)])
def test_drop_repeats(spark, seed, length, split):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in drop_repeats(docs, length, split).collect()}
    assert got == dict(enumerate(brute(texts, length)))
    assert sum(r[1] for r in got.values()) > 0


def test_odd_rows(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    # long texts are judged by their starts of 400 bytes as any other
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 400), strict=True))
    assert drop_repeats(docs, carry=["doc_id", "n_tokens"]).schema["carried"].dataType.names == ["doc_id", "n_tokens"]
    assert Counter(tuple(r)[:5] for r in drop_repeats(docs).collect()) == want
    assert drop_repeats(empty).count() == 0
    kept = without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert Counter(r.text is None for r in kept.collect()) == Counter(r.text is None for r in rows)


def test_split_characters_go_whole(spark):
    shared = "ü" * 300
    docs = spark.createDataFrame([(1, "a" + shared + "b"), (2, "\u0162" + shared + "c"), (3, "clean \ufffd")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert got == {1: "ab", 2: "\u0162c", 3: "clean \ufffd"}


def test_equal_strings_share_anchors(monkeypatch):
    monkeypatch.setattr("tessera.llm.repeats.SEGMENT", 50)
    data, length = b"abcabcabd" * 30 + bytes(range(200)) + b"abcabcabd" * 30, 40
    of = {}
    for gram, at, first, last in anchors(data, length):
        for g, q, a, b in zip(gram.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
            for p in range(a, b + 1):
                assert p <= q <= p + length - GRAM
                assert of.setdefault(data[p : p + length], (g, q - p)) == (g, q - p)
    assert len(of) == len({data[p : p + length] for p in range(len(data) - length + 1)})


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(60):
        regions = [bytes(rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, 50)), np.uint8)) for _ in range(int(rng.integers(1, 8)))]
        regions += [r[: max(1, len(r) // 2)] for r in regions]
        shard, base = Shard(regions), np.cumsum([0, *map(len, regions)])
        suffixes = sorted((r[k:], j, int(base[j]) + k) for j, r in enumerate(regions) for k in range(len(r)))
        order = shard.suffixes()
        assert order.tolist() == [x[2] for x in suffixes]
        common = shard.common(order).tolist()
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1][0], suffixes[k][0]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        seen = Counter(r[k : k + 5] for r in regions for k in range(len(r) - 4))
        assert [x.tolist() for x in repeated(regions, 5)] == [[k for k in range(len(r) - 4) if seen[r[k : k + 5]] > 1] for r in regions]


@pytest.mark.parametrize("step", [2, 4])
def test_suffix_array_of_symbols(step):
    rng = np.random.default_rng(step)
    for _ in range(60):
        kinds = [bytes(rng.integers(0, 3, step, np.uint8)) for _ in range(3)]
        regions = [b"".join(kinds[k] for k in rng.integers(0, 3, rng.integers(1, 40))) for _ in range(int(rng.integers(1, 8)))]
        regions += [r[: max(1, len(r) // step // 2) * step] for r in regions]
        shard, base = Shard(regions, step), np.cumsum([0, *map(len, regions)])
        suffixes = sorted((r[k:], j, int(base[j]) + k) for j, r in enumerate(regions) for k in range(0, len(r), step))
        order = shard.suffixes()
        assert order.tolist() == [x[2] for x in suffixes]
        common = shard.common(order).tolist()
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1][0], suffixes[k][0]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        wide = 3 * step
        seen = Counter(r[k : k + wide] for r in regions for k in range(0, len(r) - wide + 1, step))
        assert [x.tolist() for x in repeated(regions, wide, step)] == [[k for k in range(0, len(r) - wide + 1, step) if seen[r[k : k + wide]] > 1] for r in regions]


def test_passages_of_over_50_words_go_from_the_pipeline(spark):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    fresh = iter(range(10**6))
    own = lambda k: " ".join(f"u{next(fresh)}" for _ in range(k))
    short = [" ".join(rng.choice(["a", "of", "it", "to", "é", "we", "no"], 51)) for _ in range(2)]  # under 400 bytes
    fifty = " ".join(f"f{i}" for i in range(50))
    solid = "x" + "".join(chr(97 + c) for c in rng.integers(0, 26, 600))  # 400 bytes without a space
    texts, want = [], []
    for before, passage, after in ((7, short[0], 9), (0, short[0].replace(" ", "\n", 3), 30), (12, short[1], 0), (4, short[1], 8), (5, fifty, 5), (6, fifty, 6), (3, solid, 3), (0, solid, 0)):
        a, b = own(before), own(after)
        texts.append(" ".join(x for x in (a, passage, b) if x))
        want.append(" ".join(x for x in (a, passage if passage == fifty else "", b) if x))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id int, text string, n_chars int")
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert [got[i].text.split() for i in range(len(texts))] == [w.split() for w in want]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_of_a_row_without_an_id_cost_in_line_with_them(spark):
    """Rows of a null id and one text: their spans are gathered once, however many rows there are."""
    text = " ".join(f"w{i * i % 977}x{i}" for i in range(700))
    other = text[:900] + " else " + text[1500:2600]
    rows = [(None, text)] * 60 + [(None, other), (1, other + " more"), (1, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    judged = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    few = spark.createDataFrame(rows[57:], "doc_id long, text string").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    sizes = [sorted((r.h, len(r.spans)) for r in repeat_spans(d).collect()) for d in (judged, few)]
    assert sizes[0] == sizes[1] and len(sizes[0]) == 3
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in drop_repeats(docs).collect())
    assert got[None, len(text), len(text)] == 60 and got[1, 5, 0] == 1 and sum(got.values()) == 63
