"""Operator 6: signatures against the similarity that they estimate, and classes against brute force."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_dups
from tessera.llm.near_dups import components, drop_near_duplicates, merged, near_duplicates, regions_of, shingle_counts, signatures, units, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute(rows):
    """Class of each (id, text): the set of positions, by chains of equal texts or similar shingles."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def make(seed, n=150):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        if i % 3 and texts:
            w = texts[int(rng.integers(0, len(texts)))].split()
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = "changed%d" % rng.integers(0, 99)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(words, int(rng.integers(3, 250)))))
    return texts


def test_classes(spark):
    rows = list(enumerate(make(1)))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    roots = brute(rows)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert {i: r.class_id for i, r in got.items()} == {i: least[r] for i, r in enumerate(roots)}
    assert sorted(i for i, r in got.items() if r.is_kept) == sorted(least.values())
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == sorted(least.values())


def test_copies_that_only_their_original_links(spark):
    """Families of copies at 0.80 to 0.88 of an original and about 0.66 to 0.75 of each other, original not first by id."""
    rng = np.random.default_rng(11)
    texts = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(200)]
        copies = []
        for c in range(150):
            w = list(base)
            for p in rng.choice(np.arange(6, 194, 6), 3 + c % 2, replace=False):
                w[p] = f"f{family}c{c}p{p}"
            copies.append(" ".join(w))
        texts += copies[:90] + [" ".join(base)] + copies[90:]
    rows = list(enumerate(texts))
    roots = brute(rows)
    assert len(set(roots)) == 3
    # no rounds between: the exact join alone, and as it is
    for options in ({"rounds": 1}, {}):
        got = near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), **options).collect()
        assert {r.doc_id: r.class_id for r in got} == {i: i // 151 * 151 for i in range(len(rows))}


def test_odd_rows(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    roots = brute(rows)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        old = least.get(r)
        least[r] = i if old is None else old if i is None else min(i, old)
    want = Counter((i, least[r]) for (i, _), r in zip(rows, roots, strict=True))
    assert Counter((r.doc_id, r.class_id) for r in near_duplicates(docs).collect()) == want
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 60, 300)]
    other = base[:260] + [f"x{i}" for i in range(40)] + base[:30]
    for a, b in [(base, other), (base, base + base), (base[:40], base[:38] + ["y"]), (base * 30, base * 30 + other)]:
        x, y = " ".join(a), " ".join(b)
        s = signatures([shingle_counts(x), shingle_counts(y), shingle_counts("")], 2048)
        assert len(units(x)) == shingle_counts(x)[1].sum() and len(set(units(x).tolist())) == len(units(x))
        assert np.isfinite(s[:2]).all() and np.isinf(s[2]).all()
        assert abs((s[0] == s[1]).mean() - similarity(shingles(x), shingles(y))) < 0.05
        assert (signatures([shingle_counts(y)], 2048)[0] == s[1]).all()  # whatever else is in the batch


def test_fractional_and_great_weights():
    """Agreement is sum of least over sum of greatest weights, whatever the weights are."""
    rng = np.random.default_rng(6)
    elements = rng.integers(0, 2**63, 400).astype(np.uint64)
    for make in (lambda: rng.random(400), lambda: rng.exponential(1, 400) ** 3, lambda: rng.integers(1, 300, 400) * 1.0, lambda: np.where(rng.random(400) < 0.02, 5000.5, 0.25)):
        a = make()
        b = np.where(rng.random(400) < 0.3, make(), a)
        own = np.arange(400) < 350  # the last are the second's alone
        s = signatures([(elements[own], a[own]), (elements, b)], 4096)
        x = np.where(own, a, 0)
        assert abs((s[0] == s[1]).mean() - np.minimum(x, b).sum() / np.maximum(x, b).sum()) < 0.04
        assert (signatures([(elements[::-1], b[::-1])], 4096)[0] == s[1]).all()
    assert list(regions_of(9.5)) == [(0, 1), (1, 2), (2, 4), (4, 8), (8, 16)] and list(regions_of(200))[-1] == (192, 256)


def test_words():
    text = "  ab\tcd\x0bab é\x85é ab\x1c\n"
    words = WORD.findall(text)
    h = word_hashes(text).tolist()
    assert len(h) == len(words) and [h.index(x) for x in h] == [words.index(x) for x in words]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 60)] + [(200, k) for k in range(201, 260)]
    edges = spark.createDataFrame(chain, "a int, b int").select(F.col("a"), F.col("b"))
    got = {r.node: r.label for r in components(edges).collect()}
    assert {i: got[i] for i in (*range(41), 60)} == dict.fromkeys((*range(41), 60), 0)
    assert got[102] == 100 and {got[k] for k in range(200, 260)} == {200}


def test_merged_classes(spark):
    """Labels of earlier links and of further ones are those of all links together."""
    frame = lambda pairs: spark.createDataFrame(pairs, "a int, b int")
    rng = np.random.default_rng(3)
    links = [tuple(sorted(map(int, rng.choice(200, 2, replace=False)))) for _ in range(120)]
    want = {r.node: r.label for r in components(frame(links)).collect()}
    labels = None
    for part in (links[:40], links[40:41], links[20:90], links[90:]):
        labels = merged(labels, frame(part))
    assert {r.node: r.label for r in labels.collect()} == want


def test_a_group_makes_few_links(spark, monkeypatch):
    """A group of near copies: the links that classes are made of are fewer than two for each text."""
    rng = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in range(200)], []
    for c in range(120):
        w = list(base)
        w[int(rng.integers(0, 200))] = f"c{c}"
        texts.append(" ".join(w))
    seen, whole = [], near_dups.components
    monkeypatch.setattr(near_dups, "components", lambda edges: (seen.append(edges.count()), whole(edges))[1])
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(seen) < 2 * len(texts)
