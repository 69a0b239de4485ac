"""Operator 11 against plain Python."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import filter_audit
from tessera.llm.filter_audit import _buffer, audit, scan, scan_long

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(text), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text)]


def failed(text):
    words, distinct, points, capitals, symbols = stats(text)
    return {f for f, x in zip("ABCD", (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols > 0), strict=True) if x}


def brute(rows, labels):
    """rows: (id, text, source). Filters applied one after the other, order by order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = [failed(t or "") | ({"E"} if i is not None and i > first[t or ""] else set()) for i, t, _ in rows]
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                kept = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    f, len(kept), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                ]
                left = kept
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def test_audit(spark, docs, empty):
    marked = [(0, 1, 0), (1, 1, 1), (5, 0, 1), (5, 1, 0), (7, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1), (-5, 1, 1)]
    labels = spark.createDataFrame(marked, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS mask", "1 AS good")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit(docs, labels, piece=1 << 14).collect()}
    assert got == brute(rows, marked)
    assert audit(empty, labels).count() == 0
    assert audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0
    assert audit(docs.limit(0).union(docs), labels).where("part IS NULL").count() == 0


def check_scan(texts):
    raw, offsets = _buffer(pa.array(texts, pa.string()))
    assert scan(raw, offsets).T.tolist() == [stats(t) for t in texts]
    for t in texts:
        own, _ = _buffer(pa.array([t], pa.string()))
        assert scan_long(own, len(own) - 8, 64).tolist() == stats(t)


def random_texts(seed, n=60):
    rng = np.random.default_rng(seed)
    alphabet = list("aabbcc  \n\tXYZ#$|é日🙂\x0b\x1c")
    words = ["short", "exactly8", "ninechars", "x" * 64, "x" * 65, "y" * 200, "x" * 64 + "y", "Éa"]
    return ["".join(rng.choice(alphabet, int(rng.integers(0, 300)))) for _ in range(n)] + [" ".join(rng.choice(words, int(rng.integers(0, 90)))) for _ in range(n)]


def test_scan_of_odd_texts():
    check_scan(random_texts(1) + ["", " ", "a", "one two", "two", "z" * 5000, ("w" * 100 + " ") * 50])
    sliced = pa.array(["left out", "a b a", "", "c"], pa.large_string()).slice(1, 3)
    raw, offsets = _buffer(sliced)
    assert scan(raw, offsets).T.tolist() == [stats(t) for t in sliced.to_pylist()]


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    honest = filter_audit.word_hashes
    monkeypatch.setattr(filter_audit, "word_hashes", lambda *a: honest(*a) & np.uint64(3))
    check_scan(random_texts(2, 20) + ["", "a b c d e f g h a b"])


@pytest.mark.parametrize("n", [1, 3])
def test_documents_meet_without_a_space(n):
    check_scan(["ab", "cd", "", "ab"] * n)
