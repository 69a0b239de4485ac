"""The corpus pipeline against brute force, stage by stage, and its stages on odd rows."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.queries import BYTES, PASSAGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ADDRESS = "jane.roe42@corp.acme.org"


def corpus():
    """(doc_id, text, lang, source, n_chars): clean documents, short ones, a host that fails as a whole, near and exact copies, repeated passages, an address, nulls."""
    rng = np.random.default_rng(2)
    fresh = iter(range(10**6))
    own = lambda k: " ".join(f"{'abcdefgh'[int(rng.integers(8))]}{next(fresh)}" for _ in range(k))
    texts, hosts = [], []
    put = lambda t, host="good": (texts.append(t), hosts.append(host))
    for i in range(40):
        put(own(int(rng.integers(20, 160))), f"host{i % 4}")
    for k in (3, 11):
        w = texts[k].split()
        put(" ".join([*w[: len(w) // 2], "changed", *w[len(w) // 2 :]]) if len(w) > 80 else texts[k])
        put(texts[k])
    for _ in range(30):
        put(own(4), "bad")
    put(own(50), "bad")
    put("again and again " * 20)
    short, long = " ".join(rng.choice(["it", "of", "a", "to", "we", "é"], 55)), own(90)
    put(own(70) + " " + short + " " + own(60))
    put(own(90) + "\n" + short.replace(" ", "  ", 4) + " " + own(80))
    put(own(150) + " " + long + " " + own(160))
    put(long + " " + own(300))
    put(own(20) + f" write to {ADDRESS}, or " + own(20))
    put(None)
    put("")
    return [(i, t, "en", h, None if t is None else len(t)) for i, (t, h) in enumerate(zip(texts, hosts, strict=True))]


def base_failed(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    return len(w) < 10 or 100 * len(covered) > 20 * len(w)


def by_quality(rows):
    hosts = {}
    for r in rows:
        hosts.setdefault(r[3], []).append(base_failed(r[1]))
    rates = np.array([np.mean(x) for x in hosts.values()])
    m, v = rates.mean(), rates.var(ddof=1) if len(rates) > 1 else 0.0
    strength = min(1000.0, max(1.0, m * (1 - m) / v - 1 if v else 1000.0))
    rate = {h: (sum(x) + m * strength) / (len(x) + strength) for h, x in hosts.items()}
    return [r for r in rows if not base_failed(r[1]) and rate[r[3]] <= 0.6]


def by_similarity(rows):
    bags = []
    for r in rows:
        w = WORD.findall(r[1])
        k = min(5, len(w))
        bags.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


def without_repeats(rows):
    raw = [r[1].encode() for r in rows]
    seen = Counter(d[i : i + 400] for d in raw for i in range(len(d) - 399))
    words = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in raw]
    runs = Counter(tuple(d[a:b] for a, b in w[i : i + PASSAGE]) for d, w in zip(raw, words, strict=True) for i in range(len(w) - PASSAGE + 1))
    out = []
    for r, d, w in zip(rows, raw, words, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = True
        for i in range(len(w) - PASSAGE + 1):
            if runs[tuple(d[a:b] for a, b in w[i : i + PASSAGE])] > 1:
                gone[w[i][0] : w[i + PASSAGE][0] if i + PASSAGE < len(w) else len(d)] = True
        text = np.frombuffer(d, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    kept = lambda df: sorted(tuple(r) for r in df.collect())

    want = by_quality(rows)
    one = stage["quality rules"](spark, docs, "")
    assert kept(one) == want and 40 < len(want) < len(rows) - 32 and "bad" not in {r[3] for r in want}
    unique = by_similarity(want)
    two = stage["near duplicates"](spark, one, "")
    assert kept(two) == unique and len(want) - len(unique) == 4
    cut = without_repeats(unique)
    three = stage["repeated passages"](spark, two, "")
    assert kept(three) == cut and sum(a[1] != b[1] for a, b in zip(unique, cut, strict=True)) == 4
    four = {r.doc_id: r for r in stage["personal data"](spark, three, "").collect()}
    assert sorted(four) == [r[0] for r in cut]
    for r in cut:
        if ADDRESS in r[1]:
            before, after = r[1].split(ADDRESS)
            made = four[r[0]].text
            assert made.startswith(before) and made.endswith(after) and ADDRESS not in made and four[r[0]].n_chars == len(made)
        else:
            assert four[r[0]].text == r[1]

    source = Tokenizer.from_file(str(public_tokenizers.path(BYTES)))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(four)
    by = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == by.get(p.doc_id, 0)
        by[p.doc_id] = p.start + p.length
        assert p.doc_tokens == len(source.encode(four[p.doc_id].text, add_special_tokens=False).ids) + 1
    assert all(by[p.doc_id] == p.doc_tokens for p in pieces)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, docs, empty, name, stage):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table, clashing column names."""
    got = stage(spark, docs, "")
    rows = got.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    else:
        assert got.columns == docs.columns and 0 < len(rows) <= docs.count()
        if name in ("repeated passages", "personal data"):
            assert len(rows) == docs.count() and sum(r.text is None for r in rows) == docs.where("text IS NULL").count()
    assert stage(spark, empty, "").count() == 0
