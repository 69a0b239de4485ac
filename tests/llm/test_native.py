"""Operators 3 and 8 against plain Python."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tessera.llm.quality import host_rates, keep_documents, quality
from tessera.llm.sharding import shard, tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, r, n < 10 or 100 * r > 20 * n


def test_quality(docs, empty):
    rows = docs.select("doc_id", "text", "source").collect()
    host = lambda s: "www.example.org" if s and "://" in s else s
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        by[host(r.source)][0] += 1
        by[host(r.source)][1] += base(r.text)[5]
    rates = [f / n for n, f in by.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / (len(rates) - 1)
    strength = max(1, min(1000, m * (1 - m) / v - 1))
    shrunk = {h: (f + m * strength) / (n + strength) for h, (n, f) in by.items()}
    want = Counter((r.doc_id, *base(r.text), not base(r.text)[5] and shrunk[host(r.source)] <= 0.6) for r in rows)
    got = quality(docs).collect()
    assert Counter(tuple(r)[:8] for r in got) == want
    assert quality(empty).count() == 0


def test_rejected_host(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad" if i < 40 else "good", "few words" if i < 35 else text) for i in range(80)] + [(80, "one", "few")]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    kept = {r.doc_id for r in keep_documents(docs).collect()}
    assert kept == set(range(40, 80)) == {r.doc_id for r in quality(docs).where("kept").collect()}
    assert keep_documents(docs).columns == docs.columns
    same = host_rates(docs.select(F.lit("h").alias("host"), F.lit(True).alias("base_failed"))).collect()
    assert len(same) == 1 and 0.9 < same[0].rate <= 1


def test_keep_documents_keeps_columns(docs, empty):
    assert keep_documents(docs).columns == docs.columns and keep_documents(empty).count() == 0
    assert keep_documents(docs).count() == quality(docs).where("kept").count()


def draw(key, node):
    """The tree in plain Python: Spark's xxhash64 chains columns by seed, and a null leaves the seed."""
    while node.children:
        scores = []
        for i, c in enumerate(node.children):
            h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", c.name), h)
            scores.append((-math.log(((h >> 11) + 1) / 2**53) / c.weight, i))
        node = node.children[min(scores)[1]]
    return node.shard


def test_shard(docs, empty):
    got = shard(docs, 5, racks=1, per_rack=2, base=4).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        want[r.doc_id, len(raw) + 8, zlib.crc32(raw)] += 1
    assert Counter(tuple(r)[:3] for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 5)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shard(empty).count() == 0


def test_draws_match_plain_python_and_confine_movement(spark):
    ids = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = {r.doc_id: r for r in shard(ids, 24).collect()}
    assert all(draw(i, tree(24)) == r.shard and draw(i, tree(25)) == r.grown_shard for i, r in got.items())
    moved = [r for r in got.values() if r.shard != r.grown_shard]
    assert all(r.grown_shard == 24 for r in moved) and 100 < len(moved) < 450
    assert set(Counter(r.shard for r in got.values())) == set(range(24))
    heavy = {r.doc_id: r.shard for r in shard(ids, 24, weights={3: 3.0}).collect()}
    for i, r in got.items():
        if heavy[i] != r.shard:  # only into the region of shard 3, whose weight grew
            assert heavy[i] // 8 == 0
    assert Counter(heavy.values())[3] > 2 * Counter(r.shard for r in got.values())[3]
