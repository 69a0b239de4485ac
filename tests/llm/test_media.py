"""Operator 10: exact round trips, the index, and a general decoder."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import media as m


def payload(text):
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def test_media(docs, empty):
    got = m.media(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(p := payload(r.text)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in docs.collect())
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        frames, fps, n = m.parse_avi(r.media)
        assert n == r.payload_bytes and len(frames) == -(-n // m.SAMPLES) and fps == 25
        assert r.clips[0].first_frame == 0 and r.clips[-1].last_frame == len(frames) - 1
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert m.media(empty).count() == 0


@pytest.mark.parametrize("text", [b"", b"\xff" * 3000, bytes(range(256)) * 9, b"\0\xff" * 700])
def test_round_trip(text):
    (file,) = m.store_all([text])
    frames, _, n = m.parse_avi(file)
    assert m.samples_of([frames])[0].tobytes()[:n] == text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
    at = file.rindex(b"idx1")
    assert m.parse_avi(file[:at])[0] == frames  # without its index


def test_general_decoder_gives_flat_blocks():
    (file,) = m.store_all([bytes(np.random.default_rng(0).integers(0, 256, 1024, np.uint8))])
    (frame,), _, _ = m.parse_avi(file)
    level = m.samples_of([[frame]])[0][0].reshape(32, 32)
    luma = m.decode_baseline(*m.jpeg_segments(frame))
    assert (luma == np.kron(level, np.ones((8, 8), np.uint8))).all()


def test_general_decoder_reads_other_tables():
    """A frame of one block, DC 3 x 16 and one AC coefficient, coded by hand."""
    head = b"".join([b"\xff\xd8", m._segment(0xDB, bytes([0] + [16] * 64)), m._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])), m._segment(0xC4, bytes([0, 0, 1] + [0] * 14 + [2])), m._segment(0xC4, bytes([0x10, 0, 2] + [0] * 14 + [0, 1])), m._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))])
    data = bytes([0b00_11_01_1_0, 0b0_1111111])  # DC: code 00, bits 11; AC: code 01, bit 1; end: code 00
    luma = m.decode_baseline(head, data)
    x = np.arange(8)
    want = 128 + 3 * 16 / 8 + 16 / 8 * 2**0.5 * np.cos((2 * x + 1) * np.pi / 16)
    assert (luma == np.rint(np.tile(want, (8, 1)))).all()


def test_shots():
    dark, light = np.zeros(1024, np.uint8), np.full(1024, 200, np.uint8)
    assert m.shots([dark] * 5 + [light] * 4) == [(0, 4), (5, 8)]
    assert m.shots([dark]) == [(0, 0)] and m.shots([]) == []


def test_clip_rows(spark):
    """Dark, light and dark again: three clips whose times follow from 25 frames a second."""
    texts = ["\x01" * m.SAMPLES * 10 + "z" * m.SAMPLES * 15 + "\x01" * m.SAMPLES * 25, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = m.clip_rows(m.media(docs, keep=False)).orderBy("doc_id", "clip").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 9, 0.0, 0.4), (0, 1, 10, 24, 0.4, 1.0), (0, 2, 25, 49, 1.0, 2.0), (1, 0, 0, 0, 0.0, 0.04), (2, 0, 0, 0, 0.0, 0.04)]
