"""Operator 10, media columns: AVI motion-JPEG files, their intra frames, and timed clips between shot changes.

Storing: a payload's bytes are 8-bit samples, 32 x 32 to a frame. A sample becomes one flat 8 x 8
block of a baseline greyscale JPEG: with a DC quantiser of 8, the coefficient of a block at level s
is s - 128, so decoding gives s back exactly. The file's own Huffman table gives difference
category c a code of 9 - c bits, so that code and difference bits are 9 together and, with one bit
for the end of the block, each sample is 10 bits: coding and decoding need no loop over symbols.
Reading: RIFF chunks and the index are parsed and each frame's tables are read; frames with other tables go
through a general baseline decoder. Shots: a change of the levels' histogram between neighbouring
frames that is above an adaptive threshold, the mean and deviation of the changes around it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, blocks, texts_of

SIDE = 32
SAMPLES = SIDE * SIDE
FPS = 25
#: Zigzag order of an 8 x 8 block, from its rule: along anti-diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"".join(
    [
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + [*range(8, -1, -1)])),
        _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0])),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
)
_TAIL = b"\xff\xd9"


def _codes() -> np.ndarray:
    """The 10 bits of each difference from -255 to 255, at index difference + 255."""
    out = []
    for d in range(-255, 256):
        c = abs(d).bit_length()
        ones = 8 - c
        out.append((((1 << ones) - 1) << (c + 1) | (d if d > 0 else d + (1 << c) - 1)) << 1)
    return np.array(out, np.uint16)


CODES = _codes()
DIFFERENCES = np.full(1024, -999, np.int16)
DIFFERENCES[CODES] = np.arange(-255, 256)


def scans(frames: np.ndarray) -> list[bytes]:
    """Entropy-coded data of frames of 8-bit samples (rows), without byte stuffing."""
    levels = frames.astype(np.int16) - 128
    steps = np.diff(levels, axis=1, prepend=np.int16(0))
    c = CODES[steps + 255].reshape(len(frames), -1, 4)
    out = np.empty((*c.shape[:2], 5), np.uint8)
    out[..., 0] = c[..., 0] >> 2
    out[..., 1] = (c[..., 0] & 3) << 6 | c[..., 1] >> 4
    out[..., 2] = (c[..., 1] & 15) << 4 | c[..., 2] >> 6
    out[..., 3] = (c[..., 2] & 63) << 2 | c[..., 3] >> 8
    out[..., 4] = c[..., 3] & 255
    return [x.tobytes() for x in out.reshape(len(frames), -1)]


def unscan(data: bytes, n: int) -> np.ndarray:
    """The samples of n frames, the reverse of scans()."""
    b = np.frombuffer(data, np.uint8).reshape(n, -1, 5).astype(np.uint16)
    c = np.empty((*b.shape[:2], 4), np.uint16)
    c[..., 0] = b[..., 0] << 2 | b[..., 1] >> 6
    c[..., 1] = (b[..., 1] & 63) << 4 | b[..., 2] >> 4
    c[..., 2] = (b[..., 2] & 15) << 6 | b[..., 3] >> 2
    c[..., 3] = (b[..., 3] & 3) << 8 | b[..., 4]
    steps = DIFFERENCES[c.reshape(n, -1)]
    if (steps == -999).any():
        raise ValueError("not a scan of this profile")
    return (np.cumsum(steps, axis=1, dtype=np.int16) + 128).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], payload_bytes: int, fps: int = FPS) -> bytes:
    """An AVI 1.0 file of JPEG frames with an index; the comment holds how many samples count."""
    w = h = SIDE * 8
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % payload_bytes))
    body, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """(frames of the first video stream, frames a second, payload bytes if the file says so). The index decides; without one, the chunks' order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, payload, movi, index, found = float(FPS), None, None, None, []

    def walk(a: int, b: int) -> None:
        nonlocal fps, payload, movi, index
        while a + 8 <= b:
            name, size = data[a : a + 4], struct.unpack_from("<I", data, a + 4)[0]
            start, end = a + 8, min(a + 8 + size, b)
            if name == b"LIST":
                if data[start : start + 4] == b"movi":
                    movi = start
                if movi != start or index is None:
                    walk(start + 4, end)
            elif name == b"avih":
                fps = 1e6 / max(1, struct.unpack_from("<I", data, start)[0])
            elif name == b"ICMT" and data[start : start + 8] == b"payload=":
                payload = int(data[start + 8 : end].rstrip(b"\0"))
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, k) for k in range(start, end - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                found.append(data[start:end])
            a = a + 8 + size + size % 2

    walk(12, len(data))
    if index and movi is not None:
        # offsets count from the movi list's name, or in some files from the file's start
        base = movi if data[movi + index[0][2] : movi + index[0][2] + 4] == index[0][0] else 0
        found = [data[base + at + 8 : base + at + 8 + size] for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    return found, fps, payload


def jpeg_segments(frame: bytes) -> tuple[bytes, bytes]:
    """(all up to the scan, the scan's stuffed data)."""
    a = 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while frame[a] == 0xFF:
        marker = frame[a + 1]
        a += 2 + (frame[a + 2] << 8 | frame[a + 3])
        if marker == 0xDA:
            end = frame.rfind(_TAIL)
            return frame[:a], frame[a : end if end > 0 else len(frame)]
    raise ValueError("no scan in a JPEG frame")


@lru_cache(64)
def jpeg_tables(head: bytes) -> dict:
    """Quantisers, Huffman tables, components and sizes of a frame's head."""
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    a = 2
    while a < len(head):
        marker, size = head[a + 1], head[a + 2] << 8 | head[a + 3]
        s = head[a + 4 : a + 2 + size]
        if marker == 0xDB:
            while s:
                wide = 1 + (s[0] >> 4)
                values = np.frombuffer(s[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                out["quant"][s[0] & 15] = values
                s = s[1 + 64 * wide :]
        elif marker == 0xC4:
            while s:
                counts, code, k, table = s[1:17], 0, 17, {}
                for bits in range(1, 17):
                    for _ in range(counts[bits - 1]):
                        table[bits, code] = s[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                out["huff"][s[0]] = table
                s = s[k:]
        elif marker in (0xC0, 0xC1):
            out["h"], out["w"] = struct.unpack(">HH", s[1:5])
            out["parts"] = [(s[6 + 3 * i], s[7 + 3 * i] >> 4, s[7 + 3 * i] & 15, s[8 + 3 * i]) for i in range(s[5])]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC)):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            out["restart"] = s[0] << 8 | s[1]
        elif marker == 0xDA:
            out["scan"] = {s[1 + 2 * i]: (s[2 + 2 * i] >> 4, 16 | s[2 + 2 * i] & 15) for i in range(s[0])}
        a += 2 + size
    return out


_BASIS = np.array([[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def decode_baseline(head: bytes, stuffed: bytes) -> np.ndarray:
    """Luma of any baseline frame, by the standard's symbol loop; slow, for frames that this module didn't write."""
    t = jpeg_tables(head)
    parts = t["parts"]
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, hmax, vmax = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-t["w"] // (8 * hmax)), -(-t["h"] // (8 * vmax))
    runs, k = [], 0
    while k < len(stuffed):  # cut at restart markers
        m = k
        while (m := stuffed.find(b"\xff", m)) >= 0 and m + 1 < len(stuffed) and not 0xD0 <= stuffed[m + 1] <= 0xD7:
            m += 2
        m = len(stuffed) if m < 0 else m
        runs.append(stuffed[k:m].replace(b"\xff\0", b"\xff"))
        k = m + 2
    luma = np.zeros((down * vmax * 8, across * hmax * 8), np.uint8)
    unit, total = 0, across * down
    for run in runs:
        bits, at = "".join(f"{x:08b}" for x in run), 0

        def symbol(table: dict) -> int:
            nonlocal at
            for n in range(1, 17):
                if (v := table.get((n, int(bits[at : at + n] or "0", 2)))) is not None:
                    at += n
                    return v
            raise ValueError("bad Huffman code")

        def extra(n: int) -> int:
            nonlocal at
            if not n:
                return 0
            v = int(bits[at : at + n], 2)
            at += n
            return v if v >> (n - 1) else v - (1 << n) + 1

        before = dict.fromkeys((p[0] for p in parts), 0)
        for _ in range(t["restart"] or total):
            if unit >= total:
                break
            for i, (name, hs, vs, q) in enumerate(parts):
                dc, ac = (t["huff"][x] for x in t["scan"][name])
                for y in range(vs):
                    for x in range(hs):
                        z = np.zeros(64)
                        before[name] += extra(symbol(dc))
                        z[0], k = before[name], 1
                        while k < 64 and (s := symbol(ac)):
                            k += s >> 4
                            if s & 15:
                                z[k] = extra(s & 15)
                            k += 1
                        if i == 0:
                            block = np.zeros(64)
                            block[ZIGZAG] = z * t["quant"][q]
                            pixels = _BASIS @ block.reshape(8, 8) @ _BASIS.T + 128
                            r, c = (unit // across * vs + y) * 8, (unit % across * hs + x) * 8
                            luma[r : r + 8, c : c + 8] = np.clip(np.rint(pixels), 0, 255)
            unit += 1
    return luma[: t["h"], : t["w"]]


def samples_of(files: list[list[bytes]]) -> list[np.ndarray]:
    """For each file's frames, rows of samples: levels of blocks where the frame is of this module's profile, else its luma."""
    plain, odd, where = [], {}, []
    for i, frames in enumerate(files):
        for k, frame in enumerate(frames):
            head, data = jpeg_segments(frame)
            if head == _HEAD:
                plain.append(data.replace(b"\xff\0", b"\xff"))
                where.append((i, k))
            else:
                odd[i, k] = decode_baseline(head, data).ravel()
    rows = unscan(b"".join(plain), len(plain)) if plain else np.zeros((0, SAMPLES), np.uint8)
    if not odd:
        ends = np.cumsum([len(f) for f in files])
        return [rows[e - len(f) : e] for e, f in zip(ends.tolist(), files, strict=True)]
    at = {w: rows[n] for n, w in enumerate(where)} | odd
    return [[at[i, k] for k in range(len(f))] for i, f in enumerate(files)]


def shots(frames: list[np.ndarray] | np.ndarray, bins: int = 16, around: int = 8, deviations: float = 1.5, least: float = 0.08) -> list[tuple[int, int]]:
    """(first, last) frame of each clip. A cut stands before a frame whose histogram differs from its neighbour's by more
    than `least` (half the L1 distance of shares) and by more than mean + deviations x deviation of the differences
    within `around` frames, itself left out."""
    n = len(frames)
    if n < 2:
        return [(0, n - 1)] if n else []
    shares = np.stack([np.bincount(np.asarray(f) >> (8 - bins.bit_length() + 1), minlength=bins) / len(f) for f in frames])
    change = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    cuts = [0]
    for k, d in enumerate(change.tolist()):
        near = np.delete(change[max(0, k - around) : k + around + 1], min(k, around))
        limit = max(least, float(near.mean() + deviations * near.std())) if len(near) else least
        if d > limit:
            cuts.append(k + 1)
    return list(zip(cuts, [*(c - 1 for c in cuts[1:]), n - 1], strict=True))


def within(frames, payload: int | None):
    """A file's frames without the filling behind its payload."""
    rest = None if payload is None else payload - (len(frames) - 1) * SAMPLES
    return frames if rest is None or not 0 < rest < SAMPLES else [*frames[:-1], frames[-1][:rest]]


def media(docs: DataFrame, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text's payload stored as an AVI file, read back from it, and its clips.

    n_bytes; payload_bytes (a positive multiple of 64, zeros behind the text); payload_sha256 and
    tail_crc32 of the payload as read back; media_bytes and media_sha256 of the file; feature (frames,
    rate, clips); clips, an array of (clip, first_frame, last_frame, start_s, end_s); with `keep` the
    file itself, media. Null and empty texts store 64 zero bytes. Equal texts give equal values. Ties,
    repeated rows and null ids pass through; other columns are not read. One pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    clip = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch, "text", 1 << 20):
                part = batch.slice(a, b - a)
                texts = [t.encode() for t in texts_of(part, "text")]
                files = store_all(texts)
                read = [parse_avi(f) for f in files]
                got = samples_of([r[0] for r in read])
                back = [np.asarray(x).tobytes()[: r[2]] for x, r in zip(got, read, strict=True)]
                own = [shots(within(x, r[2])) for x, r in zip(got, read, strict=True)]
                said = [f"avi/mjpg;frames={len(r[0])};fps={r[1]:g};clips=" + ",".join(f"{x}-{y}" for x, y in s) for r, s in zip(read, own, strict=True)]
                clips = [[{"clip": k, "first_frame": x, "last_frame": y, "start_s": x / r[1], "end_s": (y + 1) / r[1]} for k, (x, y) in enumerate(s)] for r, s in zip(read, own, strict=True)]
                long = lambda x: pa.array(x, pa.int64())
                columns = [
                    part.column("id"), long([len(t) for t in texts]), long([len(x) for x in back]), pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    long([zlib.crc32(x[-64:]) for x in back]), long([len(f) for f in files]), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(said), pa.array(clips, pa.list_(clip)),
                ]
                names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(files, pa.binary())] if keep else []), names=names + (["media"] if keep else []))

    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips array<struct<clip: int, first_frame: int, last_frame: int, start_s: double, end_s: double>>" + (", media binary" if keep else "")
    return arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, schema).withColumnRenamed("id", id_col)


def clip_rows(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Timed clips as rows: id, clip, first_frame, last_frame, start_s, end_s, from the column clips of `media`. Each file has one clip at least."""
    return found.select(F.col(f"`{id_col}`"), F.inline("clips"))


def store_all(texts: list[bytes]) -> list[bytes]:
    """The AVI file of each text."""
    sizes = [max(64, -(-len(t) // 64) * 64) for t in texts]
    counts = [-(-n // SAMPLES) for n in sizes]
    joined = b"".join(t.ljust(n * SAMPLES, b"\0") for t, n in zip(texts, counts, strict=True))
    data = scans(np.frombuffer(joined, np.uint8).reshape(-1, SAMPLES)) if texts else []
    frames = iter([b"".join([_HEAD, x.replace(b"\xff", b"\xff\0"), _TAIL]) for x in data])
    return [write_avi([next(frames) for _ in range(c)], n) for n, c in zip(sizes, counts, strict=True)]
