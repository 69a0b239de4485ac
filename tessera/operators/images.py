"""Figures as PNG files, one for each problem: the figure that `figure.render` describes, filled by coverage, with its stem above.

Where things go (frame, labels, marked points, regions) is a struct of built-in expressions, `scene`; a worker only scans it
into pixels. A shape's rows are toggled where its edges cross them, so a running sum's parity is its inside; regions are combined as
they are measured. The same scene gives the same bytes. Files are written to their place under another name and then moved
there, on any file system that Arrow knows, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geometry as G
from tessera.functions import spec as S
from tessera.operators import figure

#: Pixels of a side, samples of a pixel's side, pixels of a line's width, of a dot's radius and of a font's unit.
SIDE, FINE, LINE, DOT, UNIT = 600, 3, 2.0, 4.0, 2
WHITE, SHADE, GRID, BLACK = 255, 190, 225, 0
#: The columns, lowest bit on top, of the characters from space to tilde in a font of five by eight.
_FONT = (
    "0000000000 00005f0000 0007000700 147f147f14 242a7f2a12 2313086462 3649562050 0008070300 001c224100 0041221c00 2a1c7f1c2a 08083e0808 0080703000 0808080808 0000606000 2010080402 "
    "3e5149453e 00427f4000 7249494946 2141494d33 1814127f10 2745454539 3c4a494931 4121110907 3649494936 464949291e 0000140000 0040340000 0008142241 1414141414 0041221408 0201590906 "
    "3e415d594e 7c1211127c 7f49494936 3e41414122 7f4141413e 7f49494941 7f09090901 3e41415173 7f0808087f 00417f4100 2040413f01 7f08142241 7f40404040 7f021c027f 7f0408107f 3e4141413e "
    "7f09090906 3e4151215e 7f09192946 2649494932 03017f0103 3f4040403f 1f2040201f 3f4038403f 6314081463 0304780403 6159494d43 007f414141 0204081020 004141417f 0402010204 4040404040 "
    "0003070800 2054547840 7f28444438 3844444428 384444287f 3854545418 00087e0902 18a4a49c78 7f08040478 00447d4000 2040403d00 7f10284400 00417f4000 7c04780478 7c08040478 3844444438 "
    "fc18242418 18242418fc 7c08040408 4854545424 04043f4424 3c4040207c 1c2040201c 3c4030403c 4428102844 4c9090907c 4464544c44 0008364100 0000770000 0041360800 0201040204"
).split()
_GLYPHS = np.array([[[int(g[2 * c : 2 * c + 2], 16) >> r & 1 for c in range(5)] for r in range(8)] for g in _FONT], bool)


def scene(spec: Column, stem: Column | None = None) -> Column:
    """What is drawn, as JSON: frame (x, y, half), step of the grid, regions with their shapes, shapes, dots, and texts with their places."""
    shapes = S.of_kind(spec, *S.SHAPES)
    extremes = F.flatten(F.transform(shapes, lambda s: figure._extremes(s)))
    sized = F.struct(spec.alias("spec"), extremes.alias("extremes"), figure._half(extremes).alias("half"))
    drawn = lambda places: F.filter(places, lambda p: p["draw"] & (p["text"] != ""))
    text = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["text"].alias("text"))

    def parts(c: Column) -> Column:
        lengths, points = figure.length_places(c["spec"], c["half"] * figure.GAP), figure.point_places(c["spec"])
        return F.struct(c["spec"].alias("spec"), c["extremes"].alias("extremes"), F.transform(drawn(lengths), text).alias("lengths"), F.transform(drawn(points), text).alias("named"), F.transform(points, lambda p: F.array(p["px"], p["py"])).alias("dots"))

    def whole(c: Column) -> Column:
        texts = F.concat(c["lengths"], c["named"])
        frame = figure.window(F.concat(c["extremes"], F.transform(texts, lambda t: F.array(t["x"], t["y"]))))
        shape = lambda s: F.struct(s["kind"].alias("kind"), s["points"].alias("points"), s["center"].alias("center"), s["radius"].alias("radius"))
        regions = F.transform(S.regions_of(c["spec"]), lambda r: F.struct(r["operation"].alias("operation"), F.transform(r["own"], shape).alias("own")))
        step = F.get(F.filter(c["spec"], lambda s: (s["kind"] == "axes") & (s["step"] > 0)), F.lit(0))["step"]
        return F.to_json(F.struct(frame.alias("frame"), step.alias("step"), regions.alias("regions"), F.transform(S.of_kind(c["spec"], *S.SHAPES), shape).alias("shapes"), c["dots"].alias("dots"), texts.alias("texts"), (F.lit(None).cast("string") if stem is None else stem).alias("stem")))

    return G.bound(G.bound(sized, parts), whole)


class Canvas:
    """A square of samples; y grows upwards in figures and downwards here."""

    def __init__(self, frame: dict):
        self.n = SIDE * FINE
        self.scale = self.n / (2 * frame["half"]) if frame["half"] > 0 else 1.0
        self.left, self.top = frame["x"] - frame["half"], frame["y"] + frame["half"]
        self.grey = np.full((SIDE, SIDE), float(WHITE))

    def place(self, points: np.ndarray) -> np.ndarray:
        points = np.asarray(points, float)
        return np.stack([(points[:, 0] - self.left) * self.scale, (self.top - points[:, 1]) * self.scale], 1)

    def outline(self, shape: dict) -> np.ndarray:
        if shape["kind"] == "circle":
            a = np.arange(720) * np.pi / 360
            return self.place(np.array(shape["center"]) + shape["radius"] * np.stack([np.cos(a), np.sin(a)], 1))
        return self.place(shape["points"])

    def mask(self, p: np.ndarray) -> np.ndarray:
        """The samples inside a closed outline, by the parity of its edges to the left."""
        q = np.roll(p, -1, 0)
        low, high = np.where((p[:, 1] <= q[:, 1])[:, None], p, q), np.where((p[:, 1] <= q[:, 1])[:, None], q, p)
        first, last = (np.clip(np.ceil(x[:, 1] - 0.5), 0, self.n).astype(int) for x in (low, high))
        count = last - first
        edge = np.repeat(np.arange(len(p)), count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[edge]
        x = low[edge, 0] + (row + 0.5 - low[edge, 1]) * (high - low)[edge, 0] / (high - low)[edge, 1]
        at = np.clip(np.ceil(x - 0.5), 0, self.n).astype(int)
        out = np.zeros((self.n, self.n), bool)
        if len(row):  # only the rows and columns that the outline covers are scanned
            top, left, wide = row.min(), at.min(), at.max() - at.min() + 1
            tall = row.max() - top + 1
            toggles = np.bincount((row - top) * wide + at - left, minlength=tall * wide).astype(np.uint8).reshape(tall, wide)
            part = out[top : top + tall, left : left + wide]
            part[:] = (np.cumsum(toggles, axis=1, dtype=np.uint8) & 1)[:, : part.shape[1]].astype(bool)
        return out

    def paint(self, mask: np.ndarray, level: int) -> None:
        share = mask.reshape(SIDE, FINE, SIDE, FINE).mean((1, 3))
        self.grey += share * (level - self.grey)

    def region(self, r: dict) -> np.ndarray:
        own = [self.mask(self.outline(s)) for s in r["own"]]
        if r["operation"] == "difference":
            return own[0] & ~np.any(own[1:], axis=0)
        return np.any(own, axis=0) if r["operation"] == "union" else np.all(own, axis=0)

    def stroke(self, segments: np.ndarray, width: float) -> np.ndarray:
        """(segments x ends x coordinates), in samples: each a strip as long as it and half a width more at both ends."""
        out = np.zeros((self.n, self.n), bool)
        half = width * FINE / 2
        for a, b in segments:
            d = b - a
            n = np.hypot(*d)
            d = d / n if n else np.array([1.0, 0.0])
            across = np.array([-d[1], d[0]]) * half
            a, b = a - d * half, b + d * half
            out |= self.mask(np.array([a + across, b + across, b - across, a - across]))
        return out

    def closed(self, shape: dict, width: float) -> np.ndarray:
        if shape["kind"] == "circle":
            more = width / 2 * FINE / self.scale
            return self.mask(self.outline(shape | {"radius": shape["radius"] + more})) & ~self.mask(self.outline(shape | {"radius": max(0.0, shape["radius"] - more)}))
        p = self.outline(shape)
        return self.stroke(np.stack([p, np.roll(p, -1, 0)], 1), width)

    def text(self, said: str, x: float, y: float) -> None:
        """Centred at a place in pixels, on white."""
        ink = letters(said)
        h, w = ink.shape
        a, b = round(y - h / 2), round(x - w / 2)
        self.grey[max(0, a - 1) : max(0, a + h + 1), max(0, b - 2) : max(0, b + w + 2)] = WHITE
        top, left = max(0, -a), max(0, -b)
        part = self.grey[max(0, a) : a + h, max(0, b) : b + w] if a + h > 0 and b + w > 0 else self.grey[:0, :0]
        part[ink[top : top + part.shape[0], left : left + part.shape[1]]] = BLACK


def letters(said: str) -> np.ndarray:
    """A line of text as pixels; what the font lacks is a box."""
    box = np.ones((8, 5), bool)
    box[1:6, 1:4] = False
    cells = [np.pad(_GLYPHS[ord(c) - 32] if " " <= c <= "~" else box, ((0, 0), (0, 1))) for c in said] or [np.zeros((8, 1), bool)]
    return np.kron(np.concatenate(cells, axis=1), np.ones((UNIT, UNIT), bool))


def _lines(stem: str) -> list[str]:
    """The stem's words in lines that fit."""
    most, lines = SIDE // (6 * UNIT), []
    for word in stem.split():
        if lines and len(lines[-1]) + 1 + len(word) <= most:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines


def png(grey: np.ndarray) -> bytes:
    """An 8-bit grey PNG; each row is stored as its difference from the one above."""
    rows = np.diff(grey, axis=0, prepend=np.zeros((1, grey.shape[1]), np.uint8)).astype(np.uint8)
    data = np.concatenate([np.full((len(rows), 1), 2, np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data, 9)) + chunk(b"IEND", b"")


def draw(said: str) -> bytes:
    """A scene as PNG: grid, shaded regions, outlines, dots, texts; the stem in a band above."""
    s = json.loads(said)
    c, frame = Canvas(s["frame"]), s["frame"]
    if step := s.get("step"):
        lines, axes = [], []
        for k, (low, high) in enumerate(((c.left, c.left + 2 * frame["half"]), (c.top - 2 * frame["half"], c.top))):
            for at in np.arange(np.floor(low / step), np.floor(high / step) + 1) * step:
                across = (c.top - 2 * frame["half"], c.top) if k == 0 else (c.left, c.left + 2 * frame["half"])
                ends = [[at, v] if k == 0 else [v, at] for v in across]
                (lines if at else axes).append(c.place(np.array(ends)))
        for own, level in ((lines, GRID), (axes, BLACK)):
            if own:
                c.paint(c.stroke(np.array(own), LINE / 2), level)
    for r in s["regions"]:
        c.paint(c.region(r), SHADE)
    for shape in s["shapes"]:
        c.paint(c.closed(shape, LINE), BLACK)
    for x, y in s["dots"]:
        c.paint(c.mask(c.outline({"kind": "circle", "center": [x, y], "radius": DOT * FINE / c.scale})), BLACK)
    for t in s["texts"]:
        x, y = c.place(np.array([[t["x"], t["y"]]]))[0] / FINE
        c.text(t["text"], x, y)
    lines = _lines(s.get("stem") or "")
    band = np.full((len(lines) * 10 * UNIT + (4 * UNIT if lines else 0), SIDE), WHITE, float)
    for i, line in enumerate(lines):
        ink = letters(line)[:, :SIDE]
        y, x = 3 * UNIT + i * 10 * UNIT, (SIDE - ink.shape[1]) // 2
        band[y : y + len(ink), x : x + ink.shape[1]][ink] = BLACK
    return png(np.rint(np.concatenate([band, c.grey])).astype(np.uint8))


def _scenes(figures: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns to keep, and the scene of figures' columns spec and stem; a figure that can't be drawn ends the query with the reason."""
    fault = figure.render_fault(F.col("spec"))
    stem = F.col("stem") if "stem" in figures.columns else None
    said = F.when(fault.isNull(), scene(F.col("spec"), stem)).otherwise(F.raise_error(F.coalesce(fault, F.lit(""))).cast("string"))
    return figures.select(*keep, said.alias("_scene"))


def pictures(figures: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and image, the bytes of each figure's PNG file."""
    scenes = _scenes(figures, keep)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                data = [draw(s) for s in part.column("_scene").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(data, pa.binary())], names=[*keep, "image"])

    schema = T.StructType([*(scenes.schema[k] for k in keep), T.StructField("image", T.BinaryType())])
    return scenes.mapInArrow(run, schema)


def read_png(data: bytes) -> np.ndarray:
    """The pixels of a file that `png` has written."""
    at, kinds = 8, {}
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's check sum is wrong")
        kinds[kind] = kinds.get(kind, b"") + body
        at += 12 + n
    width, height = struct.unpack(">II", kinds[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(kinds[b"IDAT"]), np.uint8).reshape(height, width + 1)
    return np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8)


def write_images(figures: DataFrame, root: str) -> DataFrame:
    """(image_path, bytes) of figures(image_path, spec, stem), each written to its image_path below `root`; the folder is made if need be.

    Reading the result writes the files, whatever task does so: a file that is there already is replaced by the same bytes.
    """
    jvm = figures.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    uri = folder.getFileSystem(figures.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for name, said in zip(batch.column("image_path").to_pylist(), batch.column("_scene").to_pylist(), strict=True):
                data = draw(said)
                place = posixpath.join(base, name)
                parent = posixpath.dirname(place)
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                part = posixpath.join(parent, f".{posixpath.basename(place)}.{uuid.uuid4().hex}")
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, place)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("image_path"), pa.array(sizes, pa.int64())], names=["image_path", "bytes"])

    return _scenes(figures, ("image_path",)).mapInArrow(run, "image_path string, bytes bigint")
