"""Image files as arrays: PNG and PPM decoding without an image library, and reference families.

A decoded image is (h, w) or (h, w, c), channels in the order BGR or BGRA.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "struct<height: int, width: int, channels: int, data: binary>"


def decode(raw: bytes) -> np.ndarray:
    """The image of a PNG (8 bits, not interlaced) or binary PPM/PGM file; ValueError for anything else."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _netpbm(raw)
    except (struct.error, zlib.error, IndexError, KeyError) as e:
        raise ValueError(f"broken image: {e}") from e
    raise ValueError("not an image that can be read")


def _netpbm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    w, h, c = fields[0], fields[1], 1 if raw[:2] == b"P5" else 3
    data = np.frombuffer(raw, np.uint8, h * w * c, at + 1).reshape(h, w, c)
    return data[..., 0] if c == 1 else data[..., ::-1]


def _png(raw: bytes) -> np.ndarray:
    at, body, palette, clear = 8, [], None, b""
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        part = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    if depth != 8 or interlaced:
        raise ValueError("only 8 bits a channel, not interlaced")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * c)
    out, above = np.zeros((h, w * c), np.uint8), np.zeros(w * c, np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, c)
    image = out.reshape(h, w, c)
    if colour == 3:
        alpha = np.frombuffer(clear.ljust(len(palette), b"\xff"), np.uint8)
        image = np.dstack([palette[image[..., 0]], alpha[image[..., 0]]])[..., : 4 if clear else 3]
    elif colour == 4:
        image = np.dstack([image[..., :1]] * 3 + [image[..., 1:]])
    if image.shape[2] == 1:
        return image[..., 0]
    return np.dstack([image[..., 2::-1], *([image[..., 3:]] if image.shape[2] == 4 else [])])


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, c: int) -> np.ndarray:
    """A scan line from its filtered form, by the PNG standard's five filters."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, c), axis=0, dtype=np.uint8).reshape(-1)
    left, out, up = [0] * c, [], above.tolist()
    corner = [0] * c
    for i, x in enumerate(line.tolist()):
        a, b, k = left[i % c], up[i], corner[i % c]
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa_, pb, pc = abs(b - k), abs(a - k), abs(a + b - 2 * k)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else k
        out.append((x + guess) & 255)
        left[i % c], corner[i % c] = out[-1], b
    return np.array(out, np.uint8)


def encode(image: np.ndarray) -> bytes:
    """A PNG file of an image (grey, BGR or BGRA)."""
    rgb = np.atleast_3d(image).astype(np.uint8)
    rgb = rgb if rgb.shape[2] == 1 else np.dstack([rgb[..., 2::-1], *([rgb[..., 3:]] if rgb.shape[2] == 4 else [])])
    h, w, c = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decoded(content: Column) -> Column:
    """Struct (height, width, channels, data) of an image file's bytes; what can't be read is an error."""

    @F.arrow_udf(IMAGE)
    def read(files: pa.Array) -> pa.Array:
        images = [np.atleast_3d(decode(f.as_py())) for f in files]
        shape = [pa.array([i.shape[k] for i in images], pa.int32()) for k in range(3)]
        return pa.StructArray.from_arrays([*shape, pa.array([i.tobytes() for i in images], pa.binary())], ["height", "width", "channels", "data"])

    return read(content)


def array_of(image) -> np.ndarray:
    """The array of a decoded image's row."""
    out = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["channels"])
    return out[..., 0] if image["channels"] == 1 else out


#: Folders of reference pictures and what family they are; a file's stem is its name.
FAMILIES = {"avatars": "avatar", "icons": "kill_icon", "assists": "assist_icon", "abilities": "ability_icon", "digits": "digit", "digits_observed": "digit_observed", "ultimate": "ultimate", "replay": "replay"}


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """(family, name, image) of reference pictures <path>/<folder>/<name>.png; folders that aren't a family are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.p[npg][gm]").load(path)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    families = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    named = files.select(F.try_element_at(families, folder).alias("family"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), "content")
    return named.where("family is not null").select("family", "name", decoded(F.col("content")).alias("image"))
