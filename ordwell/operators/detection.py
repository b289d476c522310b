"""Detections from frames: kill rows of each frame's region, worked out in Arrow batches where the frames are."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordwell.functions import killfeed
from ordwell.sources.images import array_of

PLAYER = pa.struct([("team", pa.int32()), ("hero", pa.string())])
FIELDS = [
    ("frame", pa.int32()), ("row", pa.int32()), ("player1", PLAYER), ("player2", PLAYER), ("assists", pa.list_(PLAYER)),
    ("ability", pa.struct([("category", pa.string()), ("name", pa.string())])), ("is_critical", pa.bool_()), ("is_environmental", pa.bool_()),
]
DETECTION = "match_id long, frame int, row int, player1 struct<team: int, hero: string>, player2 struct<team: int, hero: string>, assists array<struct<team: int, hero: string>>, ability struct<category: string, name: string>, is_critical boolean, is_environmental boolean"
#: References are sent to all workers; more than so many bytes of them are refused.
MOST_BYTES = 256 << 20

_prepared: dict[str, killfeed.References] = {}


def references_of(pictures: DataFrame, most_bytes: int = MOST_BYTES) -> killfeed.References:
    """References from a table (kind, hero, category, name, image): kinds portrait, ability, arrow and environment."""
    size = pictures.agg(F.sum(F.octet_length("image.data"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"reference pictures of {size} bytes; at most {most_bytes} are sent to workers")
    out = killfeed.References({})
    for r in pictures.orderBy("kind", "hero", "category", "name").toLocalIterator():
        image = array_of(r.image)
        if r.kind == "portrait":
            out.portraits[r.hero] = image
        elif r.kind == "ability":
            out.abilities.setdefault(r.hero, []).append((r.category, r.name, image))
        elif r.kind in ("arrow", "environment"):
            setattr(out, r.kind, image)
        else:
            raise ValueError(f"no references of kind {r.kind}")
    return out


def in_worker(packed: bytes) -> killfeed.References:
    """The references, unpacked and prepared once in each worker process."""
    key = hashlib.sha256(packed).hexdigest()
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = pickle.loads(packed)  # noqa: S301
    return _prepared[key]


def detect_rows(regions: DataFrame, references: killfeed.References, strict: bool = False) -> DataFrame:
    """Detections in regions (match_id, frame, height, width, channels, data).

    A region that shows what can't be (three heroes in a row, several abilities) is left
    out, or with strict an error. Null data gives nothing.
    """
    packed = pickle.dumps(references)

    def run(batches):
        known = in_worker(packed)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["data"] is None:
                    continue
                image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                try:
                    found += [{"match_id": r["match_id"], **e} for e in killfeed.detect(image, r["frame"], known)]
                except ValueError:
                    if strict:
                        raise
            yield pa.RecordBatch.from_pylist(found, pa.schema([("match_id", pa.int64()), *FIELDS]))

    return regions.select("match_id", "frame", "height", "width", "channels", "data").mapInArrow(run, DETECTION)
