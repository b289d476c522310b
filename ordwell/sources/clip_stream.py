"""Frames of clips as a stream with admission control.

`ClipStream` is a Python streaming source over a folder of clips (.npy files of frames x height
x width x channels, named <name>_<number of the first frame>.npy, as `frames.clips` reads). A
micro-batch takes at most `frames` frames, whatever has arrived, so a backlog is worked off in
even batches; a task of it at most `per_task` of them, of one clip, of which it reads only these.

An offset says for each clip how many of its frames were planned. Spark keeps it in the query's
checkpoint, but doesn't tell the reader where a restarted query stands, which the reader needs
to bound the next batch. So planning a batch also writes its end to the folder `position`:
Spark has logged that end before and plans it again after a stop, so the two agree, and no frame
is left out or comes twice. A query needs a position folder of its own; starting without a
checkpoint starts the position anew.

The folders may be on any store that pyarrow.fs opens and that driver and executors share. A clip
must be moved into the folder when it is whole. An offset grows with the clips of the folder;
empty clips and other files are passed over; the frames of a clip come in order within a batch's
task, and batches take clips by name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ordwell.sources.frames import CLIP, SCHEMA

NAME = re.compile(r"(.+)_(\d+)\.npy")
FEW = 8  # frames in an Arrow batch


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
    return fs.FileSystem.from_uri(path)


def shape_of(file) -> tuple[tuple[int, ...], object, int]:
    """Shape, kind of value and start of the values of an opened .npy file."""
    from numpy.lib import format as npy

    version = npy.read_magic(file)
    shape, by_column, dtype = npy.read_array_header_1_0(file) if version == (1, 0) else npy.read_array_header_2_0(file)
    if by_column or not 3 <= len(shape) <= 4 or dtype.itemsize != 1:
        raise ValueError("a clip must hold bytes, frames x height x width (x channels), a frame after the other")
    return shape, dtype, file.tell()


class ClipRange(InputPartition):
    def __init__(self, clip: str, first: int, after: int):
        super().__init__((clip, first, after))
        self.clip, self.first, self.after = clip, first, after


class ClipStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.position = options["path"], options["position"]
        self.most, self.per_task = int(options.get("frames", 256)), int(options.get("per_task", 64))
        if self.most < 1 or self.per_task < 1:
            raise ValueError("frames and per_task must be at least 1")
        self.lengths: dict[str, int] = {}

    def look(self) -> dict[str, int]:
        """The number of frames of each clip in the folder; a clip is opened once."""
        store, folder = store_of(self.path)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.File and NAME.fullmatch(info.base_name) and info.base_name not in self.lengths:
                with store.open_input_file(info.path) as file:
                    self.lengths[info.base_name] = shape_of(file)[0][0]
        return self.lengths

    def planned(self) -> dict[str, int]:
        store, folder = store_of(self.position)
        if store.get_file_info(f"{folder}/position.json").type != fs.FileType.File:
            return {}
        with store.open_input_stream(f"{folder}/position.json") as file:
            return json.loads(file.read())

    def plan(self, end: dict[str, int]) -> None:
        store, folder = store_of(self.position)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/next.json") as file:
            file.write(json.dumps(end).encode())
        store.move(f"{folder}/next.json", f"{folder}/position.json")

    def initialOffset(self) -> dict:
        self.plan({})
        return {}

    def latestOffset(self) -> dict:
        """What was planned and at most `frames` more."""
        end, left = self.planned(), self.most
        for clip, n in sorted(self.look().items()):
            taken = min(left, n - end.get(clip, 0))
            if taken > 0:
                end[clip], left = end.get(clip, 0) + taken, left - taken
        return end

    def partitions(self, start: dict, end: dict) -> list[ClipRange]:
        self.plan(end)
        spans = [(clip, start.get(clip, 0), stop) for clip, stop in sorted(end.items())]
        return [ClipRange(clip, a, min(stop, a + self.per_task)) for clip, first, stop in spans for a in range(first, stop, self.per_task)]

    def read(self, partition: ClipRange) -> Iterator[pa.RecordBatch]:
        name, number = NAME.fullmatch(partition.clip).groups()
        store, folder = store_of(self.path)
        with store.open_input_file(f"{folder}/{partition.clip}") as file:
            shape, dtype, begin = shape_of(file)
            height, width, channels = *shape[1:3], shape[3] if len(shape) > 3 else 1
            size = height * width * channels
            for a in range(partition.first, partition.after, FEW):
                ids = range(a, min(partition.after, a + FEW))
                file.seek(begin + a * size)
                block = file.read(len(ids) * size)
                rows = [{"clip": name, "frame": int(number) + k, "height": height, "width": width, "channels": channels, "data": block[(k - a) * size : (k - a + 1) * size]} for k in ids]
                yield pa.RecordBatch.from_pylist(rows, CLIP)

    def commit(self, end: dict) -> None:
        """Nothing to do: clips stay, and the position was written when the batch was planned."""


class ClipStream(DataSource):
    """Options: path and position (folders), frames (most in a micro-batch, 256), per_task (64)."""

    @classmethod
    def name(cls) -> str:
        return "ordwell_clip_stream"

    def schema(self) -> str:
        return f"clip string, {SCHEMA}"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ClipStreamReader(self.options)


def write_clips(frames: DataFrame, path: str, most: int = 256) -> None:
    """Pictures of one size (columns height, width, channels, data) as clips of at most `most` frames, written by tasks into a folder.

    A clip's name is that of its partition, its number that of its first frame there, so a task that runs
    again writes the same clips; each is moved to its name when it is whole. Rows without data are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np
        from pyspark import TaskContext

        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        context, n = TaskContext.get(), 0
        held: list[np.ndarray] = []

        def put() -> None:
            out, name = io.BytesIO(), f"{folder}/part{context.partitionId()}_{n - len(held)}.npy"
            np.save(out, np.stack(held))
            with store.open_output_stream(f"{name}.{context.taskAttemptId()}") as file:
                file.write(out.getbuffer())
            store.move(f"{name}.{context.taskAttemptId()}", name)
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if r["data"] is not None:
                    held.append(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]))
                    n += 1
                    if len(held) == most:
                        put()
        if held:
            put()
        yield pa.RecordBatch.from_pylist([{"n": n}], pa.schema([("n", pa.int64())]))

    frames.select("height", "width", "channels", "data").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
