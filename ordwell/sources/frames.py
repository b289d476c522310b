"""Frames of videos as a source, and the plans that share one scan between jobs.

`FrameSource` is a Python DataSource that reads frame ranges of a store of raw arrays
(one .npy file for each video: frames x height x width x channels, memory-mapped), a
partition for each range, the region cut before anything leaves the reader.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "frame int, height int, width int, channels int, data binary"
CLIP = pa.schema([("clip", pa.string()), *((c, pa.int32()) for c in ("frame", "height", "width", "channels")), ("data", pa.binary())])


@dataclass(frozen=True)
class Job:
    """A detector: its name, region in fractions (x1, y1, x2, y2), sampling step and function (data, shape, frame) -> rows."""

    name: str
    region: tuple[float, float, float, float]
    step: int
    process: object = None

    def __post_init__(self):
        if self.step < 1 or not all(0 <= v <= 1 for v in self.region):
            raise ValueError(f"job {self.name}: step or region out of range")


def chunks(items: list, n: int) -> list[list]:
    """Lists of at most n items."""
    return [items[i : i + n] for i in range(0, len(items), n)]


def plan_ranges(start: int, end: int, workers: int, per_worker: int = 4) -> list[tuple[int, int]]:
    """Frame ranges, workers x per_worker of them; the last takes the rest, empty ones are left out."""
    parts = workers * per_worker
    size = (end - start) // parts
    cuts = [start + k * size for k in range(parts)] + [end]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def sampled(spark: SparkSession, jobs: list[Job], start: int, end: int) -> DataFrame:
    """(frame, job) of all jobs' frames: global multiples of each job's step."""
    return spark.range(start, end).select(F.col("id").cast("int").alias("frame"), F.explode(F.array(*(F.struct(F.lit(j.name).alias("job"), F.lit(j.step).alias("step")) for j in jobs))).alias("j")).where("frame % j.step = 0").select("frame", "j.job")


class RangePartition(InputPartition):
    def __init__(self, first: int, after: int):
        super().__init__((first, after))
        self.first, self.after = first, after


class FrameReader(DataSourceReader):
    """Each frame that some job needs is read once; each job's region is cut from it before anything leaves the reader."""

    def __init__(self, options):
        import numpy as np

        self.path = options["path"]
        alone = {"name": "", "step": options.get("step", 1), "region": [float(x) for x in options.get("region", "0,0,1,1").split(",")]}
        self.jobs = json.loads(options["jobs"]) if "jobs" in options else [alone]
        self.named = "jobs" in options
        self.end = min(int(options.get("end", 1 << 40)), len(np.load(self.path, mmap_mode="r")))
        self.start, self.workers = int(options.get("start", 0)), int(options.get("workers", 2))

    def partitions(self):
        return [RangePartition(a, b) for a, b in plan_ranges(self.start, self.end, self.workers)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        import numpy as np

        video = np.load(self.path, mmap_mode="r")
        h, w = video.shape[1:3]
        boxes = [(j["name"], int(j["step"]), [round(v * s) for v, s in zip(j["region"], (w, h, w, h), strict=True)]) for j in self.jobs]
        frames = [f for f in range(partition.first, partition.after) if any(f % step == 0 for _, step, _ in boxes)]
        for few in chunks(frames, 8):
            due = [(name, f, (x1, y1, x2, y2)) for f in few for name, step, (x1, y1, x2, y2) in boxes if f % step == 0]
            cut = [np.ascontiguousarray(video[f, y1:y2, x1:x2]) for _, f, (x1, y1, x2, y2) in due]
            shape = [(c.shape[0], c.shape[1], c.shape[2] if c.ndim > 2 else 1) for c in cut]
            columns = [pa.array(c, pa.int32()) for c in ([f for _, f, _ in due], *([s[k] for s in shape] for k in range(3)))]
            columns.append(pa.array([c.tobytes() for c in cut], pa.binary()))
            names = ["frame", "height", "width", "channels", "data"]
            if self.named:
                columns, names = [pa.array([n for n, *_ in due], pa.string()), *columns], ["job", *names]
            yield pa.RecordBatch.from_arrays(columns, names)


class PushedFrameReader(FrameReader):
    """A reader that takes filters on frames and jobs: ranges outside aren't planned, other jobs' regions aren't cut."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            value = getattr(f, "value", None)
            if value is None or not self.taken(f, f.attribute, value):
                yield f

    def taken(self, f: Filter, attribute: tuple[str, ...], value) -> bool:
        if attribute == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.start = max(self.start, value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                self.end = min(self.end, value + (not isinstance(f, LessThan)))
            return True
        if attribute == ("job",) and self.named and isinstance(f, (EqualTo, In)):
            names = value if isinstance(f, In) else (value,)
            self.jobs = [j for j in self.jobs if j["name"] in names]
            return True
        return False

    def partitions(self):
        return (super().partitions() if self.jobs else []) or [RangePartition(0, 0)]


class FrameSource(DataSource):
    """Options: path, start, end, workers; region and step, or jobs; pushdown=true to take filters, which needs spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "ordwell_frames"

    def schema(self) -> str:
        return f"job string, {SCHEMA}" if "jobs" in self.options else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushedFrameReader if self.options.get("pushdown", "false") == "true" else FrameReader)(self.options)


def clips(spark: SparkSession, path: str) -> DataFrame:
    """(clip, frame, height, width, channels, data) of .npy files of frames (n x height x width x channels), read through Spark.

    A clip's name ends in the number of its first frame: <name>_<first>.npy.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)_\d+\.npy$", 1).alias("clip"), F.regexp_extract("path", r"_(\d+)\.npy$", 1).cast("int").alias("first"), "content")

    def read(batches):
        import io

        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                video = np.load(io.BytesIO(row["content"]))
                for k, f in enumerate(video):
                    c = f.shape[2] if f.ndim > 2 else 1
                    yield pa.RecordBatch.from_pylist([{"clip": row["clip"], "frame": row["first"] + k, "height": f.shape[0], "width": f.shape[1], "channels": c, "data": f.tobytes()}], CLIP)

    return named.mapInArrow(read, f"clip string, {SCHEMA}")


class Dispatcher:
    """Jobs over a video's frames, one scan for all of them; run() gives a DataFrame for each job."""

    def __init__(self, spark: SparkSession, path: str, start: int = 0, end: int | None = None, workers: int = 2):
        self.spark, self.path, self.start, self.end, self.workers, self.jobs = spark, path, start, end, workers, []
        spark.dataSource.register(FrameSource)

    def register(self, job: Job) -> Dispatcher:
        import pickle

        if "<lambda>" in getattr(job.process, "__qualname__", "") or "<locals>" in getattr(job.process, "__qualname__", ""):
            raise ValueError(f"job {job.name}: the function must be at module level")
        pickle.dumps(job.process)
        self.jobs.append(job)
        return self

    def frames(self) -> DataFrame:
        """(job, frame, height, width, channels, data): each frame is read once for all jobs."""
        jobs = [{"name": j.name, "region": j.region, "step": j.step} for j in self.jobs]
        options = {"path": self.path, "jobs": json.dumps(jobs), "start": str(self.start), "workers": str(self.workers)}
        if self.end is not None:
            options["end"] = str(self.end)
        return self.spark.read.format("ordwell_frames").options(**options).load()

    def run(self, schema: str = "frame int, value double") -> dict[str, DataFrame]:
        """A job's rows by its name; all come from one pass, whose rows are kept while they are used."""
        if not self.jobs:
            return {}
        fields = T.StructType.fromDDL(schema)
        rows = self.frames().mapInPandas(_runner({j.name: j.process for j in self.jobs}, fields.names), f"job string, {schema}").persist()
        return {j.name: rows.where(F.col("job") == j.name).drop("job") for j in self.jobs}


def _runner(processes, names):
    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for r in batch.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                rows += [(r.job, *row) for row in processes[r.job](image, r.frame)]
            yield pd.DataFrame(rows, columns=["job", *names])

    return run
