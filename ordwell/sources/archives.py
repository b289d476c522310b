"""Archives of matches, one zip a match, written by tasks and put in place by one commit.

A task writes its matches' archives into a folder of the run's own, streaming each document
row by row, so no match is held whole. When all tasks have succeeded, the driver moves the
archives that they report to their names; of tasks that failed or ran twice nothing stays.
The folder may be on any store that pyarrow.fs opens by its URI.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ordwell.sources.files import DOCUMENTS


@dataclass
class Written(WriterCommitMessage):
    """A task's archives: (final name, name in the run's folder)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class OneArchive:
    """A zip being written, its documents one after the other, each an array of JSON rows."""

    def __init__(self, fs: stores.FileSystem, folder: str, match: object):
        self.match, self.name, self.document, self.entry = match, f"{match}-{uuid.uuid4().hex}", None, None
        self.out = fs.open_output_stream(f"{folder}/{self.name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)

    def add(self, document: str, line: str) -> None:
        if document != self.document:
            if document not in DOCUMENTS:
                raise ValueError(f"no document named {document}")
            self.end()
            self.document, self.entry = document, self.zip.open(f"{document}.json", "w")
            self.entry.write(b"[")
        else:
            self.entry.write(b",\n")
        self.entry.write(line.encode())

    def end(self) -> None:
        if self.entry:
            self.entry.write(b"]")
            self.entry.close()

    def close(self) -> tuple[str, str]:
        self.end()
        self.zip.close()
        self.out.close()
        return f"{self.match}.zip", self.name


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (match_id, document, line), those of a match together and in order of documents."""

    def __init__(self, path: str):
        self.path, self.run = path, f"_writing-{uuid.uuid4().hex}"
        fs, root = stores.FileSystem.from_uri(path)
        fs.create_dir(f"{root}/{self.run}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = stores.FileSystem.from_uri(self.path)
        done, now = [], None
        for batch in iterator:
            for match, document, line in zip(*(batch.column(c).to_pylist() for c in ("match_id", "document", "line")), strict=True):
                if now and now.match != match:
                    done.append(now.close())
                    now = None
                now = now or OneArchive(fs, f"{root}/{self.run}", match)
                now.add(document, line)
        if now:
            done.append(now.close())
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = stores.FileSystem.from_uri(self.path)
        for final, name in (f for m in messages if m for f in m.files):
            fs.move(f"{root}/{self.run}/{name}", f"{root}/{final}")
        fs.delete_dir(f"{root}/{self.run}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = stores.FileSystem.from_uri(self.path)
        fs.delete_dir(f"{root}/{self.run}")


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordwell_archives"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


def rows_of(df: DataFrame, document: str, *order: str | Column) -> DataFrame:
    """(match_id, document, place, line) of a table with match_id: each row as JSON, to be ordered by numbers."""
    place = F.array(*((F.col(c) if isinstance(c, str) else c).cast("double") for c in order))
    return df.select("match_id", F.lit(document).alias("document"), place.alias("place"), F.to_json(F.struct(*(c for c in df.columns if c != "match_id"))).alias("line"))


def write_archives(rows: DataFrame, path: str) -> None:
    """<path>/<match_id>.zip for each match of rows (match_id, document, place, line)."""
    rows.sparkSession.dataSource.register(ArchiveSink)
    dealt = rows.repartition("match_id").sortWithinPartitions("match_id", "document", "place", "line")
    dealt.select("match_id", "document", "line").write.format("ordwell_archives").mode("append").save(path)
