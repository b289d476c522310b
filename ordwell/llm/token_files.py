"""Operator 11: token ids as binary files, frequent ids short.

Ids are ranked by how often the corpus has them, so the commonest 256 take one byte each.
A rank is written in as few whole bytes as hold it; how many is kept apart, two bits each,
four to a control byte. Reading looks control bytes up in a table of lengths, whose running
sum says where each rank begins, and ranks in the table of ids: numpy calls for a block, no
loop over ids.

A folder has manifest.json (the files in order, and how many ids come before each), ids.bin
(ids by rank, unsigned 32 bits) and files of blocks: `ids`, `bytes` (unsigned 32 bits each),
control bytes, data bytes. Behind the blocks stands an Arrow table of the documents' ids and
lengths, then its length (64 bits) and MAGIC. Blocks have BLOCK ids at most and don't follow
documents, so a very long text needs no more memory than its own ids.

Files are written by the tasks of a Spark data source: each makes files of names of its own,
and only the driver's commit, which knows the tasks that succeeded, writes the manifest and
deletes what others left. Readers see what the manifest names. The folder may be on any store
that pyarrow.fs opens by its URI.

Documents come in ascending order of id: nulls first, equal ids by a hash of the text, so
repeated rows each have a place. Null and empty texts have the end id alone. An empty table
gives a folder without files, and reads as no rows. Other columns of df aren't looked at.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain, pairwise, repeat
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from ordwell.llm.bpe import pretokens
from ordwell.llm.common import forget, release, settle, shared_dir, table
from ordwell.llm.token_counts import vocabulary_path

END = 2
MAGIC = b"ORDTOK01"
#: Ids in a block, in a file (a text may exceed it), and in a part of the sort.
BLOCK, FILE, PART = 1 << 19, 1 << 23, 1 << 23
#: Characters of a text that are encoded at once, and bytes of texts that are worked on together.
LONG, TOGETHER = 1 << 18, 1 << 22
#: Words whose ids a worker keeps, the length of the longest of them, and how many the library is given as one text.
WORDS, WORD, JOINED = 1_000_000, 64, 1000
#: How rows are ordered, and what ids of so many bytes are.
ORDER, WIDTHS = ("doc_id", "tie", "row"), {1: "u1", 2: "<u2", 4: "<u4"}
#: Ids of a batch that the reader hands over.
BATCH = 1 << 20

# A blank before a character that is surely no white space always begins a pre-token of the byte-level
# pre-tokenizer, so a text's ids are those of its pieces between such blanks.
CUT = re.compile(" (?=[!-~¡-ᙿ])")

# Texts that begin with such a blank and end in no white space have the same ids one after the other in one text.
APART = re.compile(" (?=[!-~¡-ᙿ぀-퟿]).*[!-~¡-ᙿ぀-퟿]", re.DOTALL)

#: For each control byte the lengths of its four ranks.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MORE = (LENGTHS - np.uint8(1)).view("<u4").reshape(-1)


class Encoder:
    """Ids of texts by the tokenizers library, packed in two or four bytes an id.

    A byte-level text's ids are those of its pre-tokens one after the other. So the library is
    given each distinct pre-token once in a worker (while it keeps it), not all texts, and many
    of them as one text: their ids are told apart by how many bytes each id stands for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.size = max(self.library.get_vocab_size(), END + 1)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        #: Numbers of the words kept; word i has the ids known[at[i] : at[i + 1]].
        self.words: dict[bytes, int] = {}
        self.known, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)
        vocabulary, model = self.library.get_vocab(), spec["model"]
        self.joins = self.by_piece and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.joins = self.joins and all(c in vocabulary for c in ByteLevel.alphabet()) and not any(" " in a for a in self.added)
        #: How many bytes an id stands for.
        self.stands = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.stands[list(vocabulary.values())] = list(map(len, vocabulary))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a long text is taken in pieces that give the same ids."""
        pieces, ends = [], []
        for text in texts:
            pieces += self.pieces(text or "")
            ends.append(len(pieces))
        ids: list[bytes] = [b""] * len(pieces)
        plain, whole, held = [], [], 0
        for k, piece in enumerate(pieces):
            if not self.by_piece or len(piece) > 4 * LONG or any(a in piece for a in self.added):
                whole.append(k)
                continue
            plain.append(k)
            held += len(piece)
            if held >= TOGETHER:
                self.fill(ids, plain, self.by_words([pieces[i] for i in plain]))
                plain, held = [], 0
        self.fill(ids, plain, self.by_words([pieces[i] for i in plain]))
        self.fill(ids, whole, self.by_library([pieces[i] for i in whole]))
        return [b"".join(ids[a:z]) for a, z in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def fill(ids: list[bytes], at: list[int], own: list[bytes]) -> None:
        for k, x in zip(at, own, strict=True):
            ids[k] = x

    def by_library(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Short ones are encoded as one text where that changes no ids."""
        short = [k for k, x in enumerate(texts) if len(x) <= WORD and APART.fullmatch(x)] if self.joins and len(texts) > 1 else []
        few = [texts[k] for k in short]
        if not short or (own := self.together(few)) is None:
            return self.one_by_one(texts)
        ids: list[bytes] = [b""] * len(texts)
        self.fill(ids, short, own)
        others = [k for k in range(len(texts)) if not ids[k]]
        self.fill(ids, others, self.one_by_one([texts[k] for k in others]))
        return ids

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The library's ids of texts one after the other, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = list(map(len, found))
        return np.fromiter(chain.from_iterable(found), self.kind, sum(sizes)), sizes

    def one_by_one(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encode_all(texts)
        return cut(ids.tobytes(), [0, *accumulate(n * self.kind.itemsize for n in sizes)])

    def together(self, texts: list[str]) -> list[bytes] | None:
        """Packed ids of texts that fit APART, many encoded as one; None if ids don't end where texts do."""
        joined = ["".join(texts[a : a + JOINED]) for a in range(0, len(texts), JOINED)]
        if any(a in x for x in joined for a in self.added):
            return None
        ids, _ = self.encode_all(joined)
        ends = np.cumsum(self.stands[ids])
        own = np.cumsum(pc.binary_length(pa.array(texts, pa.large_string())).to_numpy())
        last = np.searchsorted(ends, own)
        if not len(ends) or ends[-1] != own[-1] or (ends[last] != own).any():
            return None
        return cut(ids.tobytes(), np.append(0, (last + 1) * self.kind.itemsize).tolist())

    def by_words(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts without added strings: each pre-token's ids, put one after the other."""
        column = pa.array(texts, pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        if not bounds[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(column.buffers()[2], np.uint8)[: bounds[-1]]
        at = pretokens(data, np.unique(bounds[:-1][bounds[:-1] < len(data)]))
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        number, known, begins = self.of_words(values(words.dictionary))
        sizes, begins = begins[number + 1] - begins[number], begins[number]
        code = words.indices.to_numpy()
        out, ends = spread(known, begins[code], sizes[code])
        return cut(out.tobytes(), (np.append(0, ends)[np.searchsorted(at, bounds)] * self.kind.itemsize).tolist())

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of distinct pre-tokens, ids of those kept and of the others from the library, and where each number's begin."""
        number = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0).tolist()
        if len(self.words) + len(new) > WORDS:
            self.keep(words, number)
        short, long = [], []
        for k in new:
            (short if len(words[k]) <= WORD else long).append(k)
        new = short + long
        packed: list[bytes] = []
        for a in range(0, len(new), 10_000):
            packed += self.by_library([words[k].decode() for k in new[a : a + 10_000]])
        number[new] = np.arange(len(new)) + len(self.words)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        known = np.concatenate([self.known, np.frombuffer(b"".join(packed), self.kind)])
        at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.words.update(zip((words[k] for k in short), range(len(self.words), len(self.words) + len(short)), strict=True))
        self.at = at[: len(self.words) + 1]
        self.known = known[: self.at[-1]]
        return number, known, at

    def keep(self, words: list[bytes], number: np.ndarray) -> None:
        """Keep no words but these, as far as they have numbers, and number them anew."""
        have = np.flatnonzero(number >= 0)
        begins = self.at[number[have]]
        self.known, ends = spread(self.known, begins, self.at[number[have] + 1] - begins)
        self.at = np.append(0, ends)
        self.words = {words[k]: i for i, k in enumerate(have.tolist())}
        number[have] = np.arange(len(have))

    def pieces(self, text: str) -> list[str]:
        out, at = [], 0
        if self.by_piece and len(text) > LONG and not any(a in text for a in self.added):
            while len(text) - at > LONG and (cut := CUT.search(text, at + LONG)):
                out.append(text[at : cut.start()])
                at = cut.start()
        return [*out, text[at:]]


def values(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without nulls that isn't sliced."""
    return cut(column.buffers()[2].to_pybytes(), np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1].tolist())


def cut(raw: bytes, cuts: list[int]) -> list[bytes]:
    return [raw[a:z] for a, z in pairwise(cuts)]


def spread(known: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known one after the other, and where each ends there."""
    ends = np.cumsum(sizes)
    return known[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def data_bytes(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many bytes each rank takes besides one, where each begins (and the last ends), and the bytes."""
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    at = np.zeros(len(ranks) + 1, np.int64)
    np.cumsum(more + np.uint8(1), out=at[1:])
    data = np.empty(at[-1], np.uint8)
    data[at[:-1]] = ranks.astype(np.uint8)
    for k in range(1, int(more.max(initial=0)) + 1):
        has = np.flatnonzero(more >= k)
        data[at[has] + k] = (ranks[has] >> 8 * k).astype(np.uint8)
    return more, at, data


def control_bytes(more: np.ndarray) -> np.ndarray:
    a, b, c, d = more.reshape(-1, 4).T
    return a | b << 2 | c << 4 | d << 6


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    more, _, data = data_bytes(ranks)
    return controls(more), data.tobytes()


def controls(more: np.ndarray) -> bytes:
    return control_bytes(np.pad(more, (0, -len(more) % 4))).tobytes()


def pack_rows(ranks: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control bytes and data bytes of rows whose ranks, so many each, stand one after the other."""
    more, at, data = data_bytes(ranks)
    own, has = places(sizes)
    padded = np.zeros(len(has), np.uint8)
    padded[has] = more
    return rows_of(control_bytes(padded), np.cumsum(own)), rows_of(data, at[np.cumsum(sizes)])


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many control bytes rows of so many ranks have, and which of their quarters stand for a rank."""
    own = -(-sizes // 4)
    ends = 4 * np.cumsum(own)
    has = np.ones(ends[-1] if len(ends) else 0, bool)
    for k in (1, 2, 3):
        has[ends[4 * own - sizes >= k] - k] = False
    return own, has


def unpack_rows(sizes: np.ndarray, control: pa.Array, data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many bytes the ranks of all rows take besides one, the rows' bytes, and where each row's begin (and the last end)."""
    codes, n_control = flat(control, 1)
    raw, n_data = flat(data, 1)
    own, has = places(sizes)
    if (own != n_control).any():
        raise ValueError("ranks of a row are out of bounds of its control bytes")
    more = MORE[codes].view(np.uint8)[has]
    so_far = np.zeros(len(more) + 1, np.int64)
    np.cumsum(more, out=so_far[1:])
    ends = np.append(0, np.cumsum(sizes))
    at = so_far[ends] + ends
    if (np.diff(at) != n_data).any():
        raise ValueError("ranks of a row are out of bounds of its data bytes")
    return more, raw, at


def rows_of(content: np.ndarray, ends: np.ndarray) -> pa.Array:
    """content as rows that end at ends."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(content)]).cast(pa.binary())


def flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a column one after the other, and how many each row has. Its rows aren't null."""
    column = column.cast(pa.large_binary())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], WIDTHS[width], (cuts[-1] - cuts[0]) // width, cuts[0]), np.diff(cuts) // width


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks behind control and data bytes."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(lengths > k)
        if not len(has):
            break
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path)


def put(path: str, name: str, content: bytes) -> None:
    fs, root = store(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as f:
        f.write(content)


def get(path: str, name: str) -> bytes:
    fs, root = store(path)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return f.read()


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (part, number in the part, name, documents, ids)."""

    files: list[tuple[int, int, str, int, int]] = field(default_factory=list)


class OneFile:
    """A file being written, block by block."""

    def __init__(self, path: str, part: int, number: int, kind: pa.DataType):
        self.part, self.number, self.name, self.kind = part, number, f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok", kind
        fs, root = store(path)
        self.out = fs.open_output_stream(f"{root}/{self.name}")
        self.ids: list = []
        self.lengths: list[int] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.total = 0

    def add(self, doc_id, more: np.ndarray, data: np.ndarray) -> None:
        """A document's ranks, by how many bytes each takes besides one, and their bytes."""
        self.ids.append(doc_id)
        self.lengths.append(len(more))
        self.held.append((more, data))
        self.waiting += len(more)
        self.total += len(more)
        if self.waiting >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            more, data = (np.concatenate(x) for x in zip(*self.held, strict=True))
            at = 0
            for a in range(0, len(more), BLOCK):
                own = more[a : a + BLOCK]
                n_data = len(own) + int(own.sum())
                self.out.write(np.array([len(own), n_data], "<u4").tobytes() + controls(own) + data[at : at + n_data].tobytes())
                at += n_data
        self.held, self.waiting = [], 0

    def close(self) -> tuple[int, int, str, int, int]:
        self.flush()
        sink = pa.BufferOutputStream()
        index = pa.table({"doc_id": pa.array(self.ids, self.kind), "n_tokens": pa.array(self.lengths, pa.int64())})
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        index = sink.getvalue().to_pybytes()
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.part, self.number, self.name, len(self.ids), self.total


class TokenWriter(DataSourceArrowWriter):
    """Writes rows (part, doc_id, n, control, data), sorted by part and place."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        kind, done, now = to_arrow_type(self.schema["doc_id"].dataType), [], None
        for few in (x for batch in iterator for x in slices(batch, "data")):
            parts, ids, sizes = few.column("part").to_pylist(), few.column("doc_id").to_pylist(), few.column("n").to_numpy()
            more, data, at = unpack_rows(sizes, few.column("control"), few.column("data"))
            ends = np.cumsum(sizes)
            for part, doc_id, own, raw in zip(parts, ids, np.split(more, ends[:-1]), np.split(data, at[1:-1]), strict=True):
                if now and (now.part != part or now.total >= FILE):
                    done.append(now.close())
                    now = OneFile(self.path, part, now.number + 1 if now.part == part else 0, kind)
                now = now or OneFile(self.path, part, 0, kind)
                now.add(doc_id, own, raw)
        if now:
            done.append(now.close())
        release()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, start = [], 0
        for _, _, name, docs, ids in sorted(f for m in messages if m for f in m.files):
            files.append({"name": name, "start": start, "documents": docs, "ids": ids})
            start += ids
        self.sweep({f["name"] for f in files})
        kind = self.schema["doc_id"].dataType.simpleString()
        put(self.path, "manifest.json", json.dumps({"doc_id": kind, "ids": start, "files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.sweep(set())

    def sweep(self, named: set[str]) -> None:
        """Delete files that the manifest won't name: of tasks that failed or ran twice."""
        fs, root = store(self.path)
        for info in fs.get_file_info(stores.FileSelector(root)):
            if info.base_name.endswith(".tok") and info.base_name not in named:
                fs.delete_file(info.path)


class FilePartition(InputPartition):
    def __init__(self, name: str, start: int):
        super().__init__((name, start))
        self.name, self.start = name, start


class TokenReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        files = json.loads(get(self.path, "manifest.json"))["files"]
        return [FilePartition(f["name"], f["start"]) for f in files] or [FilePartition("", 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        by_rank = np.frombuffer(get(self.path, "ids.bin"), "<u4")
        fs, root = store(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            size = f.size()
            tail = f.read_at(16, size - 16)
            if tail[8:] != MAGIC:
                raise ValueError(f"{partition.name} isn't whole")
            after = size - 16 - int.from_bytes(tail[:8], "little")
            index = pa.ipc.open_stream(f.read_at(size - 16 - after, after)).read_all().combine_chunks()
            lengths = index["n_tokens"].to_numpy()
            ends = np.cumsum(lengths)
            held, have, given, first = np.empty(0, np.uint32), 0, 0, 0
            at = 0
            for k in range(len(lengths)):
                if ends[k] - (ends[first] - lengths[first]) < BATCH and k + 1 < len(lengths):
                    continue
                blocks = [held]
                while have < ends[k]:
                    n, n_data = np.frombuffer(f.read_at(8, at), "<u4").tolist()
                    n_control = ceil(n / 4)
                    raw = f.read_at(n_control + n_data, at + 8)
                    blocks.append(by_rank[unpack(raw[:n_control], raw[n_control:], n)])
                    at, have = at + 8 + n_control + n_data, have + n
                held = np.concatenate(blocks)
                offsets = (np.concatenate([[0], ends[first : k + 1] - given]) * 4).astype(np.int64)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), k + 1 - first, [None, pa.py_buffer(offsets), pa.py_buffer(held.astype("<u4"))])
                starts = partition.start + ends[first : k + 1] - lengths[first : k + 1]
                yield pa.RecordBatch.from_arrays([index["doc_id"].slice(first, k + 1 - first).combine_chunks(), pa.array(starts, pa.int64()), pa.array(lengths[first : k + 1], pa.int64()), ids.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                held, given, first = held[ends[k] - given :], ends[k], k + 1


class TokenFiles(DataSource):
    """Folders of token files: (doc_id, start, n_tokens, ids), ids as little-endian unsigned 32-bit integers."""

    @classmethod
    def name(cls) -> str:
        return "ordwell_tokens"

    def schema(self) -> str:
        kind = json.loads(get(self.options["path"], "manifest.json"))["doc_id"]
        return f"doc_id {kind}, start long, n_tokens long, ids binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TokenReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options["path"], schema)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """batch in slices of about TOGETHER bytes of a column, or a row."""
    so_far = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(so_far // TOGETHER)) + 1).tolist(), len(batch)]
    return (batch.slice(a, z - a) for a, z in pairwise(cuts) if z > a)


def encoded(df: DataFrame, doc_id: str, text: str, vocabulary: str | None, end: int) -> DataFrame:
    """(doc_id, tie, row, width, ids) of df: the texts' ids with the end id behind, width bytes each."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(vocabulary or vocabulary_path())
        tail = np.array([end], machine.kind).tobytes()
        for batch in batches:
            for few in slices(batch):
                ids = pa.array([x + tail for x in machine.encode(few.column("text").to_pylist())], pa.binary())
                width = pa.array(np.full(len(few), machine.kind.itemsize, np.int8), pa.int8())
                yield pa.RecordBatch.from_arrays([*(few.column(c) for c in ORDER), width, ids], [*ORDER, "width", "ids"])
            release()

    return docs.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, row long, width byte, ids binary")


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all rows of ids; each task adds its own up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            if len(batch):
                more = np.bincount(flat(batch.column("ids"), batch.column("width")[0].as_py())[0])
                if len(more) > len(n):
                    n = np.pad(n, (0, len(more) - len(n)))
                n[: len(more)] += more
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["id", "n"])

    return ids.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(spark: SparkSession, df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END, part: int = PART) -> None:
    """Write the ids of df's texts, each with the end id behind it, to a new folder.

    Texts are encoded once, their ids settled; then ids are counted (a row for each id and
    task), and rows go to parts of about `part` ids in order of doc_id. The parts' bounds, one
    for each, are all that the driver holds besides a row for each id of the vocabulary.
    """
    spark.dataSource.register(TokenFiles)
    ids = settle(spark, encoded(df, doc_id, text, vocabulary, end), compression="zstd")
    counts = sorted(((r.n, -r.id) for r in id_counts(ids).collect()), reverse=True)
    by_rank = np.array([-i for _, i in counts], "<u4")
    put(path, "ids.bin", by_rank.tobytes())
    ranks = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    parts = max(1, ceil(sum(n for n, _ in counts) / part))
    bounds: list[tuple] = []
    if parts > 1:
        spread = ids.select(*ORDER).repartitionByRange(parts, *ORDER).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*ORDER)).alias("least"))
        bounds = sorted((r.least.doc_id is not None, r.least.doc_id if r.least.doc_id is not None else 0, r.least.tie, r.least.row) for r in spread.collect())[1:]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in (batch.slice(a, 500) for a in range(0, len(batch), 500)):
                keys = zip(*(few.column(c).to_pylist() for c in ORDER), strict=True)
                own = [bisect_right(bounds, (i is not None, i if i is not None else 0, tie, row)) for i, tie, row in keys]
                coded, n = flat(few.column("ids"), few.column("width")[0].as_py())
                control, data = pack_rows(ranks[coded], n)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(few.column(c) for c in ORDER), pa.array(n, pa.int64()), control, data], ["part", *ORDER, "n", "control", "data"])
            release()

    kind = ids.schema["doc_id"].dataType.simpleString()
    placed = ids.mapInArrow(place, f"part int, doc_id {kind}, tie long, row long, n long, control binary, data binary")
    rows = placed.repartitionById(max(parts, len(bounds) + 1), F.col("part")).sortWithinPartitions("part", *ORDER)
    rows.select("part", "doc_id", "n", "control", "data").write.format("ordwell_tokens").mode("append").save(path)
    forget(spark, ids)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a folder that write_tokens made."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("ordwell_tokens").load(path)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files written."""
    path = f"{shared_dir(spark)}/ordwell/{uuid.uuid4().hex}"
    write_tokens(spark, table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op11_token_files": op11_token_files}
#: The ids are the tokenizers library's, which SQL can't give; tests hold files to it.
ORACLES: dict[str, str] = {}
