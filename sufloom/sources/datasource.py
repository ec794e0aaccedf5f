"""Sequence files as registered data sources: spark.read.format("fasta"), spark.read.format("patterns") and
df.write.format("patterns"), after register(spark).

Reads are planned by byte offsets: a file of any size is cut into splits of `splitBytes` (option, 64 MB where not given), each
read by a task of its own, which holds one record or one run of patterns at a time. A pattern read has at most MOST splits and
one more for each file, however small splitBytes is: splits are as large as that takes, as a task costs more than a few KB. A schema given to the reader names the
columns that are made; the others aren't. Files are opened through pyarrow's file systems (local, hdfs, s3, gs, abfs), by which
driver and executors must reach them; where only Spark's own readers do, sufloom.sources.files has readers for the same files.

Defined results: a file without records, or a folder without files, gives no rows. Hidden files (_ or . first) are passed over.
A pattern file that is shorter than its header says is an error. A gzip FASTA file is one split. Null patterns are an error
when written, empty ones are files of length 0, which hold no patterns, so they are an error too.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SPLIT = 64 << 20
MOST = 512  # splits of a read; where splitBytes would give more, they are larger
HEADER = struct.Struct("<II")  # length of a pattern, number of patterns


def file_system(path: str):
    """(pyarrow file system, path in it) of a path or address."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def files_at(path: str) -> list[tuple[str, int]]:
    """(path in the file system, bytes) of the file, or of the files of the folder, in order of their names."""
    from pyarrow import fs

    system, own = file_system(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(own))
    return sorted((f.path, f.size) for f in found if f.is_file and (info.is_file or not f.base_name.startswith(("_", "."))))


@dataclass
class Split(InputPartition):
    """Bytes [start, end) of a file; of a pattern file, the patterns of these numbers."""

    file: str
    start: int
    end: int
    size: int = 0


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options) -> None:
        self.path, self.bytes, self.columns = options["path"], int(options.get("splitBytes", SPLIT)), schema.names
        if unknown := set(self.columns) - set(self.known):
            raise ValueError(f"no such columns: {sorted(unknown)}; there are {', '.join(self.known)}")
        if self.bytes < 1:
            raise ValueError("splitBytes must be at least 1")

    known: tuple[str, ...] = ()


class PatternReader(_Reader):
    known = ("file", "pattern_id", "pattern")

    def partitions(self) -> list[Split]:
        system, _ = file_system(self.path)
        out, found = [], files_at(self.path)
        least = max(self.bytes, sum(size for _, size in found) // MOST)
        for file, size in found:
            with system.open_input_file(file) as f:
                head = f.read(HEADER.size)
            if len(head) < HEADER.size:
                raise ValueError(f"{file}: no header of a pattern batch")
            length, number = HEADER.unpack(head)
            if size < HEADER.size + length * number:
                raise ValueError(f"{file}: {size} bytes, but {number} patterns of {length} characters")
            if length:
                each = max(1, least // length)
                out += [Split(file, i, min(number, i + each), length) for i in range(0, number, each)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        if split is None:  # no files, or none with patterns
            return
        system, _ = file_system(self.path)
        run = max(1, (4 << 20) // split.size)
        with system.open_input_file(split.file) as f:
            for at in range(split.start, split.end, run):
                n = min(run, split.end - at)
                made = {"file": lambda: pa.repeat(split.file, n), "pattern_id": lambda: pa.array(np.arange(at, at + n))}  # noqa: B023

                def pattern():
                    raw = f.read_at(n * split.size, HEADER.size + at * split.size)  # noqa: B023
                    cut = pa.FixedSizeBinaryArray.from_buffers(pa.binary(split.size), n, [None, pa.py_buffer(raw)])  # noqa: B023
                    # Letters as the text reader folds them: acgt in upper case, all others as they are.
                    text = cut.cast(pa.binary()).cast(pa.string())
                    for a, b in zip("acgt", "ACGT"):
                        text = pc.replace_substring(text, a, b)
                    return text

                yield pa.RecordBatch.from_arrays([(made.get(c) or pattern)() for c in self.columns], names=self.columns)


class FastaReader(_Reader):
    known = ("file", "name", "seq")
    block = 1 << 20

    def partitions(self) -> list[Split]:
        out = []
        for file, size in files_at(self.path):
            each = max(size, 1) if file.endswith(".gz") else self.bytes
            out += [Split(file, i, min(size, i + each)) for i in range(0, size, each)]
        return out

    def read(self, split: Split) -> Iterator[tuple]:
        """The records whose mark lies in the split, each to its end, which may lie in later ones."""
        if split is None:  # no files, or empty ones
            return
        system, _ = file_system(self.path)
        packed = split.file.endswith(".gz")
        f = system.open_input_stream(split.file, compression="gzip") if packed else system.open_input_file(split.file)
        with f:
            # The byte before the split says whether its first byte begins a line.
            at = max(0, split.start - 1)
            if not packed:
                f.seek(at)
            end = None if packed else split.end
            name, seq = None, []
            for start, line in self._lines(f, at, at == 0, end):
                if line[:1] == b">":
                    if name is not None:
                        yield self._row(split.file, name, seq)
                        name, seq = None, []
                    if end is not None and start >= end:
                        return
                    if start >= split.start:
                        name = line[1:].replace(b"\t", b" ").split(b" ", 1)[0]
                elif name is not None:
                    if "seq" in self.columns:
                        seq.append(line)
                elif end is not None and start >= end:
                    return
            if name is not None:
                yield self._row(split.file, name, seq)

    def _lines(self, f, at: int, whole: bool, end: int | None) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of the lines from the first that begins behind `at`, or at it where `whole`; none where no line
        begins before `end`. A line longer than a block is put together once, at its end."""
        begun, rest, read = whole, [], at
        while data := f.read(self.block):
            read += len(data)
            if not begun and end is not None and read >= end and b"\n" not in data:
                return
            rows = data.split(b"\n")
            rows[0], rest = b"".join([*rest, rows[0]]) if len(rows) > 1 else b"", [*rest, rows[0]] if len(rows) == 1 else [rows[-1]]
            for row in rows[:-1]:
                if begun:
                    yield at, row.removesuffix(b"\r")
                begun = True
                at += len(row) + 1
        if begun and any(rest):
            yield at, b"".join(rest).removesuffix(b"\r")

    def _row(self, file: str, name: bytes, seq: list[bytes]) -> tuple:
        made = {"file": lambda: file, "name": name.decode, "seq": lambda: b"".join(seq).decode()}
        return tuple(made[c]() for c in self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PatternWriter(DataSourceArrowWriter):
    """Each task writes its patterns as files of one length each, of at most `splitBytes`, under names that begin with _; the
    driver renames them once all tasks are done, so that a lost or repeated task leaves nothing that a reader takes."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.bytes = options["path"], int(options.get("splitBytes", SPLIT))
        if overwrite:
            raise ValueError('a batch of patterns is written to a new folder, or with mode("append")')

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        held: dict[int, list[bytes]] = {}
        total, out = 0, []

        def flush(length: int) -> None:
            rows = held.pop(length)
            name = f"part-{uuid.uuid4().hex}.bin"
            with system.open_output_stream(posixpath.join(folder, "_" + name)) as f:
                f.write(HEADER.pack(length, len(rows)) + b"".join(rows))
            out.append((posixpath.join(folder, "_" + name), posixpath.join(folder, name)))

        for batch in batches:
            for text in batch.column(batch.schema.names.index("pattern")).to_pylist():
                if not text:
                    raise ValueError("a null or empty pattern can't be written to a batch")
                raw = text.encode()
                held.setdefault(len(raw), []).append(raw)
                total += len(raw)
                if total >= self.bytes:
                    largest = max(held, key=lambda n: n * len(held[n]))
                    total -= largest * len(held[largest])
                    flush(largest)
        for length in sorted(held):
            flush(length)
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for hidden, name in message.files if message else []:
                system.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for message in messages:
            for hidden, _ in message.files if message else []:
                system.delete_file(hidden)


class Patterns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "patterns"

    def schema(self) -> str:
        return "file string, pattern_id long, pattern string"

    def reader(self, schema: StructType) -> PatternReader:
        return PatternReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PatternWriter:
        return PatternWriter(self.options, overwrite)


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, name string, seq string"

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Patterns)
    spark.dataSource.register(Fasta)
