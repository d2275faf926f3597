"""A data source for files of lines that grow, and a sink of lines with one write for each epoch.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").load(path)          # file, start, line
    lines.writeStream.format("growing_lines").option("path", folder)   # one text column

Paths are what Arrow's file systems reach (file://, s3://, gs://, hdfs:// where its library is installed), by driver and executors alike.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

#: Bytes that are read at once, and of one task.
CHUNK, SPLIT = 1 << 20, 32 << 20


@dataclass
class LineRange(InputPartition):
    """Lines of a file that begin in [start, end); base is where the batch begins in the file."""

    file: str
    base: int
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def complete(store: fs.FileSystem, file: fs.FileInfo) -> int:
    """Where the last finished line of a file ends."""
    at = file.size or 0
    with store.open_input_file(file.path) as f:
        while at > 0:
            low = max(0, at - CHUNK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


class TailReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file, up to the end of a line. A file that is shorter than what was read of it is read from its beginning; one that is gone is left out."""

    def __init__(self, path: str, split: int = SPLIT) -> None:
        self.path, self.split = path, split

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, top = opened(self.path)
        info = store.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            return {}
        files = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(top, recursive=True)) if x.type == fs.FileType.File and not any(p[0] in "._" for p in x.path[len(top) :].strip("/").split("/"))]
        return {x.path: complete(store, x) for x in sorted(files, key=lambda x: x.path)}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        out = []
        for file, to in end.items():
            base = start.get(file, 0)
            base = base if base <= to else 0
            out += [LineRange(file, base, a, min(a + self.split, to)) for a in range(base, to, self.split)]
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as f:
            at = partition.start
            if at > partition.base:  # a line that began before belongs to the range before
                at -= 1
                f.seek(at)
                at = self._next(f, at)
            f.seek(at)
            rest, begin = b"", at
            while begin < partition.end:
                data = f.read(CHUNK)
                if not data:
                    return
                *lines, rest = (rest + data).split(b"\n")
                starts, kept = [], []
                for line in lines:
                    if begin < partition.end and line.strip():
                        starts.append(begin), kept.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    begin += len(line) + 1
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(kept)), pa.array(starts, pa.int64()), pa.array(kept)], ["file", "start", "line"])

    @staticmethod
    def _next(f: pa.NativeFile, at: int) -> int:
        while data := f.read(CHUNK):
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
        return at


@dataclass
class Written(WriterCommitMessage):
    file: str
    lines: int


class EpochWriter(DataSourceStreamWriter):
    """Tasks write files of whole lines under names of their own; the driver's list for an epoch makes them part of the output. An epoch that has its list is not written again."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        store, top = opened(self.path)
        store.create_dir(top, recursive=True)
        name, lines = f"part-{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{top}/{name}") as f:
            for row in iterator:
                if row[0] is not None:
                    f.write(row[0].rstrip("\r\n").replace("\n", " ").encode() + b"\n")
                    lines += 1
        return Written(name, lines)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        store, top = opened(self.path)
        name = f"{top}/_epochs/{batchId:012d}.json"
        if store.get_file_info(name).type == fs.FileType.File:
            self.abort(messages, batchId)
            return
        store.create_dir(f"{top}/_epochs", recursive=True)
        with store.open_output_stream(f"{name}.new") as f:
            f.write(json.dumps([[m.file, m.lines] for m in messages if m is not None and m.lines]).encode())
        store.move(f"{name}.new", name)
        for m in messages:
            if m is not None and not m.lines:
                store.delete_file(f"{top}/{m.file}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        store, top = opened(self.path)
        for m in messages:
            if m is not None and store.get_file_info(f"{top}/{m.file}").type == fs.FileType.File:
                store.delete_file(f"{top}/{m.file}")


def committed(path: str) -> list[str]:
    """The files that the epochs of a sink name, in order."""
    store, top = opened(path)
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    lists = sorted(x.path for x in store.get_file_info(fs.FileSelector(f"{top}/_epochs", allow_not_found=True)) if x.path.endswith(".json"))
    out = []
    for name in lists:
        with store.open_input_stream(name) as f:
            out += [f"{scheme}{top}/{file}" for file, _ in json.loads(f.read())]
    return out


class GrowingLines(DataSource):
    """Reads a file, or all files of a folder, to which lines are added; writes a folder that the reader can follow."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, start long, line string"

    def streamReader(self, schema: object) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def streamWriter(self, schema: object, overwrite: bool) -> EpochWriter:  # noqa: N802
        return EpochWriter(self.options["path"])
