"""Logs that grow and rotate, as a Spark data source read by (file, byte) in splits.

Every line comes with its file, the byte at which it starts, and the separator and field names that the file's own header gives, so
a split of a large monitor log needs no join to be parsed. As a stream, offsets hold how far each file was read: lines
appended later are read once, an unfinished last line waits for its end, and a rotated file goes on under its new name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
SCHEMA = "file string, byte bigint, separator string, fields string, line string"
#: Bytes of a split, of one read, of a file's start by which it is known again, and in which its header is looked for.
SPLIT, CHUNK, KNOWN_BY, HEADER = 64 << 20, 4 << 20, 1024, 64 << 10


@dataclass
class Stretch(InputPartition):
    """Lines that start in [begin, stop) of a file read up to ``end``; ``first`` is where the first new line starts."""

    path: str
    head: str
    known_by: int
    first: int
    begin: int
    stop: int
    end: int


class Folder:
    """The files below a path whose names fit a pattern, on any file system that Arrow knows."""

    def __init__(self, options: dict[str, str]) -> None:
        named = {k.lower(): v for k, v in options.items()}  # Spark hands option names over in lower case
        self.root, self.pattern = named["path"], named.get("glob", "*")
        self.split = int(named.get("splitbytes", SPLIT))

    def store(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.root and not self.root.startswith("file:"):
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", self.root)

    def listed(self) -> dict[str, fs.FileInfo]:
        store, root = self.store()
        own = store.get_file_info(root)
        if own.type == fs.FileType.File:
            return {own.path: own}
        infos = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {i.path: i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")) and fnmatch(i.base_name, self.pattern)}

    def state(self, info: fs.FileInfo) -> dict | None:
        """Bytes up to the last line end, and the digest of the file's start."""
        store, _ = self.store()
        with store.open_input_file(info.path) as f:
            end = info.size
            while end > 0:
                begin = max(0, end - HEADER)
                at = f.read_at(end - begin, begin).rfind(b"\n")
                end = begin + at + 1 if at >= 0 else begin
                if at >= 0:
                    break
            known_by = min(KNOWN_BY, end)
            return {"bytes": end, "by": known_by, "head": _digest(f, known_by)} if end else None

    def states(self, held: dict | None = None) -> dict[str, dict]:
        """State of every file with a whole line; ``held`` keeps those of files that have not changed since."""
        out = {}
        for path, info in sorted(self.listed().items()):
            key = (info.size, info.mtime_ns)
            if held is not None and held.get(path, (None,))[0] == key:
                state = held[path][1]
            else:
                state = self.state(info)
                if held is not None:
                    held[path] = (key, state)
            if state:
                out[path] = state
        return out

    def starts_with(self, path: str, known_by: int, head: str) -> bool:
        store, _ = self.store()
        try:
            with store.open_input_file(path) as f:
                return _digest(f, known_by) == head
        except FileNotFoundError:
            return False

    def stretches(self, path: str, state: dict, first: int) -> list[Stretch]:
        return [Stretch(path, state["head"], state["by"], first, a, min(a + self.split, state["bytes"]), state["bytes"])
                for a in range(first, state["bytes"], self.split)]

    def lines(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        """A split's lines; a file that was renamed since the split was planned is found by its start. Spark reads None where there are no splits."""
        if part is None:
            return
        path = part.path
        if not self.starts_with(path, part.known_by, part.head):
            path = next((p for p, i in sorted(self.listed().items()) if i.size >= part.end and self.starts_with(p, part.known_by, part.head)), None)
            if path is None:
                raise FileNotFoundError(f"{part.path} is gone or was overwritten before it was read")
        store, _ = self.store()
        with store.open_input_file(path) as f:
            separator, fields = header(f.read_at(min(HEADER, part.end), 0))
            for at, block in _whole_lines(f, part):
                own = block.split(b"\n")[:-1]
                starts = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in own[:-1]], dtype=np.int64)]).astype(np.int64)
                own = own[: int(np.searchsorted(starts, part.stop))]
                n = len(own)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.path] * n), pa.array(starts[:n]), pa.array([separator] * n, pa.string()), pa.array([fields] * n, pa.string()),
                         pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in own], pa.string())],
                        names=["file", "byte", "separator", "fields", "line"])


def _digest(f, known_by: int) -> str:
    return hashlib.sha1(f.read_at(known_by, 0)).hexdigest() if known_by else ""


def _whole_lines(f, part: Stretch) -> Iterator[tuple[int, bytes]]:
    """(byte, whole lines) from the first line that starts in the split until one starts behind it."""
    at = part.begin
    if part.begin > part.first:  # a line that began before belongs to the split before
        pos = part.begin - 1
        while True:
            data = f.read_at(min(CHUNK, part.end - pos), pos)
            if not data:
                return
            cut = data.find(b"\n")
            pos += cut + 1 if cut >= 0 else len(data)
            if cut >= 0:
                at = pos
                break
    pos, held = at, bytearray()
    while pos < part.end and at < part.stop:
        data = f.read_at(min(CHUNK, part.end - pos), pos)
        if not data:
            return
        pos += len(data)
        since = len(held)
        held += data
        cut = held.rfind(b"\n", since) + 1
        if cut:
            yield at, bytes(held[:cut])
            at += cut
            del held[:cut]


def header(start: bytes) -> tuple[str | None, str | None]:
    """Separator and ``#fields`` line among the comment lines at a file's start; a file without field names has neither."""
    separator, fields = "\t", None
    for raw in start.split(b"\n"):
        line = raw.decode("utf-8", "replace").strip(" \t\r\x0b\x0c")
        if not line.startswith("#"):
            break
        mark, _, value = line.partition(" ")
        if mark == "#separator" and value.strip():
            code = re.match(r"\\x([0-9A-Fa-f]{2})", value.strip())
            separator = chr(int(code[1], 16)) if code else value.split()[0]
        elif line.startswith("#fields"):
            fields = line
    return (separator, fields) if fields is not None else (None, None)


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)

    def partitions(self) -> list[Stretch]:
        return [s for path, state in self.folder.states().items() for s in self.folder.stretches(path, state, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are {path: bytes read, digest of the start}; they grow with the files in the folder, not with their lines."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.held = Folder(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.folder.states(self.held)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        """What ``end`` has beyond ``start``: more of a file, the rest of one under a new name, or a new file from its first byte."""
        begins, left = {}, dict(start)
        for path, state in end.items():
            if path in left and self._goes_on(left[path], path, state):
                begins[path] = left.pop(path)["bytes"]
        for path, state in end.items():
            if path not in begins:
                old = next((p for p, was in left.items() if self._goes_on(was, path, state)), None)
                begins[path] = left.pop(old)["bytes"] if old is not None else 0
        return [s for path, state in end.items() for s in self.folder.stretches(path, state, begins[path])]

    def _goes_on(self, was: dict, path: str, now: dict) -> bool:
        if was["bytes"] > now["bytes"]:
            return False
        if was["by"] == now["by"]:
            return was["head"] == now["head"]
        return self.folder.starts_with(path, was["by"], was["head"])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Options: ``path`` (file or folder), ``glob`` for file names, ``splitBytes``.

    Files are told apart by their first 1024 bytes. Lines end with LF or CR LF; undecodable bytes are replaced; in a batch, too, a last
    line without an end is left out. Names that begin with ``_`` or ``.`` are skipped.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def read_growing(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Lines below ``path`` with file, byte, separator and fields."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream if stream else spark.read
    return reader.format(NAME).options(**options).load(path)
