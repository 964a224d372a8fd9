"""Lines appended to log files, as a streaming data source whose offset is (file, byte position).

Spark's file source reads a path once, so a line appended later is never seen. This one takes a snapshot of the folder per micro-batch:
name, first bytes and the end of the last whole line of every file. What a batch reads is the difference of two snapshots, worked out
from them alone, so a restarted query goes on where the last one ended. A file is known by its first bytes: a renamed file goes on at its
position, a truncated or replaced one begins again. Long additions are cut into pieces and read in parallel.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 128  # bytes that tell files apart
BLOCK = 1 << 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _head(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_file(path) as file:
        return file.read(HEAD)


def _end_of_lines(store: fs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the last line feed."""
    with store.open_input_file(path) as file:
        while size > 0:
            start = max(0, size - BLOCK)
            file.seek(start)
            at = file.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return 0


def snapshot(folder: str, glob: str, since: float) -> list[dict]:
    """Files of the folder that match: name, first bytes (Latin-1 text) and end of the whole lines; gone files are left out."""
    store, root = _open(folder)
    out = []
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        name = info.base_name
        if info.type != fs.FileType.File or name.startswith((".", "_")) or not fnmatch.fnmatch(name, glob) or info.mtime_ns < since * 1e9:
            continue
        try:
            out.append({"name": name, "head": _head(store, info.path).decode("latin-1"), "end": _end_of_lines(store, info.path, info.size)})
        except FileNotFoundError:
            continue
    return sorted(out, key=lambda f: f["name"])


def additions(start: list[dict], end: list[dict]) -> list[tuple[dict, int]]:
    """(file of ``end``, first byte to read): what came in between two snapshots."""
    def goes_on(old: dict, new: dict) -> bool:
        return bool(old["head"]) and new["head"].startswith(old["head"]) and new["end"] >= old["end"]

    by_name = {f["name"]: f for f in start}
    stayed = {f["name"] for f in end if f["name"] in by_name and goes_on(by_name[f["name"]], f)}
    moved = [f for f in start if f["name"] not in stayed]
    out = []
    for file in end:
        if file["name"] in stayed:
            begin = by_name[file["name"]]["end"]
        else:
            old = max((f for f in moved if goes_on(f, file)), key=lambda f: f["end"], default=None)
            begin = old["end"] if old else 0
            if old:
                moved.remove(old)
        if begin < file["end"]:
            out.append((file, begin))
    return out


@dataclass
class Piece(InputPartition):
    """Lines that begin in [start, stop) of a file; ``first`` is where the addition begins, ``last`` where it ends."""

    name: str
    head: str
    first: int
    start: int
    stop: int
    last: int


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob, self.since = options["path"], options.get("glob", "*"), float(options.get("since", "0"))
        self.from_end = options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "latest"
        self.split = int(options.get("splitbytes", options.get("splitBytes", str(32 << 20))))

    def initialOffset(self) -> dict:
        return {"files": snapshot(self.folder, self.glob, self.since) if self.from_end else []}

    def latestOffset(self) -> dict:
        return {"files": snapshot(self.folder, self.glob, self.since)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(file["name"], file["head"], begin, at, min(at + self.split, file["end"]), file["end"])
                for file, begin in additions(start["files"], end["files"]) for at in range(begin, file["end"], self.split)] or [Piece("", "", 0, 0, 0, 0)]

    def _find(self, store: fs.FileSystem, root: str, piece: Piece) -> str:
        """The file of a piece, also where it was renamed after the snapshot."""
        want, own = piece.head.encode("latin-1"), f"{root}/{piece.name}"
        others = sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.size >= piece.last)
        for path in [own, *others]:
            if path in others and _head(store, path).startswith(want):
                return path
        raise FileNotFoundError(f"{own}: no file with these first bytes is left")

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.stop <= partition.start:
            return
        store, root = _open(self.folder)
        with store.open_input_file(self._find(store, root, partition)) as file:
            at = partition.start
            rest = b""
            if at > partition.first:  # the line that runs into this piece belongs to the one before
                at -= 1
                file.seek(at)
                while at < partition.last:
                    block = file.read(min(BLOCK, partition.last - at))
                    cut = block.find(b"\n")
                    if cut >= 0:
                        at += cut + 1
                        break
                    at += len(block)
            file.seek(at)
            lines, places, held = [], [], 0
            position = at
            while at < partition.last and position < partition.stop:
                block = file.read(min(BLOCK, partition.last - at))
                at += len(block)
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    if position >= partition.stop:
                        break
                    lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    places.append(position)
                    position += len(line) + 1
                    held += len(line)
                if held > 4 << 20:
                    yield self._batch(lines, partition.name, places)
                    lines, places, held = [], [], 0
            if lines:
                yield self._batch(lines, partition.name, places)

    @staticmethod
    def _batch(lines: list[str], name: str, places: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([name] * len(lines), pa.string()), pa.array(places, pa.int64())], ["line", "file", "position"])


class GrowingLog(DataSource):
    """``spark.readStream.format("growing_log").load(folder)``: line, file, position (byte where the line begins)."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "line string, file string, position bigint"

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLog)
