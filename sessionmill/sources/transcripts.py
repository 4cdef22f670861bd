"""Transcript files: a batch scan, and a streaming source for files that grow in place."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def scan(spark: SparkSession, root: str, pattern: str = "*.jsonl", oldest_first: bool = False) -> DataFrame:
    """(line, path, mtime) of every file below root whose name fits the pattern; a root that isn't there has no lines."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "line string, path string, mtime timestamp")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    found = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))
    return found.orderBy("mtime", "path") if oldest_first else found


#: A file's growth is read in pieces of so many bytes.
PIECE = 64 << 20


class _Piece(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class _Reader(DataSourceStreamReader):
    """Offsets are bytes by path. Only whole lines are handed out; a file that has shrunk starts again at 0. Files are listed and
    read through Arrow's file systems, so the root may be a local path or the URI of a shared store."""

    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = pa_fs.FileSystem.from_uri(self.root)
        listed = files.get_file_info(pa_fs.FileSelector(root, allow_not_found=True, recursive=True))
        found = {f.path: _last_line_end(files, f.path, f.size) for f in listed if f.is_file and f.base_name.endswith(self.suffix)}
        return {"at": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = (json.loads(o.get("at", "{}")) for o in (start, end))
        pieces = []
        for path, size in sorted(after.items()):
            at = before.get(path, 0)
            first = 0 if size < at else at
            pieces += [_Piece(path, first, s, min(size, s + PIECE)) for s in range(first, size, PIECE) if size != at]
        return pieces

    def read(self, partition: _Piece) -> Iterator[tuple]:
        """The lines that start in the piece."""
        files, _ = pa_fs.FileSystem.from_uri(self.root)
        with files.open_input_file(partition.path) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            at = partition.start
            if at > partition.first:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(at)
            while at < partition.end and (line := f.readline()):
                yield line.decode("utf-8", "replace").rstrip("\n"), partition.path, at
                at += len(line)


class _Bounded(_Reader):
    """Offsets are numbers of records in a folder; a record holds the files that have changed, and so many bytes of them at most.

    A file is known by size and time of change as last seen, so a poll over unchanged files opens none. Files are admitted the longest
    unchanged first, up to ``most`` bytes a record, cut at line ends (a longer line goes whole); the rest waits for the next record.
    Records are written before their number is handed out and never change, so a batch that runs again reads the same bytes. The
    driver holds three numbers a file. A new query over a folder that has records goes through them one by one.
    """

    SNAPSHOT = 64

    def __init__(self, root: str, suffix: str, folder: str, most: int):
        super().__init__(root, suffix)
        self.folder, self.most = folder, most
        self.at: int | None = None  # the last record handed out; None in a query that goes on
        self.number, self.seen = self._load()

    def _path(self, name: str):
        files, folder = pa_fs.FileSystem.from_uri(self.folder)
        return files, f"{folder}/{name}"

    def _names(self) -> list[str]:
        files, folder = self._path("")
        return sorted(f.base_name for f in files.get_file_info(pa_fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".json"))

    def _open(self, name: str) -> dict:
        files, path = self._path(name)
        with files.open_input_file(path) as f:
            return json.loads(f.read())

    def _put(self, name: str, value: dict) -> None:
        files, path = self._path(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{path}.part") as f:
            f.write(json.dumps(value).encode())
        files.move(f"{path}.part", path)

    def _load(self) -> tuple[int, dict[str, list[int]]]:
        """Number of the last record and what is known of each file: size, time of change, bytes consumed."""
        names = self._names()
        whole = [n for n in names if n.startswith("all-")]
        seen = self._open(whole[-1]) if whole else {}
        number = int(whole[-1][4:-5]) if whole else 0
        for name in names:
            if not name.startswith("all-") and int(name[:-5]) > number:
                self._apply(seen, self._open(name))
        return max([number, *(int(n[:-5]) for n in names if not n.startswith("all-"))]), seen

    @staticmethod
    def _apply(seen: dict, record: dict) -> None:
        for path, (_, to, size, time) in record.items():
            seen[path] = [size, time, to]

    def initialOffset(self) -> dict:
        self.at = 0
        return {"record": 0}

    def latestOffset(self) -> dict:
        if self.at is not None and self.at < self.number:
            self.at += 1
            return {"record": self.at}
        record = self.poll()
        if record:
            self._put(f"{self.number + 1:012d}.json", record)
            self._apply(self.seen, record)
            self.number += 1
            if self.number % self.SNAPSHOT == 0:
                self._put(f"all-{self.number:012d}.json", self.seen)
        self.at = self.number
        return {"record": self.number}

    def poll(self) -> dict[str, list[int]]:
        """path -> from, to, size and time of change as seen, of files that have changed, up to ``most`` bytes."""
        files, root = pa_fs.FileSystem.from_uri(self.root)
        listed = files.get_file_info(pa_fs.FileSelector(root, allow_not_found=True, recursive=True))
        mine = [(f.mtime_ns or 0, f.path, f.size) for f in listed if f.is_file and f.base_name.endswith(self.suffix)]
        record, left = {}, self.most
        for time, path, size in sorted(m for m in mine if self.seen.get(m[1], [None, None])[:2] != [m[2], m[0]]):
            consumed = self.seen.get(path, [0, 0, 0])[2]
            first = consumed if size >= consumed else 0
            if left <= 0:
                break
            end = size if size - first <= left else _line_end_by(files, path, first, first + left, size)
            if end - first > left and left < self.most:
                break  # a line longer than the limit is a record of its own
            to = max(first, _last_line_end(files, path, end)) if end == size else end
            record[path] = [first, to, size if end == size else -1, time]
            left -= to - first
        return record

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces = []
        for number in range(start.get("record", 0) + 1, end.get("record", 0) + 1):
            for path, (first, to, _, _) in sorted(self._open(f"{number:012d}.json").items()):
                pieces += [_Piece(path, first, s, min(to, s + PIECE)) for s in range(first, to, PIECE)]
        return pieces


def _line_end_by(files: pa_fs.FileSystem, path: str, first: int, limit: int, size: int, step: int = 1 << 16) -> int:
    """The last end of a line behind first and up to limit, or the next one if there is none; size if there is none at all."""
    with files.open_input_file(path) as f:
        at = limit
        while at > first:
            start = max(first, at - step)
            f.seek(start)
            place = f.read(at - start).rfind(b"\n")
            if place >= 0:
                return start + place + 1
            at = start
        f.seek(limit)
        at = limit
        while at < size:
            read = f.read(min(step, size - at))
            place = read.find(b"\n")
            if place >= 0:
                return at + place + 1
            at += len(read)
    return size


def _last_line_end(files: pa_fs.FileSystem, path: str, size: int, step: int = 1 << 16) -> int:
    """Bytes up to and with the last line break."""
    with files.open_input_file(path) as f:
        at = size
        while at > 0:
            start = max(0, at - step)
            f.seek(start)
            place = f.read(at - start).rfind(b"\n")
            if place >= 0:
                return start + place + 1
            at = start
    return 0


class TranscriptSource(DataSource):
    """``spark.readStream.format("transcripts").option("path", root)``: (line, path, byte_offset). ``suffix`` (.jsonl) tells the files.

    With ``offsets``, a folder of the query's own, a batch has at most ``maxBytes`` bytes (1 GiB), and files that haven't changed are
    not opened; without it all that is new is one batch.
    """

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "line string, path string, byte_offset bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        root, suffix, folder = self.options["path"], self.options.get("suffix", ".jsonl"), self.options.get("offsets")
        return _Bounded(root, suffix, folder, int(self.options.get("maxBytes", 1 << 30))) if folder else _Reader(root, suffix)
