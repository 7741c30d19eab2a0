"""Growing log files as a streaming source: whole blocks between bytes of each file.

A file is one source.  An offset holds, for each file, the byte up to which
whole blocks have been read: the last marker's place, since what follows it
may still grow.  Nothing of an unfinished block is kept in between: it is read
again, from its marker on, once the next marker is there.  A file that is
replaced or gets shorter is read from its start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Fixed value of the log's format.
MARKER = b"[UnityCrossThreadLogger]"
#: Bytes that are looked through at a time, of a partition's share, and of a file's beginning that tells it from another.
STEP, SHARE, HEAD = 1 << 16, 8 << 20, 256


def last_marker(file, size: int, marker: bytes = MARKER) -> int:
    """The place of the last marker before ``size``, looked for from the end; -1 if there is none."""
    end = size
    while end > 0:
        start = max(0, end - STEP)
        found = file.read_at(min(size, end + len(marker) - 1) - start, start).rfind(marker)
        if found >= 0:
            return start + found
        end = start
    return -1


def next_marker(file, at: int, size: int, marker: bytes = MARKER) -> int:
    """The place of the first marker from ``at`` on, ``size`` if there is none."""
    while at < size:
        found = file.read_at(min(STEP + len(marker) - 1, size - at), at).find(marker)
        if found >= 0:
            return at + found
        at += STEP
    return size


class Shares(InputPartition):
    """(file, first byte, byte before which blocks begin, end of what may be read) of a task."""

    def __init__(self, shares: list[tuple[str, int, int, int]]):
        self.shares = shares


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".log")
        self.closed = str(options.get("closed", "false")).lower() == "true"
        self.most, self.share = int(options.get("maxbytes", 0)), int(options.get("share", SHARE))
        #: What is known of each file at its size and time; what the last batch ended with, if this reader has seen it.
        self.seen: dict[str, tuple] = {}
        self.at: dict | None = None

    def _files(self) -> tuple[fs.FileSystem, list]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return system, [i for i in found if i.type == fs.FileType.File and i.base_name.endswith(self.suffix) and not i.base_name.startswith((".", "_"))]

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def _end(self, system: fs.FileSystem, info) -> tuple[int, int]:
        """(what the file begins with, where its last whole block ends); 0 while no block is whole."""
        with system.open_input_file(info.path) as file:
            end = info.size if self.closed else last_marker(file, info.size)
            first = next_marker(file, 0, info.size)
            # Up to the second marker a file doesn't change any more.
            second = next_marker(file, first + len(MARKER), info.size)
            if end <= first:
                return 0, 0
            return zlib.crc32(file.read_at(min(second, HEAD), 0)), end

    def latestOffset(self) -> dict:
        system, files = self._files()
        out = {}
        for info in files:
            key = (info.size, info.mtime_ns)
            if self.seen.get(info.path, (None,))[0] != key:
                self.seen[info.path] = (key, self._end(system, info))
            head, end = self.seen[info.path][1]
            if end:
                out[info.base_name] = [head, end]
        self.seen = {i.path: self.seen[i.path] for i in files}
        return self._bounded(system, {i.base_name: i for i in files}, out) if self.most and self.at is not None else out

    def _bounded(self, system: fs.FileSystem, files: dict, latest: dict) -> dict:
        """``latest``, but of every file so many bytes more than the last batch at most, up to a marker; a longer block goes whole."""
        out = {}
        for name, (head, end) in latest.items():
            start = self._start(self.at, name, head, end)
            if end - start > self.most:
                with system.open_input_file(files[name].path) as file:
                    end = min(end, next_marker(file, start + self.most, files[name].size))
            out[name] = [head, end]
        return out

    @staticmethod
    def _start(offset: dict, name: str, head: int, end: int) -> int:
        before = offset.get(name)
        return before[1] if before and before[0] == head and before[1] <= end else 0

    def partitions(self, start: dict, end: dict) -> list[Shares]:
        """Files' new bytes in shares: a large stretch is cut, a block belongs to the share that its marker is in; small ones go together."""
        self.at = end
        _, root = fs.FileSystem.from_uri(self.path)
        out, held, size = [], [], 0
        for name in sorted(end):
            head, until = end[name]
            first = self._start(start, name, head, until)
            for at in range(first, until, self.share):
                stop = min(at + self.share, until)
                held.append((f"{root}/{name}", at, stop, until))
                size += stop - at
                if size >= self.share:
                    out.append(Shares(held))
                    held, size = [], 0
        return [*out, Shares(held)] if held or not out else out

    def commit(self, end: dict) -> None:
        self.at = end

    def read(self, partition: Shares) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path, at, stop, until in partition.shares:
            name = path.rsplit("/", 1)[-1].removesuffix(self.suffix)
            with system.open_input_file(path) as file:
                begin = next_marker(file, at, until)
                while begin < stop:
                    end = next_marker(file, begin + len(MARKER), until)
                    yield name, begin, file.read_at(end - begin - len(MARKER), begin + len(MARKER)).decode("utf-8", "replace")
                    begin = end


class LogTail(DataSource):
    """``spark.readStream.format("log_tail")``: (source, block, text), a row a block; ``block`` is the byte of its marker.

    Options: ``path`` (a folder that the driver and all executors reach),
    ``suffix`` (of the files, ``.log``), ``closed`` (``true``: files grow no
    more, so the last block is whole), ``maxbytes`` (of a file in a batch; the
    first batch after a restart takes all that there is) and ``share`` (bytes
    of a task).
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "source string, block long, text string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, path: str, **options) -> DataFrame:
    """Blocks of the log files in ``path`` as they grow; see ``LogTail``."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(path=path, **options).load()
