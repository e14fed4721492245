"""Text files as a Spark data source that knows where each line begins: ``file, offset, line``.

Offsets are true byte offsets, whatever the split size, so ids made of them are the same each time a file
is read, in a batch or as a stream.  A line belongs to the split in which its first byte lies.  Files are
opened through ``pyarrow.fs``, so local paths and the URIs that it knows (``file:``, ``hdfs:``, ``s3:``,
``gs:``) can be read; tasks read their byte ranges in blocks and hold a block and one line.

Lines end at ``\\n``; a ``\\r`` before it goes.  Invalid UTF-8 is replaced.  Empty lines are not returned.
Files whose names begin with ``_`` or ``.`` are left out, as Spark does.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "logtide_text"
SCHEMA = "file string, offset long, line string"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.string())])
_BLOCK = 1 << 22


@dataclass
class Ranges(InputPartition):
    """A task's (file, first byte, end) ranges."""

    ranges: list


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def sizes_of(path: str) -> dict[str, int]:
    """The files that a path (a file, a folder, or either with wildcards) names, with their sizes."""
    system, inner = _system(path)
    inner = inner.rstrip("/")
    fixed = inner
    while any(c in fixed for c in "*?["):
        fixed = fixed.rsplit("/", 1)[0] if "/" in fixed else "."
    info = system.get_file_info(fixed or "/")
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(fixed or "/", recursive=True))
    wanted = inner.split("/")

    def named(p: str) -> bool:
        """Whether a path, or a folder above it, matches; a wildcard stays within one name."""
        has = p.split("/")
        return fixed == inner or len(has) >= len(wanted) and all(map(fnmatchcase, has, wanted))

    seen = lambda p: not any(x.startswith(("_", ".")) for x in p[len(fixed) :].split("/"))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and seen(f.path) and named(f.path)}


def cut(ranges: list[tuple[str, int, int]], size: int) -> list[Ranges]:
    """Byte ranges dealt into partitions of at most ``size`` bytes; small files share one."""
    out, now, room = [], [], size
    for name, start, end in ranges:
        while start < end:
            stop = min(end, start + room)
            now.append((name, start, stop))
            room -= stop - start
            start = stop
            if not room:
                out.append(Ranges(now))
                now, room = [], size
    return out + [Ranges(now)] if now else out


def lines_of(path: str, name: str, start: int, stop: int, block: int = _BLOCK):
    """Batches of the lines of a file that begin in [start, stop)."""
    system, _ = _system(path)
    with system.open_input_file(name) as f:
        at, held = max(0, start - 1), b""
        f.seek(at)
        skip = start > 0  # up to and with the line end at start - 1 or later
        while True:
            data = f.read(block)
            chunk = held + data
            if skip:
                end = chunk.find(b"\n")
                if end < 0:
                    at, held = at + len(chunk), b""
                    if not data or at >= stop:
                        return
                    continue
                at, chunk, skip = at + end + 1, chunk[end + 1 :], False
            if at >= stop:
                return
            *whole, held = chunk.split(b"\n")
            if not data and held:
                whole, held = [*whole, held], b""
            offsets, texts = [], []
            for x in whole:
                if at >= stop:
                    break
                text = x[:-1] if x.endswith(b"\r") else x
                if text:
                    offsets.append(at), texts.append(text.decode("utf-8", "replace"))
                at += len(x) + 1
            if texts:
                yield pa.record_batch([pa.array([name] * len(texts)), pa.array(offsets, pa.int64()), pa.array(texts)], schema=_ARROW)
            if not data or at >= stop:
                return


def last_end(path: str, name: str, start: int, size: int, block: int = 1 << 16) -> int:
    """The end of the last complete line between ``start`` and ``size``; ``start`` if there is none."""
    system, _ = _system(path)
    with system.open_input_file(name) as f:
        end = size
        while end > start:
            begin = max(start, end - block)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


class _Lines:
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitbytes", options.get("splitBytes", 128 << 20)))

    def read(self, partition: Ranges):
        for name, start, stop in partition.ranges:
            yield from lines_of(self.path, name, start, stop)


class _Batch(_Lines, DataSourceReader):
    """All lines, or, with the option ``after`` (a stream's offset), those that it has not read."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.after = json.loads(options.get("after") or "{}")

    def partitions(self):
        return cut([(n, int(self.after.get(n, 0)), s) for n, s in sizes_of(self.path).items()], self.size) or [Ranges([])]


class _Stream(_Lines, DataSourceStreamReader):
    """Follows files that appear or grow; a line is read once it has its end.  The offset is what was read of each
    file, so it grows with the files that lie there; files should be moved away or deleted in time."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.seen: dict[str, int] = {}

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        for name, size in sizes_of(self.path).items():
            if size > self.seen.get(name, 0):
                self.seen[name] = last_end(self.path, name, self.seen.get(name, 0), size)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict):
        return cut([(n, int(start.get(n, 0)), int(e)) for n, e in sorted(end.items()) if int(e) > int(start.get(n, 0))], self.size)


class TextSource(DataSource):
    """``spark.read.format("logtide_text")`` and ``spark.readStream.format("logtide_text")``, with the options
    ``path``, ``splitBytes`` and (batch) ``after``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Stream(self.options)
