"""A streaming source of log files that grow, are rotated, truncated or replaced.

The offset of a stream holds the identity of every file and the bytes of it that are read. The
identity is the device, the inode and a checksum of the first line, so a renamed file goes on where
it was, and a new file under an old path starts at its first byte, however long it is. Only bytes
behind the offset are read, and only up to the last line break, so neither an open line nor an open
UTF-8 sequence is ever given. A long stretch of new bytes is cut into ranges that are read in parallel;
a line belongs to the range it begins in.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").load("/logs")

The path must be mounted on the driver and the executors, as other stores have no file identity.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 32 << 20  # new bytes of a file that a task reads
CHUNK = 1 << 16
HEAD = 1 << 10  # bytes of the first line that tell files apart


@dataclass(frozen=True)
class Range(InputPartition):
    """Lines of `path` that begin in the bytes from `start` to `end`; `first` begins a line, as the file does."""

    identity: str
    path: str
    first: int
    start: int
    end: int


def mounted(path: str) -> str:
    """The plain path of a `file:` path; other schemes have no file identity."""
    scheme, found, rest = path.partition(":/")
    if not found:
        return path
    if scheme != "file":
        raise ValueError(f"{path} is not on a mounted file system")
    return "/" + rest.lstrip("/")


def complete_bytes(path: str, size: int) -> int:
    """Bytes up to and with the last line break in the first `size` bytes."""
    with open(path, "rb") as file:
        end = size
        while end:
            start = max(0, end - CHUNK)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def state_of(path: str) -> tuple[str, int] | None:
    """(identity, complete bytes) of a file; None if it is gone or holds no whole line."""
    try:
        with open(path, "rb") as file:
            about = os.fstat(file.fileno())
            head = file.readline(HEAD)
        size = complete_bytes(path, about.st_size)
    except OSError:  # renamed or deleted between the listing and now: the next poll sees it under its new name
        return None
    return (f"{about.st_dev:x}-{about.st_ino:x}-{zlib.crc32(head):08x}", size) if size else None


def states(folder: str) -> dict[str, dict]:
    """identity -> path and complete bytes of every file below `folder`, or of the file `folder`."""
    paths = [folder] if os.path.isfile(folder) else sorted(os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if not f.startswith((".", "_")))
    return {found[0]: {"path": path, "bytes": found[1]} for path in paths if (found := state_of(path))}


def ranges(seen: dict[str, dict], now: dict[str, dict], size: int = RANGE) -> list[Range]:
    """New bytes of every file. A file that got shorter under the same identity starts again."""
    out = []
    for identity, state in now.items():
        was = seen.get(identity, {}).get("bytes", 0)
        first = was if was <= state["bytes"] else 0
        out += [Range(identity, state["path"], first, at, min(at + size, state["bytes"])) for at in range(first, state["bytes"], size)]
    return out


def lines(part: Range) -> Iterator[tuple[int, str]]:
    """(byte position, line); a carriage return breaks lines too, bytes that are no UTF-8 become U+FFFD."""
    path = part.path
    found = state_of(path)
    if not found or found[0] != part.identity:  # rotated since the offset was taken: look for the file by its identity
        folder = os.path.dirname(path)
        path = next((p for p in (os.path.join(folder, f) for f in sorted(os.listdir(folder))) if os.path.isfile(p) and (state_of(p) or ("",))[0] == part.identity), "")
        if not path:
            raise FileNotFoundError(f"{part.path} is no longer the file of the offset, and no file beside it is")
    with open(path, "rb") as file:
        if part.start > part.first:
            file.seek(part.start - 1)
            file.readline()
        else:
            file.seek(part.start)
        at = file.tell()
        while at < part.end:
            whole = file.readline()
            if not whole:
                return
            place = at
            for piece in whole.splitlines(keepends=True):
                yield place, piece.rstrip(b"\r\n").decode("utf-8", "replace")
                place += len(piece)
            at += len(whole)


class LogTailReader(DataSourceStreamReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": states(self.folder)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start["files"], end["files"], self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        job = os.path.basename(os.path.dirname(partition.path))
        for at, line in lines(partition):
            yield job, partition.identity, at, line


class LogTail(DataSource):
    """job_id (folder of the file), file (its identity), at (byte position of the line), line."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "job_id string, file string, at bigint, line string"

    def streamReader(self, schema) -> LogTailReader:  # noqa: ARG002
        return LogTailReader(mounted(self.options["path"]), int(self.options.get("rangeBytes", RANGE)))
