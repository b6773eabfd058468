"""Following text files that grow, are rotated or truncated, as a streaming data source.

    spark.dataSource.register(FollowSource)
    spark.readStream.format("follow").option("path", "/var/log/app/*.log*").load()

A position is a byte offset for each file.  A file is known by its inode and the hash of its first line,
not by its name: one that is renamed goes on where it was, a name that stands for another file begins
anew, and so does a file that was truncated: it has another first line or is shorter than its
position.  (One that is written anew with the same first line and beyond its old position between two
looks can't be told apart.)  Positions live in Spark's checkpoint.  Only whole lines are taken: what
follows the last line feed waits, unless it is longer than a record may be.  A batch takes about `most`
bytes of each file and reads them in pieces, one task each; lines are numbered by their offset and have
the time at which their file was last written as the batch was planned, so another attempt gives the same rows.
"""

from __future__ import annotations

import glob
import hashlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from emberlog.functions.validation import MESSAGE

SCHEMA = "source string, file string, time timestamp, start long, offset long, line string"
#: Bytes of a first line, of one piece that a task reads, and of a file in one batch.
HEAD, PIECE, MOST = 256, 8 << 20, 256 << 20
#: How long a file that vanished is remembered.
FORGET_MS = 3_600_000


def known_as(path: str) -> str | None:
    """Device, inode and the hash of the first line; None while that isn't whole."""
    with open(path, "rb") as f:
        state = os.fstat(f.fileno())
        line = f.readline(HEAD)
    whole = line.endswith(b"\n") or len(line) == HEAD
    return f"{state.st_dev}:{state.st_ino}:{hashlib.sha256(line).hexdigest()[:16]}" if whole else None


def last_line_end(path: str, begin: int, end: int) -> int:
    """Behind the last line feed in bytes begin to end; `end` if the rest is longer than a record may be; else begin."""
    at = end
    with open(path, "rb") as f:
        while at > begin:
            low = max(begin, at - (64 << 10))
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                line_end = low + found + 1
                return end if end - line_end > MESSAGE else line_end
            at = low
    return end if end - begin > MESSAGE else begin


def next_line(path: str, at: int, end: int) -> int:
    """The first line start at or behind `at`."""
    with open(path, "rb") as f:
        f.seek(at - 1)
        while at - 1 < end:
            part = f.read(64 << 10)
            if not part:
                return end
            if (found := part.find(b"\n")) >= 0:
                return min(end, at + found)
            at += len(part)
    return end


@dataclass
class Piece(InputPartition):
    """Lines that begin in bytes begin to end of a file; `stop` is where the batch ends."""

    source: str
    file: str
    begin: int
    end: int
    stop: int
    first: int
    time: int


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pattern, self.most = options["path"], int(options.get("most", MOST))
        self.last: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """By file: its path, where its last whole line ends, and when it was written (milliseconds)."""
        now = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                key, state = known_as(path), os.stat(path)
                if key is None:
                    continue
                before = self.last.get(key, {"at": 0})["at"]
                begin = before if before <= state.st_size else 0
                end = min(state.st_size, begin + self.most) if self.last else state.st_size
                at = last_line_end(path, begin, end)
                now[key] = {"path": path, "at": at, "time": int(state.st_mtime * 1000)} if at != before else self.last[key] | {"path": path}
            except (FileNotFoundError, KeyError):  # renamed just now, or nothing whole in it yet
                continue
        # one that vanished may only be on its way to another name
        gone = {k: v for k, v in self.last.items() if k not in now and time.time() * 1000 - v["time"] < FORGET_MS}
        self.last = now | gone
        return dict(self.last)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.last = self.last or dict(end)  # after a restart
        out = []
        for key, now in sorted(end.items()):
            before = start.get(key, {"at": 0})["at"]
            begin = before if before <= now["at"] else 0
            out += [Piece(now["path"], key, at, min(at + PIECE, now["at"]), now["at"], begin, now["time"]) for at in range(begin, now["at"], PIECE)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        path = self._where(piece)
        if path is None:
            return
        written = datetime.fromtimestamp(piece.time / 1000, UTC)
        at = piece.begin if piece.begin == piece.first else next_line(path, piece.begin, piece.stop)
        with open(path, "rb") as f:
            f.seek(at)
            while at < piece.end:
                raw = f.readline(piece.stop - at)
                if not raw:
                    return
                line = raw.removesuffix(b"\n").removesuffix(b"\r")[:MESSAGE]
                # a cut inside a character takes the whole character away
                text = line.decode("utf-8", "ignore" if len(raw) > MESSAGE else "replace")
                yield piece.source, piece.file, written, at, at + len(raw), text
                at += len(raw)

    def _where(self, piece: Piece) -> str | None:
        """The file's path now; it may have been renamed since."""
        for path in [piece.source, *sorted(glob.glob(self.pattern))]:
            try:
                if known_as(path) == piece.file:
                    return path
            except FileNotFoundError:
                continue
        return None


class FollowSource(DataSource):
    """Options: path (a pattern of local or mounted files) and most (bytes of a file in a batch)."""

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> FollowReader:
        return FollowReader(dict(self.options))
