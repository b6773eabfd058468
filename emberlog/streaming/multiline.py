"""Joining multi-line records on a stream: one open record for each source, with limits and an idle flush."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_BYTES, MAX_LINES, IDLE_MS = 65536, 500, 5000
OUT = "source string, time timestamp, start long, offset long, lines int, line string"
STATE = "time timestamp, start long, offset long, lines int, line string"


def absorb(held: tuple | None, row: tuple, continues: re.Pattern) -> tuple[tuple | None, tuple | None]:
    """The record that a line completes (or None), and the one that is open after it.  Rows are (time, start, offset, lines, line)."""
    time, start, offset, _, line = row
    if held is None:
        return None, (time, start, offset, 1, line)
    together = len(held[4].encode()) + bool(held[4]) + len(line.encode())
    if not continues.search(line) or together > MAX_BYTES or held[3] + 1 > MAX_LINES:
        return held, (time, start, offset, 1, line)
    return None, (held[0], held[1], offset, held[3] + 1, f"{held[4]}\n{line}" if held[4] else line)


def joined(lines: DataFrame, continuation: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """Records of a stream of (source, time, start, offset, line).

    A line that matches `continuation` goes to the open record of its source, unless that would pass
    64 KiB or 500 lines.  A record keeps its first line's time and start and its last line's offset; it is
    flushed by the next one, or when nothing came for `idle_ms`.
    """
    pattern = re.compile(continuation)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = tuple(state.get)
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=["source", "time", "start", "offset", "lines", "line"])
            return
        held = tuple(state.get) if state.exists else None
        done = []
        rows = pd.concat(list(frames)).sort_values("start", kind="stable")
        for t, s, o, x in zip(rows["time"], rows["start"], rows["offset"], rows["line"], strict=True):
            out, held = absorb(held, (t, int(s), int(o), 1, x), pattern)
            if out is not None:
                done.append((key[0], *out))
        state.update(held)
        state.setTimeoutDuration(idle_ms)
        if done:
            yield pd.DataFrame(done, columns=["source", "time", "start", "offset", "lines", "line"])

    return lines.groupBy("source").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
