"""Parsed queries."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pos:
    """A place in the query text; lines and characters count from 1."""

    line: int
    column: int

    def __str__(self) -> str:
        return f"{self.line}:{self.column}"


class QueryError(ValueError):
    """What is wrong with a query, and where."""

    def __init__(self, pos: Pos | None, message: str) -> None:
        super().__init__(f"{pos}: {message}" if pos else message)
        self.pos, self.message = pos, message


@dataclass(frozen=True)
class Matcher:
    pos: Pos
    label: str
    op: str
    value: str


@dataclass(frozen=True)
class LineFilter:
    pos: Pos
    op: str  # |= != |~ !~
    text: str


@dataclass(frozen=True)
class ParserStage:
    pos: Pos
    kind: str  # json logfmt regexp
    pattern: str = ""


@dataclass(frozen=True)
class LabelFilter:
    pos: Pos
    label: str
    op: str
    value: str
    numeric: bool = False


@dataclass(frozen=True)
class Aggregation:
    pos: Pos
    func: str  # rate count_over_time bytes_over_time
    seconds: int
    by: tuple[str, ...] = ()


Stage = LineFilter | ParserStage | LabelFilter


@dataclass(frozen=True)
class Query:
    text: str = field(compare=False)
    pos: Pos
    matchers: tuple[Matcher, ...]
    stages: tuple[Stage, ...] = ()
    agg: Aggregation | None = None
