"""Fields of a line at ingest: JSON keys and the named groups of one pattern, under the limits of the data model."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.validation import FIELD_NAME, FIELD_VALUE, FIELDS


_LONE = re.compile("[\ud800-\udfff]")


class _Raw(float):
    """A number that remembers its text."""

    def __new__(cls, text: str) -> _Raw:
        self = super().__new__(cls, 0.0)
        self.text = text
        return self


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_float=_Raw, parse_int=_Raw, parse_constant=_no_constant, object_pairs_hook=lambda pairs: _Pairs(pairs), strict=True)


class _Pairs(list):
    """A JSON object as its pairs, repeated keys and all."""


def _compact(value: object) -> str:
    if isinstance(value, _Raw):
        return value.text
    if isinstance(value, _Pairs):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(v)}" for k, v in value) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_compact, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def json_pairs(line: str) -> list[tuple[str, str]]:
    """The top-level pairs of the JSON object a line starts with, as text; none if it starts with anything else.

    What follows the object doesn't matter.  Numbers keep their spelling, null is the text null, nested
    values are compact JSON.
    """
    try:
        value, _ = _DECODER.raw_decode(line.lstrip(" \t\r\n"))
    except (ValueError, RecursionError):
        return []
    if not isinstance(value, _Pairs):
        return []
    return [(k, v if isinstance(v, str) else _compact(v)) for k, v in value]


def valid(text: str) -> str:
    """The text with U+FFFD for halves of surrogate pairs, which an escape can spell but UTF-8 can't."""
    return _LONE.sub("\N{REPLACEMENT CHARACTER}", text)


def cut(text: str, most: int = FIELD_VALUE) -> str:
    """At most so many bytes of UTF-8, whole characters only."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def fields(line: str | None, use_json: bool = True, pattern: re.Pattern | None = None) -> dict[str, str] | None:
    """All fields of a line, null for none; JSON keys win over groups of the same name."""
    out: dict[str, str] = {}
    found: list[tuple[str, str]] = []
    if line is not None and pattern is not None and (m := pattern.search(line)):
        found += [(k, v) for k, v in m.groupdict().items() if v is not None]
    if line is not None and use_json:
        found += json_pairs(line)
    for name, value in ((valid(n), valid(v)) for n, v in found):
        if name and len(name.encode()) <= FIELD_NAME and (name in out or len(out) < FIELDS):
            out[name] = cut(value)
    return out or None


def extracted(line: Column, use_json: bool = True, pattern: str | None = None) -> Column:
    """The fields of a text column as a map, null where there are none; the pattern needs a named group."""
    compiled = None
    if pattern is not None:
        compiled = re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern))
        if not compiled.groupindex:
            raise ValueError("the pattern has no named group")

    @F.pandas_udf("map<string,string>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: fields(x, use_json, compiled))

    return run(line)
