"""Stream ids: XXH64 of a length-prefixed encoding of a label set, as a signed 64-bit number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = 2**64 - 1
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _rotated(x: int, r: int) -> int:
    return (x << r | x >> (64 - r)) & _MASK


def xxh64(data: bytes, seed: int = 0) -> int:
    """The public XXH64 function."""

    def lane(acc: int, word: int) -> int:
        return _rotated((acc + word * _P2) & _MASK, 31) * _P1 & _MASK

    at = 0
    if len(data) >= 32:
        accs = [(seed + _P1 + _P2) & _MASK, (seed + _P2) & _MASK, seed, (seed - _P1) & _MASK]
        while at + 32 <= len(data):
            for k in range(4):
                accs[k] = lane(accs[k], int.from_bytes(data[at + 8 * k : at + 8 * k + 8], "little"))
            at += 32
        h = sum(_rotated(a, r) for a, r in zip(accs, (1, 7, 12, 18), strict=True)) & _MASK
        for a in accs:
            h = ((h ^ lane(0, a)) * _P1 + _P4) & _MASK
    else:
        h = (seed + _P5) & _MASK
    h = (h + len(data)) & _MASK
    while at + 8 <= len(data):
        h = (_rotated(h ^ lane(0, int.from_bytes(data[at : at + 8], "little")), 27) * _P1 + _P4) & _MASK
        at += 8
    if at + 4 <= len(data):
        h = (_rotated(h ^ int.from_bytes(data[at : at + 4], "little") * _P1 & _MASK, 23) * _P2 + _P3) & _MASK
        at += 4
    for byte in data[at:]:
        h = _rotated(h ^ byte * _P5 & _MASK, 11) * _P1 & _MASK
    h = (h ^ h >> 33) * _P2 & _MASK
    h = (h ^ h >> 29) * _P3 & _MASK
    return h ^ h >> 32


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encoded(service: str, host: str, env: str, extra: dict[str, str]) -> bytes:
    """The canonical bytes of a label set: no two sets share them."""
    parts = [service, host, env]
    head = b"".join(_varint(len(p.encode())) + p.encode() for p in parts) + _varint(len(extra))
    pairs = sorted((k.encode(), v.encode()) for k, v in extra.items())
    return head + b"".join(_varint(len(k)) + k + _varint(len(v)) + v for k, v in pairs)


def stream_id(service: str, host: str, env: str, extra: dict[str, str] | None = None) -> int:
    h = xxh64(encoded(service, host, env, extra or {}))
    return h - 2**64 if h >= 2**63 else h


@F.pandas_udf(T.LongType())
def _ids(service: pd.Series, host: pd.Series, env: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([stream_id(s, h, e, dict(x) if x is not None else {}) for s, h, e, x in zip(service, host, env, labels, strict=True)], dtype="int64")


def with_stream_ids(rows: DataFrame) -> DataFrame:
    """Adds stream_id to rows with service, host, env and labels; each distinct label set is hashed once."""
    key = F.struct("service", "host", "env", F.array_sort(F.map_entries(F.coalesce("labels", F.expr("map()").cast("map<string,string>")))).alias("pairs"))
    keyed = rows.withColumn("_key", key)
    sets = keyed.select("_key").distinct()
    named = sets.select("_key", _ids("_key.service", "_key.host", "_key.env", F.map_from_entries("_key.pairs")).alias("stream_id"))
    return keyed.drop("stream_id").join(named, "_key").drop("_key")
