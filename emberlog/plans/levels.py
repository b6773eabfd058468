"""Severity levels: names, aliases and their numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical names in the order of severity; a level is its index.
NAMES = ("unspecified", "trace", "debug", "info", "warn", "error", "fatal")
#: Accepted spellings of each level.
SPELLINGS = {
    "unspecified": ("unspecified",),
    "trace": ("trace", "trc", "verbose"),
    "debug": ("debug", "dbg"),
    "info": ("info", "inf", "notice"),
    "warn": ("warn", "wrn", "warning"),
    "error": ("error", "err", "eror"),
    "fatal": ("fatal", "critical", "crit", "panic", "emergency", "alert"),
}
NUMBERS = {spelling: NAMES.index(name) for name, spellings in SPELLINGS.items() for spelling in spellings}


def number(text: str) -> int | None:
    """The level of a name or alias in any case, None for others."""
    return NUMBERS.get(text.strip().lower())


def number_column(text: Column) -> Column:
    """As `number`, unspecified for null and unknown spellings."""
    table = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(F.regexp_replace(text, r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$", ""))), F.lit(0)).cast("short")


def name_column(level: Column) -> Column:
    """The canonical name, null outside the range."""
    return F.get(F.array(*map(F.lit, NAMES)), level.cast("int"))
