"""Fields of a message at query time, as expressions: each takes a key and gives a text column, null where it is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.plans.regexes import translate

Extractor = Callable[[str], Column]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used: as the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def from_fields(fields: Column) -> Extractor:
    """The stored fields."""
    return lambda name: F.element_at(fields, F.lit(name))


def from_json(message: Column) -> Extractor:
    """Top-level keys of a message that is one JSON object and nothing else; a JSON null is missing."""

    def extract(name: str) -> Column:
        # as the elements of an array: a message with anything behind the object has several, or none that can be read
        kind = T.ArrayType(T.StructType([T.StructField(name, T.StringType())]))
        parsed = F.from_json(F.concat(F.lit("["), message, F.lit("]")), kind)
        return F.when(F.ltrim(message).startswith("{"), bound(parsed, lambda x: F.when(F.size(x) == 1, x[0][name])))

    return extract


def from_logfmt(message: Column) -> Extractor:
    """The first key=value or key="a value" behind white space or the start; quotes around the value go."""

    def extract(name: str) -> Column:
        # null if nothing matches, in one pass; a match has its key at least
        pair = F.regexp_substr(message, F.lit(f'(?:^|\\s){name}=("[^"\\s]*\\s[^"]*"|\\S*)'))
        value = bound(pair, lambda x: F.btrim(F.substring(x, F.instr(x, "=") + 1, F.length(x)), F.lit('"')))
        return F.when(F.contains(message, F.lit(f"{name}=")), value)

    return extract


def from_regexp(message: Column, pattern: str) -> Extractor:
    """Named groups of the first match anywhere; KeyError for a name that is no group."""
    regex = translate(pattern)

    def extract(name: str) -> Column:
        group = regex.groups[name]
        return F.when(message.rlike(regex.search()), F.regexp_extract(message, regex.search(), group))

    return extract


def compared(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, ">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}[op]


def number_compared(text: Column, op: str, number: str) -> Column:
    """Text compared as an exact number; null, so never kept, where it isn't one.

    Numbers outside 20 digits before and 18 behind the point compare as doubles.
    """
    decimal = T.DecimalType(38, 18)
    wanted = F.lit(number).try_cast(decimal)

    def judged(value: Column) -> Column:
        rough = compared(value.double, op, F.lit(number).try_cast("double"))
        tiny = (value.exact == 0) & (value.double != 0)
        return F.when(value.exact.isNull() | wanted.isNull() | tiny, rough).otherwise(compared(value.exact, op, wanted))

    def read(value: Column) -> Column:
        trimmed = F.when(value.rlike(_NUMBER), F.trim(value))
        return bound(F.struct(trimmed.try_cast(decimal).alias("exact"), trimmed.try_cast("double").alias("double")), judged)

    return bound(text, read)


def hex_id(value: Column) -> Column:
    """Trace and span ids as lower-case hex."""
    return F.lower(F.hex(value))


def all_labels(service: Column, host: Column, env: Column, labels: Column) -> Column:
    """Extra and promoted labels in one map."""
    own = F.create_map(F.lit("service"), service, F.lit("host"), host, F.lit("env"), env)
    return F.map_concat(F.map_filter(labels, lambda k, _: ~k.isin("service", "host", "env")), own)


def sorted_json(labels: Column) -> Column:
    """A map as JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))
