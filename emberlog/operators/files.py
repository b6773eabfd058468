"""Replacing some files of a table by others without losing any, whenever the process stops."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folder of unfinished replacements in a table; Spark doesn't read names that begin with an underscore.
AT = "_replaced"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file; it has its name only when it is whole."""
    fs, p = _fs(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(text.encode())
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def parts(spark: SparkSession, folder: str) -> dict[str, int]:
    """The data files in a folder, and their bytes."""
    fs, p = _fs(spark, folder)
    found = fs.listStatus(p) if fs.exists(p) else []
    return {f.getPath().getName(): f.getLen() for f in found if f.getPath().getName().startswith("part-")}


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in (fs.listStatus(p) if fs.exists(p) else []) if f.isDirectory())


def replaced(spark: SparkSession, table: str, folder: str, make: Callable[[DataFrame], DataFrame], stop: Callable[[str], None] = lambda _: None) -> None:
    """Puts `make` of the rows of a folder (a partition, or "" for the table) in place of the files that it has now.

    The new files are written beside the table; then a list of the old ones says that they are whole.
    From there on `recover` can finish: new files move in, old ones go.  Files that others add meanwhile
    stay.  A query that runs between the two steps sees rows twice, never too few.  `stop` is told of each step (for tests).
    """
    old = sorted(parts(spark, f"{table}/{folder}"))
    if not old:
        return
    at = f"{table}/{AT}/{folder or 'table'}"
    delete(spark, at)
    rows = spark.read.parquet(*(f"{table}/{folder}/{f}" for f in old))
    make(rows).write.option("compression", "zstd").parquet(f"{at}/new")
    stop("written")
    put_text(spark, f"{at}/old.json", json.dumps({"folder": folder, "files": old}))
    stop("listed")
    recover(spark, table, stop)


def recover(spark: SparkSession, table: str, stop: Callable[[str], None] = lambda _: None) -> None:
    """Finishes the replacements whose new files are whole, and forgets the others."""
    jvm = spark.sparkContext._jvm
    for name in folders(spark, f"{table}/{AT}"):
        at = f"{table}/{AT}/{name}"
        listed = get_text(spark, f"{at}/old.json")
        if listed is not None:
            plan = json.loads(listed)
            fs, home = _fs(spark, f"{table}/{plan['folder']}")
            fs.mkdirs(home)
            for file in sorted(parts(spark, f"{at}/new")):
                fs.rename(jvm.org.apache.hadoop.fs.Path(f"{at}/new/{file}"), jvm.org.apache.hadoop.fs.Path(home, file))
                stop("moved")
            for file in plan["files"]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(home, file), False)
                stop("deleted")
        delete(spark, at)
