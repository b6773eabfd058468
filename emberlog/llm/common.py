"""Helpers that several operators share: Arrow slicing, stable ids, checkpoints, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds the temporaries of a Python worker.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where none is set a temporary folder serves, but only if driver and executors are one process; on a
    cluster each machine would write to its own disk, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="emberlog-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders made so far; `swept` takes out those that it deletes.
_made: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders that were made inside, when what was made of them is written."""
    before = len(_made)
    yield
    for path in _made[before:]:
        delete(spark, path)
    del _made[before:]


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Seconds between two times at which executors give memory back.
REST_S = 2.0
_rested = [0.0]


def rest(spark: SparkSession) -> None:
    """Lets the executors' heaps shrink between jobs: what one stage needed there, the Python workers of the next one need beside it."""
    if time.monotonic() - _rested[0] < REST_S:
        return
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()
    _rested[0] = time.monotonic()


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    rest(spark)
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and lets Spark drop the shuffles of finished jobs."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            delete(spark, folder)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys that are met by broadcast at most.
HEAVY = 1000


def unskewed(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with `keys`: one row for each value of `on` with the number `c` of rows that hold it.

    A value that more than one in HEAVY rows hold is met by broadcast, so its rows stay where they are;
    there can't be more than HEAVY such values, whatever the size.  The others are met as Spark sees fit.
    `c` goes.  `how` is inner or left_semi; both tables are read again, so a costly one should be a written one.
    """
    most = max(rows.count() // HEAVY, 1)
    rest = keys.where(F.col("c") <= most).drop("c")
    found = keys.where(F.col("c") > most).drop("c").collect()  # HEAVY rows at most
    if not found:
        return rows.join(rest, on, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, rest.schema))
    return rows.join(hot, on, how).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on, how))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed so that no column has one of them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and its offsets (one more than rows)."""
    column = column.cast(pa.large_binary()) if column.type not in (pa.large_binary(), pa.large_string()) else column
    n = len(column)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidied(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step, after which a Python worker gives memory back: idle workers stay while later stages run."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between ASCII white space: their numbers among the distinct words, these, and the words of each text."""
    texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type) and len(texts) and np.frombuffer(texts.buffers()[1], np.int64, 1, 8 * texts.offset)[0]:
        texts = pa.array(texts.to_pylist(), pa.large_string())  # Arrow lowers such arrays wrongly if their bytes don't begin at 0
    return coded(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))


def coded(lists: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The same of lists of words; empty words are left out."""
    words = lists.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    number = np.asarray(words.indices).astype(np.int64)
    n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    if "" in distinct:  # what separates words parts off an empty one at an end of a text
        keep = number != distinct.index("")
        n = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n)).astype(np.int64)
        number = number[keep]
    return number, distinct, n


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each part hold about `most` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.diff(buffers(text.fill_null("" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b""))[1])
        at, total = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def lots(batches: Iterator[pa.RecordBatch], keys: list[str], weight: str | None = None, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by the keys, lots of about `most` rows (or bytes of the column `weight`) that hold whole groups."""

    def of(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(k))[row].as_py() for k in keys)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches if weight is None else sliced(batches, weight, max(1, most // 4)):
        if not batch.num_rows:
            continue
        if held and size >= most and of(batch, batch.num_rows - 1) != (last := of(held[-1], held[-1].num_rows - 1)):
            low, high = 0, batch.num_rows  # where the last group of what is held ends
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if of(batch, middle) == last else (low, middle)
            if low:
                held.append(batch.slice(0, low))
                batch = batch.slice(low)
            yield joined(held)
            held, size = [], 0
        held.append(batch)
        size += batch.num_rows if weight is None else batch.column(batch.schema.get_field_index(weight)).nbytes
    if held:
        yield joined(held)


def opens_of(*columns: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges that one task unites; more are contracted by joins until so few are left.
UNITED = 1 << 16


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all ends of few edges."""
    root: dict[int, int] = {}

    def of(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = of(u), of(v)
            root[max(p, q)] = min(p, q)
    nodes = list(root)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(list(map(of, part)), pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches, itself included.

    Each round hooks every node to its smallest neighbour, halves the chains of parents until they are
    stars, and contracts the graph to the star centres.  All steps are joins and minima, which combine
    before the shuffle, so a node with very many links costs no task more than others.  Rounds are
    written to the shared folder; their number grows with the logarithm of the nodes.  When `UNITED` edges or
    fewer are left between the centres, one task finishes.
    """
    # ends as (u, v) with u > v; repeats go with the first round, as few edges need no shuffle
    todo = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "edges")
    labels: DataFrame | None = None

    def contracted(stars: DataFrame) -> DataFrame:
        """The components so far, by those of their centres."""
        if labels is None:
            return stars
        top = stars.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        return written(labels.join(top, "component", "left").select("node", F.coalesce("higher", "component").alias("component")), "labels")

    while todo.count() > UNITED:
        both = todo.select("u", "v").union(todo.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent"))
        parent = written(parent, "parents")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = parent.join(up, "parent", "left").select("node", "parent", F.coalesce("grand", "parent").alias("grand"))
            jumped = written(jumped, "parents")
            done = jumped.where("grand <> parent").isEmpty()
            parent = jumped.select("node", F.col("grand").alias("parent"))
            if done:
                break
        labels = contracted(parent.select("node", F.col("parent").alias("component")))
        left = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        todo = todo.join(left, "u").join(right, "v").where("pu <> pv")
        todo = written(todo.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
    return contracted(written(todo.coalesce(1).mapInArrow(_united, "node long, component long"), "labels"))
