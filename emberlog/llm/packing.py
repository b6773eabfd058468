"""Packing documents into sequences by cutting-stock column generation.

Whole sequences are cut from the front of long documents.  The remainders are counted by length class
(a histogram of at most `CLASSES` numbers, whatever the corpus); the driver solves the linear program
of the cutting-stock problem over patterns of classes, new patterns being priced by a knapsack dynamic
program, and rounds the multiplicities down.  What rounding leaves, fewer documents than patterns hold,
gets patterns of its own.  Documents are ranked within their class, and a rank names its pattern, copy
and slot in closed form.  Classes are rounded up, so a pattern leaves small gaps; in lots of
`LOT` sequences the emptiest ones are taken apart to fill the gaps of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import sliced, tidied, written
from emberlog.llm.tokens import with_end, word_tokenizer

LENGTH, CLASSES, LOT = 2048, 128, 1024


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of items within the capacity (unbounded), by dynamic programming."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fit = np.flatnonzero(size <= room)
        if len(fit):
            gain = best[room - size[fit]] + value[fit]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], pick[room] = gain[k], fit[k]
    counts, room = np.zeros(len(size), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= size[pick[room]]
    return float(best[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges; no threads of a numeric library run in the driver."""
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        best = k + int(np.abs(work[k:, k]).argmax())
        work[[k, best]] = work[[best, k]]
        work[k] /= work[k, k]
        rates = work[:, k].copy()
        rates[k] = 0
        work -= np.outer(rates, work[k])
    return work[:, m:]


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and multiplicities of a basic solution of min sum(x), patterns @ x = demand, x >= 0."""
    m = len(size)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(columns)) if m else np.zeros((0, 0))
    x = (inverse * demand).sum(axis=1)
    for step in range(most if m else 0):
        duals = inverse.sum(axis=0)
        worth, pattern = knapsack(duals, size, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = (inverse * pattern).sum(axis=1)
        up = np.flatnonzero(direction > 1e-9)
        ratio = x[up] / direction[up]
        leave = up[ratio.argmin()]
        rate = max(0.0, x[leave] / direction[leave])
        x -= rate * direction
        x[leave] = rate
        columns[:, leave] = pattern
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        if step % 100 == 99:  # keep rounding errors small
            inverse = inverted(columns)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
    return columns.astype(np.int64), x


def plan(histogram: dict[int, int], classes: int = CLASSES) -> list[tuple[int, dict[int, int]]]:
    """(copies, {class: documents}) that place every document of the histogram; class c takes c of `classes` units."""
    size = np.array(sorted(c for c, n in histogram.items() if n), np.int64)
    demand = np.array([histogram[c] for c in size.tolist()], np.int64)
    columns, x = column_generation(size, demand.astype(float), classes)
    out: list[tuple[int, dict[int, int]]] = []
    left = demand.copy()
    for j in np.argsort(-x, kind="stable"):
        column = columns[:, j]
        used = column > 0
        copies = int(min(np.floor(x[j] + 1e-6), (left[used] // column[used]).min() if used.any() else 0))
        if copies > 0:
            left -= copies * column
            out.append((copies, {int(size[i]): int(column[i]) for i in np.flatnonzero(used)}))
    # the rest, first fit by falling class; it is bounded by the patterns, not by the documents
    while left.any():
        room, column = classes, {}
        for i in range(len(size) - 1, -1, -1):
            if take := int(min(left[i], room // size[i])):
                column[int(size[i])] = take
                room -= take * int(size[i])
        copies = min(int(left[np.searchsorted(size, c)]) // n for c, n in column.items())
        for c, n in column.items():
            left[np.searchsorted(size, c)] -= n * copies
        out.append((copies, column))
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: the first rank of each pattern that holds it, documents of a copy, first sequence of the pattern."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for copies, column in patterns:
        for c, n in column.items():
            firsts, each, base = out.setdefault(c, ([], [], []))
            firsts.append(used.get(c, 0))
            each.append(n)
            base.append(sequence)
            used[c] = used.get(c, 0) + copies * n
        sequence += copies
    return {c: tuple(np.array(y, np.int64) for y in x) for c, x in out.items()}


def settle(n: np.ndarray, start: np.ndarray, uid: np.ndarray, sequence: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Pieces (uid, start, length, lot sequence from 0, offset) of one lot: whole pieces in the fullest sequences, the rest cut to fill gaps.

    The last sequence, if it isn't full, is cut into powers of two.
    """
    order = np.lexsort((uid, sequence))
    n, start, uid, sequence = n[order], start[order], uid[order], sequence[order]
    names, number = np.unique(sequence, return_inverse=True)
    filled = np.bincount(number, weights=n, minlength=len(names)).astype(np.int64)
    keep = int(n.sum()) // length  # so many can be full
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(-filled, kind="stable")] = np.arange(len(names))
    place = rank[number]
    stay = place < keep
    # what stays: offsets by a running sum within its sequence
    by = np.argsort(place, kind="stable")
    n, start, uid, place, stay = n[by], start[by], uid[by], place[by], stay[by]
    kept = np.flatnonzero(stay)
    total = np.cumsum(n[kept]) - n[kept]
    opens = np.r_[True, np.diff(place[kept]) != 0] if len(kept) else np.zeros(0, bool)
    offset = total - np.maximum.accumulate(np.where(opens, total, 0)) if len(kept) else total
    have = np.bincount(place[kept], weights=n[kept], minlength=keep).astype(np.int64)[:keep]
    loose = np.flatnonzero(~stay)
    gaps = length - have
    rest = int(n[loose].sum() - gaps.sum())
    tail = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    room = np.append(gaps, tail).astype(np.int64)  # room to fill, sequence after sequence
    room_end, doc_end = np.cumsum(room), np.cumsum(n[loose])
    cuts = np.unique(np.concatenate([room_end, doc_end]))
    cuts = cuts[cuts > 0]
    begin = np.append(0, cuts[:-1]) if len(cuts) else cuts
    to = np.searchsorted(room_end, begin, side="right")
    doc = np.searchsorted(doc_end, begin, side="right")
    base = np.append(have, np.zeros(len(tail), np.int64))
    return {
        "uid": np.concatenate([uid[kept], uid[loose][doc]]),
        "start": np.concatenate([start[kept], start[loose][doc] + begin - (doc_end - n[loose])[doc]]),
        "length": np.concatenate([n[kept], cuts - begin]),
        "place": np.concatenate([place[kept], to]),
        "offset": np.concatenate([offset, base[to] + begin - (room_end - room)[to]]),
    }


PIECE = "uid long, start long, length long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, sequence_id, offset, doc_tokens, ids): the pieces of all documents, ids as binary.

    Every document is its ids and `end_id`; a null or empty text is `end_id` alone.  A sequence has
    `length` ids, or a power of two of them, so there is no padding at all.  Repeated rows are
    documents of their own; an empty table gives no piece.  Sequence ids are unique, not dense.
    """
    spark = docs.sparkSession
    unit = length // CLASSES

    @tidied

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer)
        small = encode.tokenizer.get_vocab_size() <= 1 << 16
        pid, row, full, ranks = TaskContext.get().partitionId(), 0, 0, np.zeros(CLASSES + 1, np.int64)
        for batch in sliced(batches, "text"):
            ids, n = with_end(*encode(batch.column(1)), end_id)
            ids = ids.astype("<u2" if small else "<u4")
            ends = np.append(0, np.cumsum(n)) * ids.itemsize
            body = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
            c = -(-(n % length) // unit)
            before = np.cumsum(n // length) - n // length + full
            by = np.argsort(c, kind="stable")
            within = np.arange(len(c)) - np.searchsorted(c[by], c[by])
            rank = np.empty(len(c), np.int64)
            rank[by] = within
            rank += ranks[c]
            ranks += np.bincount(c, minlength=CLASSES + 1)
            full += int((n // length).sum())
            uid = (np.int64(pid) << np.int64(33)) + np.arange(row, row + len(n))
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), batch.column(0).cast(pa.int64()), pa.array([pid] * len(n), pa.int32()), pa.array(n), pa.array(before), pa.array(c.astype(np.int32)), pa.array(rank), pa.array([ids.itemsize] * len(n), pa.int32()), body],
                names=["uid", "doc_id", "pid", "n", "full", "class", "rank", "width", "ids"],
            )
        encode.forget()

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = written(slim.mapInArrow(tokenize, "uid long, doc_id long, pid int, n long, full long, class int, rank long, width int, ids binary"), "packed")

    counts = tokens.groupBy("pid", "class").agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / length)).alias("fulls"))
    counts = written(counts, "classes")
    histogram = {r["class"]: r["n"] for r in counts.where("class > 0").groupBy("class").agg(F.sum("docs").alias("n")).collect()}
    slot = slots(plan(histogram))
    fulls = counts.agg(F.sum("fulls").alias("n")).first()["n"] or 0
    before = Window.partitionBy("class").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    class_start = counts.where("class > 0").select("pid", "class", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("class_start"))
    # one row for each input partition
    full_start = counts.groupBy("pid").agg(F.sum("fulls").alias("fulls")).select(
        "pid", F.coalesce(F.sum("fulls").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_start")
    )

    @tidied

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, rank = np.asarray(batch.column("class")), np.asarray(batch.column("rank"))
            out = np.zeros(len(c), np.int64)
            for x in np.unique(c):
                firsts, each, base = slot[int(x)]
                mine = np.flatnonzero(c == x)
                j = np.searchsorted(firsts, rank[mine], side="right") - 1
                out[mine] = base[j] + (rank[mine] - firsts[j]) // each[j]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("n"), pa.array(out)], names=["uid", "n", "sequence"])

    ranked = tokens.where("class > 0").select("uid", "pid", "class", "n", "rank").join(class_start, ["pid", "class"])
    ranked = ranked.select("uid", "n", "class", (F.col("rank") + F.col("class_start")).alias("rank"))
    placed = ranked.mapInArrow(assign, "uid long, n long, sequence long").withColumn("lot", F.floor(F.col("sequence") / LOT))

    def repair(key: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        n = lot["n"].to_numpy()
        out = settle(n % length, n - n % length, lot["uid"].to_numpy(), lot["sequence"].to_numpy(), length)
        # a lot has no more than LOT full sequences and a tail of powers of two
        place = fulls + key[0] * (LOT + 64) + out.pop("place")
        return pd.DataFrame(out | {"sequence_id": place})[["uid", "start", "length", "sequence_id", "offset"]]

    tails = placed.groupBy("lot").applyInPandas(repair, PIECE)
    lists = tails.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    whole = tokens.join(full_start, "pid").join(lists, "uid", "left").select("doc_id", "n", (F.col("full") + F.col("full_start")).alias("full"), "width", "ids", "pieces")

    @tidied

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "ids"):
            out: list[tuple] = []
            for doc, n, full, width, ids, pieces in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                at = [(k * length, length, full + k, 0) for k in range(n // length)]
                at += [(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in pieces or ()]
                out += [(doc, s, size, q, o, n, wide[s : s + size].tobytes()) for s, size, q, o in sorted(at)]
            names = ["doc_id", "start", "length", "sequence_id", "offset", "doc_tokens", "ids"]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:6]), pa.array(columns[6], pa.binary())], names=names)

    return whole.mapInArrow(cut, "doc_id long, start long, length long, sequence_id long, offset long, doc_tokens long, ids binary")


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids (little-endian, 32 bits each) instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


