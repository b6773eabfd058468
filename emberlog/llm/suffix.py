"""Suffix-array removal of repeated byte strings.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.  The suffix array
of the whole corpus would hold every position; here it is cut into parts that can be sorted apart:

1. *Anchors.*  Every window of `length` bytes names the position of its smallest q-gram hash.  Equal
   windows name the same q-gram at the same place, so windows that follow each other with one anchor
   form a run, and windows can only be equal if their runs have equal anchor keys.  Each window
   belongs to one run; a run is one small row.
2. *Copies.*  Runs with the same key and the same whole content cover each other: no sorting is
   needed, and copies of a document, however many, cost a count.
3. *Suffix sort.*  Runs that share a key with different content are fetched as bytes, one for each
   content, and their suffixes are sorted by bucket-pointer refinement (`bucket_pointers`) to depth
   `length`: neighbours of one bucket are equal windows.
4. *Hot keys.*  A key with more than `LARGE_KEY` contents (a passage in very many documents, each time
   between other words) is dealt by the content that a block of windows shares, so that no task holds
   one key.  Blocks that are all alike are counted; up to `LARGE_KEY` others are sorted as in step 3;
   beyond that the windows of a block are counted by key, place and hash, and no suffix is sorted.

All windows of all documents are judged at any size.  Where equality is taken from hashes (whole runs,
blocks and the windows of step 4), keys and hashes hold 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import buffers, lots, mix64, opens_of, ranges, release, sliced, tidied, unskewed, unused, written

LENGTH, Q = 200, 32
#: A key with more contents than this is dealt by blocks of windows, and a block with more rows by windows.
LARGE_KEY = 256
#: Windows of a block; blocks lie alike to the anchor.
BLOCK = 16
#: Bytes whose suffixes are sorted at once.
SORT_BYTES = 1 << 20
_POS = np.uint64((1 << 22) - 1)
_CHUNK = 1 << 19
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, widths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """64-bit hashes of all grams of the widths (powers of two) by doubling; one entry for each start."""
    out, h, width = {}, _BYTE[data], 1
    while width <= max(widths):
        if width in widths:
            out[width] = h
        if len(h) <= width:
            break
        left = h[:-width] * np.uint64(0x9FB21C651E98DF25 + 2 * width)
        left ^= left >> np.uint64(29)
        left += h[width:]
        left *= np.uint64(0xD6E8FEB86659FD93)
        left ^= left >> np.uint64(31)
        h, width = left, width * 2
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])


def _fits(length: int, q: int = Q) -> None:
    if not 128 <= length <= 1000 + q:
        raise ValueError("a repeated string has 128 to 1000 bytes")


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """Runs of the documents in one buffer: document row, first window, windows, anchor - first, key, content hash.

    Windows start at bytes of their document; the buffer is worked off in chunks that overlap by
    `length` - 1 bytes, so a document of any size takes bounded memory.  Cutting a run where a chunk
    ends would depend on the place, so runs are joined again over such cuts.
    """
    found: list[tuple[np.ndarray, ...]] = []
    total = len(data)
    for begin in range(0, max(1, total - length + 1), _CHUNK):
        # a run spans at most length - q + 1 windows; look that far back and ahead to see runs whole
        lo, hi = max(0, begin - length), min(total, begin + _CHUNK + 2 * length)
        part = data[lo:hi]
        if len(part) < length:
            continue
        hashes = gram_hashes(part, (q, 128))
        packed = (hashes[q] & ~_POS) | np.arange(len(hashes[q]), dtype=np.uint64)
        least = sliding_min(packed, length - q + 1)
        starts = np.arange(len(least), dtype=np.int64) + lo
        doc = np.searchsorted(offsets, starts, side="right") - 1
        inside = starts + length <= offsets[doc + 1]
        new = np.empty(len(least), bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        if not len(first):
            continue
        turn = np.flatnonzero(new | ~inside)
        turn = np.append(turn, len(least))
        end = turn[np.searchsorted(turn, first, side="right")]
        own = (starts[first] >= begin) & (starts[first] < begin + _CHUNK)
        if lo and not new[0]:
            own[0] = False
        first, end = first[own], end[own]
        if not len(first):
            continue
        anchor = (least[first] & _POS).astype(np.int64)
        span = end - first + length - 1
        g = hashes[128]
        content = np.zeros(len(first), np.uint64)
        blocks = (2 * length + 126) // 128 + 1  # 128-grams that cover the longest run
        for k in range(blocks):
            content += mix64(g[first + (span - 128) * k // (blocks - 1)] ^ np.uint64(k + 1)) * np.uint64(2 * k + 1)
        content = mix64(content ^ (((anchor - first).astype(np.uint64) << np.uint64(16)) | (end - first).astype(np.uint64)))
        d = doc[first]
        found.append((d, starts[first] - offsets[d], end - first, anchor - first, mix64(hashes[q][anchor]), content))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def bucket_pointers(data: np.ndarray, depth: int, last: np.ndarray) -> np.ndarray:
    """Bucket-pointer refinement: for each start in `last`, the place of its bucket when all suffixes are sorted to `depth`.

    The first buckets are those of 8-grams.  A bucket of several suffixes is refined by sorting its
    members on the bucket pointers of a later offset, as far on as the pointers already reach, and the
    refined pointers serve the next round, so that each round doubles the depth; suffixes alone in
    their bucket are sorted for good.  Two starts with one pointer have `depth` equal bytes.
    """
    n = len(data)
    gram = np.zeros(n + 8, np.uint64)
    gram[:n] = data
    for width in (1, 2, 4):
        gram = (gram[:-width] << np.uint64(8 * width)) | gram[width:]
    gram = gram[:n]
    order = np.argsort(gram, kind="stable")
    pointer = np.empty(n + depth, np.int64)
    pointer[n:] = -1
    opens = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(opens, n))
    pointer[order] = np.repeat(opens, sizes)
    open_now = order[np.repeat(sizes > 1, sizes)]
    reach = 8
    while reach < depth:
        offset = min(reach, depth - reach)
        if reach + offset >= depth:  # the last round matters for the asked starts only
            mask = np.zeros(n, bool)
            mask[last] = True
            open_now = open_now[mask[open_now]]
        key = pointer[open_now] * np.int64(n + 1) + pointer[open_now + offset] + 1
        by = np.argsort(key, kind="stable")
        key, members = key[by], open_now[by]
        if not len(key):
            break
        opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.append(opens, len(key)))
        bucket = key[opens] // np.int64(n + 1)
        # the refined bucket starts where its old bucket starts, behind the members that sort before it
        begins = np.r_[True, bucket[1:] != bucket[:-1]]
        base = np.maximum.accumulate(np.where(begins, opens, 0))
        pointer[members] = np.repeat(bucket + opens - base, sizes)
        open_now = members[np.repeat(sizes > 1, sizes)]
        reach += offset
    return pointer[last]


def repeated_windows(data: np.ndarray, offsets: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Of the window starts of all runs, run after run: whether an equal window starts elsewhere in the buffer."""
    starts = ranges(offsets[:-1], windows)
    pointer = bucket_pointers(data, length, starts)
    order = np.argsort(pointer, kind="stable")
    same = pointer[order][1:] == pointer[order][:-1]
    out = np.zeros(len(starts), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def span_hash(grams: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Hashes of byte spans of at most `most` bytes from those of the 128-grams that cover them."""
    blocks = -(-most // 128)
    out = size.astype(np.uint64)
    for k in range(blocks + 1):
        out += mix64(grams[start + (size - 128) * k // blocks] ^ np.uint64(k + 7)) * np.uint64(2 * k + 1)
    return out


#: `at` packs the first window, the number of windows and the anchor's offset (10 bits each).
RUN = "did long, th long, at long, key long, content long"


def _emit_runs(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidied
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offsets = buffers(batch.column(2).fill_null(""))
            doc, s, n, a, key, content = runs_of(data, offsets, length)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s << 20 | n << 10 | a), *(pa.array(x.view(np.int64)) for x in (key, content))],
                names=["did", "th", "at", "key", "content"],
            )

    return emit


FETCHED = "did long, th long, s int, n int, key long, t int, w long, body binary"


def _fetch(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bytes of the runs asked for; those of large keys in blocks, keyed anew by what the windows of a block share."""

    @tidied

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("t", pa.int32()), ("w", pa.int64()), ("body", pa.binary())])
        for batch in sliced(batches, "text"):
            data, offsets = buffers(batch.column("text").fill_null(""))
            lists = batch.column("runs")
            runs, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            s, n, a = (np.asarray(runs.field(x)).astype(np.int64) for x in ("s", "n", "a"))
            key, large = np.asarray(runs.field("key")), np.asarray(runs.field("large"))
            did, th = np.asarray(batch.column("did"))[doc], np.asarray(batch.column("th"))[doc]
            if len(small := np.flatnonzero(~large)):
                at = offsets[doc[small]] + s[small]
                size = n[small] + length - 1
                body = pa.Array.from_buffers(
                    pa.large_binary(), len(small), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(data[ranges(at, size)])]
                ).cast(pa.binary())
                none = pa.nulls(len(small), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(x[small]) for x in (did, th)), *(pa.array(x[small].astype(np.int32)) for x in (s, n)), pa.array(key[small]), pa.nulls(len(small), pa.int32()), none, body], schema=schema)
            if len(big := np.flatnonzero(large)):
                grams = gram_hashes(data, (128,))[128]
                run = np.repeat(big, n[big])
                first = ranges(s[big], n[big])
                t = s[run] + a[run] - first
                opens = opens_of(run, t // BLOCK)
                count = np.diff(np.append(opens, len(run)))
                run, first, t = run[opens], first[opens], t[opens]
                at = offsets[doc[run]] + first
                size = count + length - 1
                # all windows of a block have this in common, whichever of them the run owns
                core = span_hash(grams, at + t - t // BLOCK * BLOCK, np.full(len(at), length - BLOCK + 1), length)
                route = mix64(core + mix64(key[run].view(np.uint64) + (t // BLOCK).astype(np.uint64)))
                whole = mix64(span_hash(grams, at, size, length + BLOCK) ^ ((t.astype(np.uint64) << np.uint64(16)) | count.astype(np.uint64)))
                body = pa.Array.from_buffers(
                    pa.large_binary(), len(at), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(data[ranges(at, size)])]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[run]), pa.array(th[run]), *(pa.array(x.astype(np.int32)) for x in (first, count)), pa.array(route.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(whole.view(np.int64)), body],
                    schema=schema,
                )

    return fetch


WINDOW = "did long, th long, s int, n int, key long, t int, w long"


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each window of the blocks, with its place to the anchor and its hash."""

    @tidied

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            data, offsets = buffers(batch.column("body"))
            n = np.asarray(batch.column("n")).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            step = ranges(np.zeros(len(n), np.int64), n)
            w = span_hash(gram_hashes(data, (128,))[128], offsets[row] + step, np.full(len(row), length), length)
            s, t = (np.asarray(batch.column(x)).astype(np.int64)[row] for x in ("s", "t"))
            take = pa.array(row)
            did, th, key = (batch.column(x).take(take) for x in ("did", "th", "key"))
            yield pa.RecordBatch.from_arrays(
                [did, th, pa.array((s + step).astype(np.int32)), pa.array(np.ones(len(row), np.int32)), key, pa.array((t - step).astype(np.int32)), pa.array(w.view(np.int64))],
                names=["did", "th", "s", "n", "key", "t", "w"],
            )

    return windows


MARK = "did long, th long, s int, n int"


def _sort_suffixes(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by key, the runs of windows that occur again; sorted in lots of whole keys."""

    @tidied

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches, ["key"], "body", SORT_BYTES):
            data, offsets = buffers(lot.column("body"))
            s, n = (np.asarray(lot.column(x)).astype(np.int64) for x in ("s", "n"))
            hit = np.flatnonzero(repeated_windows(data, offsets, n, length))
            row, first = np.repeat(np.arange(len(n)), n)[hit], ranges(s, n)[hit]
            opens = opens_of(row, first - np.arange(len(first)))
            take = pa.array(row[opens])
            count = np.diff(np.append(opens, len(hit)))
            yield pa.RecordBatch.from_arrays([lot.column("did").take(take), lot.column("th").take(take), pa.array(first[opens].astype(np.int32)), pa.array(count.astype(np.int32))], names=["did", "th", "s", "n"])

    return sort


def row_key(id_col: str, text_col: str) -> dict[str, Column]:
    """did and th name a row: equal rows are alike in all that follows, and nulls compare."""
    return {"did": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "th": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}


def suffix_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(did, th, s, n): the n windows from byte s on of a document occur again elsewhere."""
    spark = docs.sparkSession
    _fits(length)
    key = row_key(id_col, text_col)
    slim = docs.select(key["did"].alias("did"), key["th"].alias("th"), F.col(text_col).alias("text"))
    runs = written(slim.mapInArrow(_emit_runs(length), RUN), "runs")
    keys = runs.groupBy("key").agg(F.count("*").alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("c > 1")
    keys = written(keys.select("key", "c", (F.col("lo") != F.col("hi")).alias("mixed")), "keys")
    release(spark)
    s, n, a = F.shiftright("at", 20).cast("int"), F.shiftright("at", 10).bitwiseAND(1023).cast("int"), F.col("at").bitwiseAND(1023).cast("int")
    met = written(unskewed(runs, keys, ["key"]).select("did", "th", s.alias("s"), n.alias("n"), a.alias("a"), "key", "content", "mixed"), "met")
    release(spark, runs, keys)

    mixed = met.where("mixed")
    contents = written(
        mixed.groupBy("key", "content").agg(F.count("*").alias("c"), F.min(F.struct("did", "th", "s", "n", "a")).alias("one")), "contents"
    )
    counts = contents.groupBy("key").agg(F.count("*").alias("c")).withColumn("large", F.col("c") > LARGE_KEY)
    asked = unskewed(contents.select("one.*", "key"), counts, ["key"])
    lists = asked.groupBy("did", "th").agg(F.collect_list(F.struct("s", "n", "a", "key", "large")).alias("runs"))
    fetched = written(slim.join(lists, ["did", "th"]).select("did", "th", "text", "runs").mapInArrow(_fetch(length), FETCHED), "fetched")
    release(spark)

    copies = met.where("not mixed").select("did", "th", "s", "n")
    copies_too = unskewed(mixed, contents.where("c > 1").select("key", "content", "c"), ["key", "content"], "left_semi").select("did", "th", "s", "n")
    small = fetched.where("t is null").select("did", "th", "s", "n", "key", "body")
    blocks = fetched.where("t is not null")
    routes = blocks.groupBy("key").agg(F.count("*").alias("c"), F.min("w").alias("lo"), F.max("w").alias("hi")).where("c > 1")
    blocks = unskewed(blocks, routes.withColumn("many", F.col("c")), ["key"])
    copied = blocks.where("lo = hi").select("did", "th", "s", "n")
    differ = blocks.where("lo <> hi")
    sortable = small.unionByName(differ.where(F.col("many") <= LARGE_KEY).select("did", "th", "s", "n", "key", "body"))
    sorted_ = sortable.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_suffixes(length), MARK)
    windows = differ.where(F.col("many") > LARGE_KEY).select("did", "th", "s", "n", "key", "t", "body").mapInArrow(_windows(length), WINDOW)
    again = windows.groupBy("key", "t", "w").agg(F.count("*").alias("c")).where("c > 1")
    big = unskewed(windows, again, ["key", "t", "w"], "left_semi").select("did", "th", "s", "n")
    return copies.unionByName(copies_too).unionByName(copied).unionByName(sorted_).unionByName(big)


def _spans(lists: pa.Array, row: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of the marked windows of a document: starts and ends of maximal spans."""
    marks = lists[row].values if lists[row].is_valid else None
    if marks is None or not len(marks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, n = (np.asarray(marks.field(x)).astype(np.int64) for x in ("s", "n"))
    order = np.argsort(s, kind="stable")
    s, e = s[order], (s + n + length - 1)[order]
    e = np.maximum.accumulate(e)
    opens = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[opens], e[np.append(opens[1:] - 1, len(s) - 1)]


SPANS = "repeated_spans"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Adds SPANS, marks of the windows (s, n) of each text that start a repeated string of `length` bytes, null for none.

    `span_digest` and `without_spans` turn them into byte spans.  Texts are judged as UTF-8 bytes, a null
    text as empty.  Repeated rows repeat each other, so all of a text of `length` bytes or more goes from
    both; shorter texts have no mark.  An empty table gives an empty table.  Other columns pass through
    unchanged, whatever their names; a column named SPANS is replaced.
    """
    docs = docs.drop(SPANS)
    did, th = unused(docs, "did", "th")
    marks = suffix_marks(docs, id_col, text_col, length).groupBy("did", "th").agg(F.collect_list(F.struct("s", "n")).alias(SPANS))
    marks = marks.select(F.col("did").alias(did), F.col("th").alias(th), SPANS)
    key = row_key(id_col, text_col)
    return docs.withColumns({did: key["did"], th: key["th"]}).join(marks, [did, th], "left").select(*(f"`{c}`" for c in docs.columns), SPANS)


def span_digest(marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay, from `suffix_dedup`."""

    @tidied

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offsets = buffers(batch.column(1).fill_null(""))
            rows: list[tuple[int, int, int, str]] = []
            for i in range(batch.num_rows):
                body = data[offsets[i] : offsets[i + 1]]
                starts, ends = _spans(batch.column(2), i, length)
                kept, at = hashlib.sha256(), 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.update(body[at:s])
                    at = e
                kept.update(body[at:])
                rows.append((len(body), int((ends - starts).sum()), len(starts), kept.hexdigest()))
            n, removed, spans, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    slim = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), SPANS)
    return slim.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_spans(marked: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of `suffix_dedup` with the repeated spans cut out of the text, shrunk to whole characters."""
    columns = [c for c in marked.columns if c != SPANS]
    schema = marked.select(*columns).schema

    @tidied

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            at_text = batch.schema.get_field_index(text_col)
            source = batch.column(at_text)
            marks = batch.column(batch.schema.get_field_index(SPANS))
            out = source.to_pylist()
            for i in np.flatnonzero(np.asarray(marks.is_valid())):
                body = out[i].encode()
                starts, ends = _spans(marks, int(i), length)
                parts, at = [], 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    while s < e and (body[s] & 0xC0) == 0x80:
                        s += 1
                    while e > s and e < len(body) and (body[e] & 0xC0) == 0x80:
                        e -= 1
                    parts.append(body[at:s])
                    at = e
                out[i] = b"".join([*parts, body[at:]]).decode()
            columns_out = [pa.array(out, source.type) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(columns_out, names=columns)

    return marked.mapInArrow(cut, schema)
