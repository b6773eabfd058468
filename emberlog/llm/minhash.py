"""Near-duplicate detection: b-bit MinHash signatures joined by a multi-index Hamming join.

A signature has `CHUNKS` chunks of `WIDTH` components of 16 bits.  If two signatures differ in fewer
than CHUNKS * (ERRORS + 1) components, some chunk differs in ERRORS at most (pigeonhole); a signature
is filed under every choice of WIDTH - ERRORS components of each chunk, so all pairs under that
distance meet in a bucket.  Links are confirmed on the full shingle sets.

Only components are asked for, so pairs inside a known component are never compared:
1. equal sets become one node;
2. each node is compared with the nearest of the smallest nodes of its buckets;
3. small buckets that still hold several components compare all nodes across them;
4. nodes of larger such buckets form families, whose overlapping buckets are joined at once on full
   sets (`families`), without comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import buffers, connected_components, lots, mix64, opens_of, ranges, release, sliced, tidied, words_of, written
from emberlog.llm.families import links_of

CHUNKS, WIDTH, ERRORS = 8, 5, 1
COMPONENTS = CHUNKS * WIDTH
#: All pairs up to this distance meet in a bucket.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Pairs that meet are compared up to this distance, which a pair of the similarity passes but for 1e-5.
COMPARED = 19
#: Buckets of at most so many rows are compared pair by pair, larger ones as families.
SMALL = 12
_CHOICES = list(combinations(range(WIDTH), WIDTH - ERRORS))
_ODD = mix64(np.arange(1, COMPONENTS + 1, dtype=np.uint64)) | np.uint64(1)
_NO_ID = 2**63 - 1


class Shingler:
    """Distinct shingles of texts as 64-bit hashes.  A-Z is lower-cased, words end at ASCII white space."""

    def __init__(self, words: int) -> None:
        self.words = words

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All sets, sorted within each text, and their sizes."""
        import xxhash

        number, distinct, n = words_of(texts)
        word = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[number]
        begin = np.cumsum(n) - n
        # shingles of full length start where enough words follow; a shorter text is one shingle
        length = np.minimum(n, self.words)
        count = np.where(n > 0, n - length + 1, 0)
        start = ranges(begin, count)
        of = np.repeat(np.arange(len(n)), count)
        h = np.full(len(start), 0x51ED270B, np.uint64)
        for k in range(self.words):
            there = k < length[of]
            at = np.minimum(start + k, max(len(word) - 1, 0))
            h = np.where(there, mix64(h * np.uint64(0x9E3779B97F4A7C15) + word[at] + np.uint64(k)), h) if len(word) else h
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[keep], of[keep]
        return h, np.bincount(of, minlength=len(n)).astype(np.int64)


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16-bit MinHash components, a row for each set; empty sets get zeros."""
    out = np.zeros((len(sizes), COMPONENTS), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        for k in range(COMPONENTS):
            least = np.minimum.reduceat((sets ^ (sets >> np.uint64(29 + k % 7))) * _ODD[k], begin)
            out[full, k] = (mix64(least) >> np.uint64(48)).astype(np.uint16)
    return out


def set_hashes(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    total = np.append(np.uint64(0), np.cumsum(mix64(sets ^ np.uint64(0xA5A5)), dtype=np.uint64))
    twice = np.append(np.uint64(0), np.cumsum(mix64(sets + np.uint64(0x77)), dtype=np.uint64))
    end = np.cumsum(sizes)
    return tuple(mix64(t[end] - t[end - sizes] + sizes.astype(np.uint64)).view(np.int64) for t in (total, twice))


#: Texts to all sets, sorted within each text, and their sizes; made once for a task.
Maker = Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]]
#: Sets and sizes to all buckets of the sets, and the buckets of each.
Buckets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

SIGNED = "id long, th long, n long, s1 long, s2 long, sig binary, keys array<long>"


def _sign(maker: Maker, buckets: Buckets | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidied
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in sliced(batches, "text", 1 << 20):
            sets, sizes = make(batch.column(1))
            s1, s2 = set_hashes(sets, sizes)
            sig = signatures(sets, sizes).astype("<u2").tobytes()
            body = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((np.arange(len(sizes) + 1) * 2 * COMPONENTS).astype(np.int32)), pa.py_buffer(sig)])
            keys = pa.nulls(len(sizes), pa.list_(pa.int64()))
            if buckets is not None:
                own, count = buckets(sets, sizes)
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(own.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(s1), pa.array(s2), body, keys], names=["id", "th", "n", "s1", "s2", "sig", "keys"])

    return sign


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(buffers(column)[0], "<u2").reshape(len(column), COMPONENTS)


def _slot_keys(sig: np.ndarray, chunk: np.ndarray | int, choice: np.ndarray | int) -> np.ndarray:
    """The key under which each signature is filed for a choice of components of a chunk."""
    h = np.broadcast_to(np.asarray(chunk * len(_CHOICES) + choice + 1), len(sig)).astype(np.uint64)
    row = np.arange(len(sig))
    for k in range(WIDTH - ERRORS):
        at = chunk * WIDTH + np.array(_CHOICES)[choice, k]
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[row, at].astype(np.uint64))
    return h.view(np.int64)


@tidied


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node): the buckets of each signature, the enumeration of the allowed chunk errors."""
    for batch in batches:
        for part in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
            sig = _matrix(part.column(1))
            keys = [_slot_keys(sig, c, e) for c in range(CHUNKS) for e in range(len(_CHOICES))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(np.asarray(part.column(0)), len(keys)))], names=["key", "node"])


def _first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bucket that two signatures share."""
    same = (a == b).reshape(len(a), CHUNKS, WIDTH)
    chunk = ((~same).sum(axis=2) <= ERRORS).argmax(axis=1)
    mine = same[np.arange(len(a)), chunk]
    choice = np.stack([mine[:, c].all(axis=1) for c in map(list, _CHOICES)], axis=1).argmax(axis=1)
    return _slot_keys(a, chunk, choice)


def _near(similar: int, first_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs across components of small buckets that may be links; with `first_only` each in the first bucket it shares.  Sizes n bound the similarity."""

    @tidied

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches, ["key"]):
            sig = _matrix(lot.column("sig"))
            key, node, comp, size = (np.asarray(lot.column(x)) for x in ("key", "node", "comp", "n"))
            opens = opens_of(key)
            sizes = np.diff(np.append(opens, len(key)))
            for m in np.unique(sizes[sizes > 1]):
                rows = opens[sizes == m][:, None] + np.arange(m)[None, :]
                n, c, s = node[rows], comp[rows], size[rows]
                ok = (c[:, :, None] != c[:, None, :]) & (n[:, :, None] < n[:, None, :])
                ok &= 100 * np.minimum(s[:, :, None], s[:, None, :]) >= similar * np.maximum(s[:, :, None], s[:, None, :])
                g, x, y = np.nonzero(ok)
                left, right = rows[g, x], rows[g, y]
                keep = np.zeros(len(g), bool)
                for at in range(0, len(g), 1 << 15):
                    part = slice(at, at + (1 << 15))
                    near_enough = (sig[left[part]] != sig[right[part]]).sum(axis=1) <= COMPARED
                    if first_only:
                        near_enough[near_enough] = _first_key(sig[left[part]][near_enough], sig[right[part]][near_enough]) == key[left[part]][near_enough]
                    keep[part] = near_enough
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[left[keep]]), pa.array(node[right[keep]])], names=["a", "b"])

    return near


def _sets(maker: Maker) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidied
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in sliced(batches, "text", 1 << 20):
            sets, sizes = make(batch.column(1))
            s1, _ = set_hashes(sets, sizes)
            mine = pa.array(s1 == np.asarray(batch.column(2)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(sets.view(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "set"])
            yield out.filter(mine)

    return sets_of


def near_duplicates(docs: DataFrame, words: int = 5, similar: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two documents are linked if 100 * |A & B| >= similar * |A | B| for their sets of `words`-word
    shingles (a shorter text is one shingle).  component_id is the smallest id that links reach, its
    own for documents without words, which link with nothing; kept tells that it is the row's own.
    Rows are linked by their texts, never by a common id.  A null id takes part, comes last as a
    representative and has a null component if nothing else is in it.  Pairs at the similarity itself are missed with a probability of
    about 3e-5 by their signatures (0.26 ** 8 meet in no bucket), more similar pairs with less.
    """
    return linked(docs, lambda: Shingler(words), similar, id_col, text_col).withColumnRenamed("n_items", "n_shingles")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """What names a row: its id, the largest number for a null one, and the hash of its text."""
    return {"id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "th": F.xxhash64(text_col)}


def representatives(docs: DataFrame, words: int = 5, similar: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, copies): the `row_key` of one row of each group of near-duplicates, and the rows that have it.

    It is the row of the smallest id, null last, and of these that of the smallest hash.  Every row
    without words is a group, but rows with the same key are one.
    """
    rows = components(docs, lambda: Shingler(words), similar, id_col, text_col)
    return rows.where("id = best.id and th = best.th").groupBy("id", "th").agg(F.count("*").alias("copies"))


def linked(docs: DataFrame, maker: Maker, similar: int, id_col: str, text_col: str, buckets: Buckets | None = None) -> DataFrame:
    """(doc_id, n_items, component_id, kept) for the sets that `maker` makes; without `buckets` sets meet by their signatures."""
    out = components(docs, maker, similar, id_col, text_col, buckets)
    component = F.col("best.id")
    return out.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_items"), F.when(component != _NO_ID, component).alias("component_id"), (F.col("id") == component).alias("kept")
    )


def components(docs: DataFrame, maker: Maker, similar: int, id_col: str, text_col: str, buckets: Buckets | None = None) -> DataFrame:
    """(id, th, n, best) of every row: its key, the size of its set, and the smallest key (id, th) of its component.

    Nodes are the distinct sets, numbered as they are written; ids only name the components.
    """
    spark = docs.sparkSession
    key = row_key(id_col, text_col)
    slim = docs.select(key["id"].alias("id"), F.col(text_col).alias("text"), key["th"].alias("th"))
    signed = written(slim.mapInArrow(_sign(maker, buckets), SIGNED), "signed")
    sets = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "th")).alias("first"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    nodes = written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    filed = nodes.select("node", "sig").mapInArrow(_file, "key long, node long") if buckets is None else nodes.select(F.explode("keys").alias("key"), "node")
    hubs = filed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    # tables of their own, so that Spark can split the large partitions of the joins with them
    hubs = written(hubs, "hubs")
    release(spark)
    members = written(filed.join(hubs, "key"), "members")
    release(spark, hubs)
    signature = nodes.select("node", "sig", "n")

    pairs = members.where("node <> hub").select("node", "hub").distinct()

    @tidied

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d.astype(np.int32))], names=["node", "hub", "d"])

    sized = pairs.join(signature, "node").join(signature.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub").select("node", "hub", "sig", "hub_sig")
    stars = sized.mapInArrow(measure, "node long, hub long, d int").where(F.col("d") <= COMPARED).groupBy("node").agg(F.min(F.struct("d", "hub")).alias("best"))
    tested = written(stars.select(F.col("best.hub").alias("a"), F.col("node").alias("b")), "stars")

    def sets_of(ends: DataFrame) -> DataFrame:
        """(node, set) of nodes, from the texts."""
        named = ends.distinct().join(nodes.select("node", "s1", "first.id", "first.th"), "node")
        sets = slim.join(named, ["id", "th"]).select("node", "text", "s1").mapInArrow(_sets(maker), "node long, set array<long>")
        return written(sets.dropDuplicates(["node"]), "sets")

    def confirmed(candidates: DataFrame) -> DataFrame:
        sets = sets_of(candidates.select(F.col("a").alias("node")).union(candidates.select(F.col("b").alias("node"))))
        both = candidates.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        found = written(both.where(100 * common >= similar * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
        release(spark, sets)
        return found

    links = confirmed(tested)
    labels = connected_components(links)
    def still_mixed() -> DataFrame:
        """Members of buckets that hold several components: key, node, comp, rows of the bucket and its smallest node."""
        named = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
        mixed = named.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return named.join(mixed.where("lo < hi").select("key", "c", "hub"), "key")

    rows = still_mixed().where(F.col("c") <= SMALL).join(signature, "node").select("key", "node", "comp", "sig", "n")
    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_near(similar, buckets is None), "a long, b long").distinct()
    fresh = written(found.join(tested, ["a", "b"], "left_anti"), "fresh")
    if not fresh.isEmpty():
        links = links.union(confirmed(fresh))
        labels = connected_components(links)
    # families of nodes whose large buckets overlap: on full sets
    heavy = written(still_mixed().where(F.col("c") > SMALL).select("node", "comp", "hub").distinct(), "heavy")
    if not heavy.isEmpty():
        family = connected_components(heavy.select(F.col("node").alias("a"), F.col("hub").alias("b"))).select("node", F.col("component").alias("key"))
        family = written(family.join(heavy.select("node", "comp").distinct(), "node"), "family")
        full = family.join(sets_of(family.select("node")), "node").select("key", "node", "comp", F.size("set").alias("n"), "set")
        links = links.union(links_of(written(full, "full"), similar))
        labels = connected_components(links)
    release(spark, members)

    own = F.struct("id", "th")
    ends = labels.join(nodes.select("node", "first"), "node")
    # a table of its own, so that Spark can split a large component
    best = written(ends.groupBy("component").agg(F.min("first").alias("best")), "best")
    reached = labels.join(best, "component").select("node", "best")
    same = nodes.select("s1", "s2", "n", "node", "first").join(reached, "node", "left").select("s1", "s2", "n", F.coalesce("best", "first").alias("best"))
    out = signed.select("id", "th", "n", "s1", "s2").join(same, ["s1", "s2", "n"], "left")
    return out.select("id", "th", "n", F.coalesce("best", own).alias("best"))
