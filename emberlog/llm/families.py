"""Exact links within families of sets, however large and however alike.

A family is a group of sets that may be similar, some of which are known to be connected.  Only links
across components are asked for, and only enough of them to connect what they connect.  Families of up
to `DIRECT` sets are compared at once.  Larger ones are refined, level after level:

1. A shingle whose sets are all of one component can't be shared by a pair that is asked for; it is
   left out.  A set that has too few others for the similarity is done with.
2. The others are in one order, those with few sets outside their largest component first.  Two
   similar sets share the first of their common shingles, which is in the prefix of both (prefix
   filter).  Is it one with few such sets, the pair meets there: `FEW` partners a row at most.
3. What is left is pairs that share only frequent shingles.  Sets with the same frequent shingles and
   the same size are one class: they are all similar, or none is by these shingles alone, and two
   classes are linked as wholes.  Classes are the sets of the next level.

So N texts from one template that differ in words of their own cost N rows, not N * N pairs.  Where
classes don't get fewer, they are compared block by block, those of the largest component with the
others only; a block has `ROWS` rows and `BYTES` of sets at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import lots, opens_of, ranges, tidied, unskewed, written

DIRECT, FEW, LEVELS = 512, 32, 8
ROWS, BYTES = 128, 1 << 20
LINK = "a long, b long"


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of components, the places of those that are enough to connect all that they connect."""
    root: dict[int, int] = {}

    def of(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = of(x), of(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            keep.append(k)
    return np.array(keep, np.int64)


def common_sizes(sizes: np.ndarray, items: np.ndarray, wide: int = 2048) -> np.ndarray:
    """Sizes of all intersections of few sets: products of the incidence matrix, some columns at a time."""
    _, number, count = np.unique(items, return_inverse=True, return_counts=True)
    shared = count > 1  # what one set alone has doesn't count
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sizes)), sizes)[shared[number]]
    column = place[number[shared[number]]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((len(sizes), len(sizes)), np.float32)
    for at in range(0, int(shared.sum()), wide):
        low, high = np.searchsorted(column, (at, at + wide))
        part = np.zeros((len(sizes), wide), np.float32)
        part[row[low:high], column[low:high] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _compare(similar: int):
    """Links across components within pairs of blocks, enough of them to connect what they connect."""

    @tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches, ["key", "i", "j"]):
            ids = [np.asarray(lot.column(x)) for x in ("key", "i", "j")]
            opens = opens_of(*ids)
            for first, last in zip(opens.tolist(), [*opens[1:].tolist(), lot.num_rows], strict=True):
                part = lot.slice(first, last - first)
                node, comp, block, n = (np.asarray(part.column(x)) for x in ("node", "comp", "block", "n"))
                ok = np.triu(comp[:, None] != comp[None, :], 1)
                if ids[1][first] != ids[2][first]:
                    ok &= block[:, None] != block[None, :]
                ok &= 100 * np.minimum(n[:, None], n[None, :]) >= similar * np.maximum(n[:, None], n[None, :])
                if not ok.any():
                    continue
                lists = part.column("set")
                common = common_sizes(np.diff(np.asarray(lists.offsets)).astype(np.int64), np.asarray(lists.flatten()))
                ok &= 100 * common >= similar * (n[:, None] + n[None, :] - common)
                x, y = np.nonzero(ok)
                keep = spanning(comp[x], comp[y])
                yield pa.RecordBatch.from_arrays([pa.array(node[x[keep]]), pa.array(node[y[keep]])], names=["a", "b"])

    return compare


def block_links(items: DataFrame, similar: int) -> DataFrame:
    """Links within families by comparing all pairs of blocks but those of the largest component with each other."""
    weight = F.size("set").cast("long")
    parts = items.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum(weight).alias("held"))
    whole = parts.groupBy("key").agg(F.sum("rows").alias("c"), F.sum("held").alias("held"), F.max(F.struct("rows", "held", "comp")).alias("top")).where("top.rows < c")
    blocks = lambda rows, held: F.ceil(F.greatest(rows / F.lit(float(ROWS)), held * 8 / F.lit(float(BYTES)))).cast("int")
    one = blocks(F.col("c"), F.col("held")) <= 1  # all in one block
    own = F.when(one, 1).otherwise(blocks(F.col("c") - F.col("top.rows"), F.col("held") - F.col("top.held")))
    top = F.when(one, 0).otherwise(blocks(F.col("top.rows"), F.col("top.held")))
    plan = written(whole.select("key", "c", F.col("top.comp").alias("top"), own.alias("bs"), top.alias("bt")), "blocks")
    apart = (F.col("bt") == 0) | (F.col("comp") != F.col("top"))
    at = F.when(apart, F.pmod(F.xxhash64("node"), F.col("bs"))).otherwise(F.col("bs") + F.pmod(F.xxhash64("node"), F.greatest("bt", F.lit(1)))).cast("int")
    others = F.when(apart, F.sequence(F.lit(0), F.col("bs") + F.col("bt") - 1)).otherwise(F.sequence(F.lit(0), F.col("bs") - 1))
    dealt = unskewed(items, plan, ["key"]).select("key", "node", "comp", "n", "set", at.alias("block"), F.explode(others).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n", "set")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(similar), LINK)


def _refined(items: DataFrame, similar: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links by shingles with few sets and within classes, (node, rep, linked) of the classes, and these as items."""
    need = F.expr(f"(n * {similar} + 99) div 100")
    tokens = items.select("key", "node", "comp", "n", F.explode("set").alias("t"))
    by_comp = tokens.groupBy("key", "t", "comp").agg(F.count("*").alias("c"))
    held = by_comp.groupBy("key", "t").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("top"))
    s = F.col("c") - F.col("top.c")
    held = written(held.where(s > 0).select("key", "t", "c", F.struct((s > FEW).alias("hot"), s.alias("s"), "t", F.col("top.comp").alias("top")).alias("x")), "held")
    lists = unskewed(tokens, held, ["key", "t"]).groupBy("key", "node", "comp", "n").agg(F.array_sort(F.collect_list("x")).alias("x"))
    lists = written(lists.where(F.size("x") >= need), "lists")

    prefix = F.filter(F.slice("x", F.lit(1), F.size("x") - need.cast("int") + 1), lambda x: ~x.hot)
    filed = lists.select("key", "node", "comp", "n", F.explode(prefix).alias("x")).select("key", "x.t", "x.top", "node", "comp", "n")
    apart = written(filed.where("comp <> top").select("key", "t", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na")), "apart")
    pairs = filed.join(apart, ["key", "t"]).where("comp <> ca and (comp = top or a < node)")
    pairs = pairs.where(100 * F.least("n", "na") >= similar * F.greatest("n", "na")).select("a", F.col("node").alias("b")).distinct()
    sets = items.select("node", "n", "set")
    both = pairs.join(sets.toDF("a", "na", "x"), "a").join(sets.toDF("b", "nb", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = both.where(100 * common >= similar * (F.col("na") + F.col("nb") - common)).select("a", "b")

    frequent = F.transform(F.filter("x", lambda x: x.hot), lambda x: x.t)
    tagged = lists.select("key", "node", "comp", "n", F.array_sort(frequent).alias("set")).where(F.size("set") >= need)
    tagged = tagged.withColumns({"h": F.xxhash64("set"), "g": F.hash("set")})  # 96 bits name what is frequent
    classes = tagged.groupBy("key", "n", "h", "g").agg(F.count("*").alias("c"), F.min("node").alias("rep"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("set").alias("set"))
    linked = 100 * F.size("set") >= similar * (2 * F.col("n") - F.size("set"))
    classes = written(classes.withColumn("linked", linked), "classes")
    members = written(unskewed(tagged.drop("set"), classes.select("key", "n", "h", "g", "c", "rep", "linked"), ["key", "n", "h", "g"]).select("node", "rep", "linked"), "members")
    links = links.union(members.where("linked and node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    # a class that is not connected is a component of its own
    comp = F.when(F.col("linked") | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(-1 - F.col("rep"))
    return written(links, "links"), members, classes.select("key", F.col("rep").alias("node"), comp.alias("comp"), "n", "set")


def family_links(items: DataFrame, similar: int) -> DataFrame:
    """(a, b): links between `items` of one family and different components that connect all that links connect.

    items: key (the family), node, comp, n (the size of the set) and set, an array of distinct longs; a
    written table.  Numbers of components are not negative.
    """
    found: list[DataFrame] = []  # by level
    classes: list[DataFrame] = []
    while True:
        counts = items.groupBy("key").agg(F.count("*").alias("c"))
        large = written(counts.where(F.col("c") > (DIRECT if len(classes) < LEVELS else 2**62)), "large")
        if large.isEmpty():
            found.append(written(block_links(items, similar), "links"))
            break
        small = items.join(large.select("key"), "key", "left_anti")
        refine = written(unskewed(items, large, ["key"], "left_semi"), "refine")
        links, members, following = _refined(refine, similar)
        found.append(written(links.union(block_links(written(small, "small"), similar)), "links"))
        classes.append(members)
        items = written(following, "items")
        if items.count() > 0.8 * refine.count():  # classes no longer get fewer
            found.append(written(block_links(items, similar), "links"))
            break
    out = found[-1]
    for links, members in zip(reversed(found[:-1]), reversed(classes), strict=True):
        # what is linked with a class is linked with each of its members
        ends = out.union(out.select("b", "a")).groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("a"))
        all_of = members.where("not linked and node <> rep").join(ends, "rep").select("a", F.col("node").alias("b"))
        out = links.unionByName(out).unionByName(all_of)
    return written(out, "links")


#: Families of so many items in all, and so many products of rows and items of a family, are joined by one task.
ITEMS, PRODUCTS = 1 << 21, 1 << 31
#: Pairs that such a task counts at once.
CELLS = 1 << 22


def _joined(node: np.ndarray, comp: np.ndarray, n: np.ndarray, items: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one family, enough of them to connect what all connect.

    Frequent shingles are counted by products of the incidence matrix, the others by their lists of
    sets.  With N sets of M shingles in all either costs O(N * M).
    """
    none = np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    _, number = np.unique(items, return_inverse=True)
    by = np.argsort(number, kind="stable")
    row, number = row[by], number[by]
    opens = opens_of(number)
    sizes = np.diff(np.append(opens, len(number)))
    if not len(opens):
        return none, none
    # a shingle of one component alone is in no pair that is asked for
    mixed = np.minimum.reduceat(comp[row], opens) < np.maximum.reduceat(comp[row], opens)
    able = 100 * np.bincount(row[np.repeat(mixed, sizes)], minlength=len(n)) >= similar * n
    place = np.cumsum(able) - 1
    keep = np.repeat(mixed, sizes) & able[row]
    row, number = place[row[keep]], number[keep]
    node, n = node[able], n[able]
    comp = np.unique(comp[able], return_inverse=True)[1]
    opens = opens_of(number)
    sizes = np.diff(np.append(opens, len(number)))
    rows = len(n)

    hot = sizes > max(rows // 8, 1)
    dense = np.zeros((rows, int(hot.sum())), np.float32)
    dense[row[np.repeat(hot, sizes)], np.repeat(np.arange(dense.shape[1]), sizes[hot])] = 1
    rare = np.repeat(~hot, sizes)
    mine, start, count = row[rare], np.repeat(opens[~hot], sizes[~hot]), np.repeat(sizes[~hot], sizes[~hot])
    by = np.argsort(mine, kind="stable")
    mine, start, count = mine[by], start[by], count[by]
    total = np.append(0, np.cumsum(count))

    a, b = [none], [none]
    step = max(1, CELLS // max(rows, 1))
    for first in range(0, rows, step):
        part = slice(first, min(first + step, rows))
        common = np.rint(dense[part] @ dense.T).astype(np.int32)
        at, end = np.searchsorted(mine, (part.start, part.stop))
        while at < end:
            to = min(end, max(at + 1, int(np.searchsorted(total, total[at] + CELLS, side="right")) - 1))
            cells = np.repeat(mine[at:to] - first, count[at:to]) * rows + row[ranges(start[at:to], count[at:to])]
            common += np.bincount(cells, minlength=common.size).astype(np.int32).reshape(common.shape)
            at = to
        ok = (comp[part, None] != comp[None, :]) & (100 * common.astype(np.int64) >= similar * (n[part, None] + n[None, :] - common))
        x, y = np.nonzero(ok)
        x += first
        one = np.unique(comp[x] * rows + comp[y], return_index=True)[1]  # of each pair of components
        one = one[spanning(comp[x[one]], comp[y[one]])]
        for p, q in zip(x[one].tolist(), y[one].tolist(), strict=True):
            comp[comp == comp[q]] = comp[p]
        a.append(node[x[one]])
        b.append(node[y[one]])
    return np.concatenate(a), np.concatenate(b)


def _together(similar: int):
    """Links of all families that the task gets."""

    @tidied
    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        items = pa.Table.from_batches(held).combine_chunks().sort_by("key").combine_chunks().to_batches()[0]
        opens = opens_of(np.asarray(items.column("key")))
        for first, last in zip(opens.tolist(), [*opens[1:].tolist(), items.num_rows], strict=True):
            part = items.slice(first, last - first)
            node, comp = (np.asarray(part.column(x)) for x in ("node", "comp"))
            lists = part.column("set")
            a, b = _joined(node, comp, np.diff(np.asarray(lists.offsets)).astype(np.int64), np.asarray(lists.flatten()), similar)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return together


def links_of(items: DataFrame, similar: int) -> DataFrame:
    """What `family_links` gives.  Little work is done by one task: there the levels would cost many jobs, whatever they hold."""
    held = items.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.col("n").cast("long")).alias("held"))
    most = held.agg(F.sum("held").alias("held"), F.sum(F.col("c").cast("double") * F.col("held")).alias("products")).first()
    if (most.held or 0) > ITEMS or (most.products or 0) > PRODUCTS:
        return family_links(items, similar)
    return written(items.select("key", "node", "comp", "set").coalesce(1).mapInArrow(_together(similar), LINK), "links")
