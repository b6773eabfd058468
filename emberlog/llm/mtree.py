"""Exact top-k search by inner product with M-trees.

A vector x gets one more component, sqrt(m - |x|^2) for the largest squared length m of its tree, a
query a zero there; then |q - x|^2 = |q|^2 + m - 2 q.x, so the largest products are the nearest points of
a metric space.

A tree has pages of `PAGE` points and above them, level by level, pages of `FAN` nodes.  A node has a
routing object, which is one of its points, a covering radius, and its distance to the routing object of
the page it is in; a point has its distance to that of its page.  Queries go down best first: pages wait
by their lower bounds.  When a page is opened, the distances stored in it and that of the query to its
routing object bound each entry from below by the triangle inequality; distances and products are
computed for entries that pass only (`search` counts them).

Points are dealt to trees by the nearest of some pivots, so that a tree covers a part of the space; a
part of too many points has several trees.  Each tree is built once and searched for the queries of its
part.  What they have found bounds their search in all other trees, which read the queries block by block.
Products are exact integers: floating-point arithmetic is used where it is exact, else Python's integers.
"""

from __future__ import annotations

import heapq
import pickle
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import fresh_path, partitions_of, tidied, unskewed, written

PAGE, FAN = 64, 16
#: Points of a tree, and the bytes that they take at most; a tree of few points is not worth its task.
TREE, TREE_BYTES, SMALL_TREE = 16384, 16 << 20, 1024
#: Queries that go down a tree together, and that are read at once.
BATCH, BLOCK = 64, 1024
#: Vectors of which pivots are chosen, and pivots for each length of vectors at most.
SAMPLE, PIVOTS = 2048, 512
_NO_NAME = np.iinfo(np.int64).max


class MTree:
    """A metric tree over the vectors floor(scale * x); x is a row of `vectors`."""

    def __init__(self, vectors: np.ndarray, names: np.ndarray, scale: int = 1) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            points = np.floor(scale * vectors.astype(np.float64))
            square = (points**2).sum(axis=1)
        self.scale, self.most = scale, float(square.max()) if len(square) else 0.0
        self.largest = float(np.abs(points).max(initial=0.0))
        # bounds need finite squares; without them every page is opened
        self.bounded = bool(np.isfinite(self.most))
        lifted = np.hstack([points, np.sqrt(np.maximum(self.most - square, 0))[:, None]]) if self.bounded else np.zeros((len(points), points.shape[1] + 1))
        pages = self._pages(lifted)
        order = np.concatenate(pages) if pages else np.zeros(0, np.int64)
        self.vectors, self.names, self.points = vectors[order], names[order], points[order]
        lifted = lifted[order]
        start = np.cumsum([0, *map(len, pages)])
        #: By level: where the entries of each node begin, routing objects, radii, distances to the routing object above.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        at, reach = lifted, np.zeros(len(lifted))
        while True:
            centre, radius, up = [], [], np.zeros(len(at))
            for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                part = at[a:b]
                middle = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmin()]
                up[a:b] = np.sqrt(((part - middle) ** 2).sum(axis=1))
                centre.append(middle)
                radius.append((up[a:b] + reach[a:b]).max())
            if self.levels:
                self.levels[-1] = (*self.levels[-1][:3], up)
            else:
                self.to_page = up
            at, reach = np.array(centre).reshape(len(centre), lifted.shape[1]), np.array(radius)
            self.levels.append((start, at, reach, np.zeros(len(at))))
            if len(at) <= 1:
                return
            start = np.append(np.arange(0, len(at), FAN), len(at))

    @staticmethod
    def _pages(lifted: np.ndarray) -> list[np.ndarray]:
        """Points by page, near ones in neighbouring pages: halves by the line from a point to the one farthest from it."""
        out, todo = [], [np.arange(len(lifted))] if len(lifted) else []
        while todo:
            rows = todo.pop()
            if len(rows) <= PAGE:
                out.append(rows)
                continue
            at = lifted[rows]
            axis = at[((at - at[0]) ** 2).sum(axis=1).argmax()] - at[0]
            half = np.argsort(at @ axis, kind="stable")
            middle = -(-(len(rows) // 2) // PAGE) * PAGE
            todo += [rows[half[middle:]], rows[half[:middle]]]
        return out

    def search(self, vectors: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list, int]:
        """Row of the query, name and score of its k best, and the distances and products computed.

        With `floor`, scores that are under it (-inf for none) needn't be found.
        """
        floor = np.full(len(vectors), -np.inf) if floor is None else floor
        if not len(self.names) or not len(vectors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        with np.errstate(over="ignore"):
            queries = np.floor(self.scale * vectors.astype(np.float64))
        exact = self.bounded and queries.shape[1] * self.largest * float(np.abs(queries).max(initial=0.0)) < 2.0**53
        found, computed = [], 0
        for at in range(0, len(queries), BATCH if exact else 1):
            part = slice(at, at + (BATCH if exact else 1))
            x, name, score, n = self._batch(queries[part], own[part], k, floor[part]) if exact else self._exactly(vectors[at], queries[at], int(own[at]), k, floor[at])
            found.append((x + at, name, score))
            computed += n
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), [s for f in found for s in f[2]], computed

    def _margin(self, length: np.ndarray) -> np.ndarray:
        """More than what rounding can move a bound."""
        return 1e-6 * (1 + np.sqrt(length + self.most))

    def _batch(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, int]:
        """For queries whose products floating-point arithmetic tells exactly."""
        count, computed = len(queries), 0
        q = np.hstack([queries, np.zeros((count, 1))])
        length = (q**2).sum(axis=1)
        margin = self._margin(length)
        best, name = np.full((count, k), -np.inf), np.full((count, k), _NO_NAME)

        def reach(rows: np.ndarray) -> np.ndarray:
            """The distance beyond which nothing can enter what the queries have."""
            worst = np.maximum(best[rows, -1], floor[rows])
            none = np.isneginf(worst)
            return np.where(none, np.inf, np.sqrt(np.maximum(length[rows] + self.most - 2 * np.where(none, 0, worst), 0))) + margin[rows]

        def distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(length[rows, None] + (to**2).sum(axis=1) - 2 * (q[rows] @ to.T), 0))

        top = len(self.levels) - 1
        every = np.arange(count)
        near = distance(every, self.levels[top][1])[:, 0]
        computed += count
        # bound, a number that breaks ties, level, node, queries, their distances to its routing object
        waiting = [(float((near - self.levels[top][2][0]).min()), 0, top, 0, every, near)]
        while waiting:
            _, _, level, node, rows, near = heapq.heappop(waiting)
            start, _, radius, _ = self.levels[level]
            limit = reach(rows)
            alive = near - radius[node] <= limit
            rows, near, limit = rows[alive], near[alive], limit[alive]
            a, b = int(start[node]), int(start[node + 1])
            if not len(rows):
                continue
            if level:
                _, centre, cover, up = self.levels[level - 1]
                may = np.abs(near[:, None] - up[None, a:b]) - cover[None, a:b] <= limit[:, None]
                r, c = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
                if not len(r):
                    continue
                to = distance(rows[r], centre[a:b][c])
                computed += to.size
                bound = to - cover[a:b][c]
                go = may[np.ix_(r, c)] & (bound <= limit[r, None])
                for j in np.flatnonzero(go.any(axis=0)).tolist():
                    mine = go[:, j]
                    heapq.heappush(waiting, (float(bound[mine, j].min()), computed * FAN + j, level - 1, a + int(c[j]), rows[r[mine]], to[mine, j]))
                continue
            may = np.abs(near[:, None] - self.to_page[None, a:b]) <= limit[:, None]
            r, c = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            if not len(r):
                continue
            score = queries[rows[r]] @ self.points[a:b][c].T
            computed += score.size
            names = self.names[a:b][c]
            # equal scores go by name: a tie may enter
            enters = (score >= np.maximum(best[rows[r], -1], floor[rows[r]])[:, None]) & (names[None, :] != own[rows[r]][:, None])
            got = np.flatnonzero(enters.any(axis=1))
            if not len(got):
                continue
            at = rows[r[got]]
            all_score = np.hstack([best[at], np.where(enters[got], score[got], -np.inf)])
            all_name = np.hstack([name[at], np.where(enters[got], names[None, :], _NO_NAME)])
            order = np.lexsort((all_name, -all_score), axis=1)[:, :k]
            best[at], name[at] = np.take_along_axis(all_score, order, axis=1), np.take_along_axis(all_name, order, axis=1)
        x, y = np.nonzero(np.isfinite(best))
        return x, name[x, y], [int(s) for s in best[x, y]], computed

    def _integers(self, vector: np.ndarray) -> list[int]:
        return [int(f) if np.isfinite(f := np.floor(self.scale * v)) else int(v) * self.scale for v in vector.tolist()]

    def _exactly(self, vector: np.ndarray, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, list, int]:
        """For one query, with integers of any size."""
        exact, computed = self._integers(vector), 0
        bounded = self.bounded and bool(np.isfinite((query**2).sum()))
        q = np.append(query, 0.0) if bounded else np.zeros(len(query) + 1)
        length = float((q**2).sum())
        margin = float(self._margin(np.array(length))) if bounded else np.inf
        best: list[tuple[int, int]] = []  # (-score, name)

        def reach() -> float:
            worst = floor if len(best) < k else max(floor, float(max(-(2**1000), min(2**1000, -best[-1][0]))))
            return np.inf if np.isneginf(worst) or not bounded else np.sqrt(max(length + self.most - 2 * worst, 0)) + margin

        top = len(self.levels) - 1
        distance = lambda to: np.sqrt(((to - q) ** 2).sum(axis=-1))
        near = float(distance(self.levels[top][1][0]))
        waiting = [(near - self.levels[top][2][0], top, 0, near)]
        while waiting:
            bound, level, node, near = heapq.heappop(waiting)
            if bound > (limit := reach()):
                break
            a, b = self.levels[level][0][node : node + 2].tolist()
            if level:
                _, centre, cover, up = self.levels[level - 1]
                for child in (a + np.flatnonzero(np.abs(near - up[a:b]) - cover[a:b] <= limit)).tolist():
                    to = float(distance(centre[child]))
                    computed += 1
                    if to - cover[child] <= limit:
                        heapq.heappush(waiting, (to - cover[child], level - 1, child, to))
                continue
            for j in (a + np.flatnonzero(np.abs(near - self.to_page[a:b]) <= limit)).tolist():
                if int(self.names[j]) != own:
                    score = sum(x * y for x, y in zip(exact, self._integers(self.vectors[j]), strict=True))
                    computed += 1
                    insort(best, (-score, int(self.names[j])))
                    del best[k:]
        return np.zeros(len(best), np.int64), np.array([n for _, n in best], np.int64), [-s for s, _ in best], computed


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): vectors with an id and at least one component, all of them finite, as doubles."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"), x.cast("array<double>").alias("x"))


def pivots_of(sample: list[np.ndarray], count: int) -> np.ndarray:
    """Some of the vectors, each as far as can be from those before it."""
    points = np.stack(sample)
    with np.errstate(over="ignore", invalid="ignore"):
        least = np.full(len(points), np.inf)
        chosen = [0]
        for _ in range(1, min(count, len(points))):
            least = np.minimum(least, np.nan_to_num(((points - points[chosen[-1]]) ** 2).sum(axis=1), nan=np.inf))
            if not least.max() > 0:
                break
            chosen.append(int(least.argmax()))
    return points[chosen]


def _dealt(pivots: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the nearest pivot as `cell`, and `salt`, which parts equal rows."""

    @tidied
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            dim = np.asarray(batch.column("dim"))
            cell = np.zeros(len(dim), np.int32)
            for d in np.unique(dim).tolist():
                if d in pivots:
                    mine = np.flatnonzero(dim == d)
                    points = np.asarray(batch.column("x").take(pa.array(mine)).flatten()).reshape(len(mine), d)
                    with np.errstate(over="ignore", invalid="ignore"):
                        away = (pivots[d] ** 2).sum(axis=1)[None, :] - 2 * (points @ pivots[d].T)
                    cell[mine] = np.nan_to_num(away, nan=0.0).argmin(axis=1)
            salt = done + np.arange(len(dim))
            done += len(dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(salt)], names=["vec_id", "dim", "x", "cell", "salt"])

    return deal


FIRST = "dim int, cell int, sub int, tree binary, query_id long, vec_id long, score long, beyond string, floor double, x array<double>"
_FIRST = [x.split(" ")[0] for x in FIRST.split(", ")]
FOUND = "query_id long, vec_id long, score long, beyond string"


def _long(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _beyond(score: int) -> str | None:
    """Of a score that a long can't hold a text that sorts as it does; null for others."""
    if -(2**63) < score < 2**63 - 1:
        return None
    digits = str(abs(score))
    return f"1{len(digits):06d}{digits}" if score > 0 else f"0{999_999 - len(digits):06d}" + "".join(str(9 - int(d)) for d in digits)


def _build(k: int, scale: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A tree, the queries of its part with the k-th of the scores that they found in it, and what they found."""

    def rows(key: tuple, n: int, **values: object) -> pd.DataFrame:
        whole = {c: pd.array(values.get(c, [None] * n), "Int64") for c in ("query_id", "vec_id", "score")}
        other = {c: pd.Series(list(values.get(c, [None] * n)), dtype=object) for c in ("tree", "x", "beyond")}
        at = {c: np.full(n, v, np.int32) for c, v in zip(("dim", "cell", "sub"), key, strict=True)}
        return pd.DataFrame(at | whole | other | {"floor": values.get("floor", np.full(n, np.nan))})[_FIRST]

    def build(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [rows(key, 0)]
        floor, own = np.full(len(asked), -np.inf), asked["q_id"].to_numpy()
        if len(points):
            tree = MTree(np.stack(points["x"]), points["vec_id"].to_numpy(), scale)
            out.append(rows(key, 1, tree=[pickle.dumps(tree)]))
            if len(asked):
                x, name, score, _ = tree.search(np.stack(asked["q"]), own, k)
                out.append(rows(key, len(x), query_id=own[x], vec_id=name, score=[_long(s) for s in score], beyond=[_beyond(s) for s in score]))
                full = np.flatnonzero(np.bincount(x, minlength=len(asked)) == k)
                for q, j in zip(full.tolist(), (np.searchsorted(x, full, side="right") - 1).tolist(), strict=True):
                    last = float(_long(score[j]))
                    if last > -(2.0**62):  # rounded down, so that no tie is lost
                        floor[q] = last if abs(last) < 2.0**53 else np.nextafter(last, -np.inf)
        if len(asked):
            out.append(rows(key, len(asked), query_id=own, floor=floor, x=asked["q"]))
        return pd.concat(out, ignore_index=True)

    return build


def _probe(folder: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Searches each tree for all queries of other trees, which are read block by block."""

    @tidied
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))
        for dim, cell, sub, packed in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            tree: MTree = pickle.loads(packed)
            for file in files:
                for block in pq.ParquetFile(fs.open_input_file(file)).iter_batches(BLOCK):
                    d, c, s = (np.asarray(block.column(n)) for n in ("dim", "cell", "sub"))
                    mine = np.flatnonzero((d == dim) & ((c != cell) | (s != sub)))
                    if not len(mine):
                        continue
                    rows = block.take(pa.array(mine))
                    queries = np.asarray(rows.column("x").combine_chunks().flatten() if isinstance(rows.column("x"), pa.ChunkedArray) else rows.column("x").flatten()).reshape(len(mine), dim)
                    own = np.asarray(rows.column("query_id"))
                    x, name, score, _ = tree.search(queries, own, k, np.asarray(rows.column("floor")))
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(own[x]), pa.array(name, pa.int64()), pa.array([_long(v) for v in score], pa.int64()), pa.array([_beyond(v) for v in score], pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    return probe


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k others of largest integer inner product.

    A component x counts as floor(scale * x).  Vectors that are null or empty, have no id, or hold a null or
    a component that isn't finite take no part; all other columns are ignored.  Ties go to the smaller id.
    A query's own row is no candidate, nor are rows that repeat its id; other repeated rows count each.
    Vectors of other lengths than the query's are no candidates.  Scores are exact; one that a long can't
    hold is told as the nearest long.  An empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    total = rows.count()
    spread = max(SMALL_TREE, -(-total // (2 * partitions_of(spark))))
    share = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample: dict[int, list[np.ndarray]] = {}
    for r in rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < share).limit(2 * SAMPLE).collect():  # as many vectors at most
        sample.setdefault(r["dim"], []).append(np.array(r["x"]))
    held = sum(map(len, sample.values()))
    fits = lambda d: max(1, min(TREE, spread, TREE_BYTES // (8 * d)))
    pivots = {d: pivots_of(x, min(PIVOTS, -(-total * len(x) // held // fits(d)))) for d, x in sample.items()}
    cells = written(rows.mapInArrow(_dealt(pivots), "vec_id long, dim int, x array<double>, cell int, salt long"), "cells")

    most = F.greatest(F.lit(1), F.least(F.lit(TREE), F.lit(spread), F.floor(F.lit(TREE_BYTES) / (8 * F.col("dim")))))
    counts = cells.groupBy("dim", "cell").agg(F.count("*").alias("c"))
    counts = written(counts.withColumn("trees", F.ceil(F.col("c") / most).cast("int")), "counts")
    placed = unskewed(cells, counts, ["dim", "cell"])
    sub = lambda *of: F.pmod(F.xxhash64(*of), F.col("trees")).cast("int").alias("sub")
    points = placed.select("dim", "cell", sub("vec_id", "salt"), "vec_id", "x")
    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("dim", "cell", sub("vec_id"), "vec_id", "x").distinct()
    asked = asked.toDF("q_dim", "q_cell", "q_sub", "q_id", "q")
    key = ["dim", "cell", "sub"]
    first = points.groupBy(*key).cogroup(asked.groupBy("q_dim", "q_cell", "q_sub")).applyInPandas(_build(k, scale), FIRST)
    first = written(first, "first")
    found = first.where("score is not null").select("query_id", "vec_id", "score", "beyond")

    trees = first.where("tree is not null").select(*key, "tree")
    count = trees.count()
    if count > 1:
        folder = fresh_path(spark, "queries")
        first.where("x is not null").select(*key, "query_id", "floor", "x").write.parquet(folder)
        found = found.unionByName(trees.repartition(count, *key).mapInArrow(_probe(folder, k), FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
