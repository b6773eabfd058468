"""SpotSigs fingerprints.

A signature is a common word (an anchor) and the next `CHAIN` content words behind it; the set of a
text's signatures is its fingerprint, which follows the prose and not what surrounds it.  Sets are
compared by Jaccard likeness; sets whose sizes alone keep them under the asked likeness are not compared.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import buffers, mix64, partitions_of, ranges, sliced, tidied, words_of, written
from emberlog.llm.minhash import Buckets, linked
from emberlog.llm.tokens import _Index

CHAIN = 2
#: Blocks a partition, and sampled rows a block (and in all) from which their splits are chosen.
BLOCKS, SAMPLE, MOST_SAMPLED = 12, 20, 1 << 20
#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an the and or of to in on for is are was were be been it that this with as by at from but not he she they you we have has had "
    "der die das ein eine und oder zu im ist sind war den dem des mit auf für von nicht es er sie wir ihr als auch an aus bei "
    "le la les un une des et ou du de est sont dans en que qui pour par pas il elle nous vous ce sur au aux plus "
    "el los las una y o del con se por para su lo como más al".split()
)


class Spotter:
    """Sets of 32-bit signature hashes of texts."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.index, self.bytes = _Index(), 0
        self.word, self.kind = np.zeros(0, np.uint64), np.zeros(0, np.int8)  # kinds: 0 no word, 1 content, 2 anchor

    def _learn(self) -> None:
        import xxhash

        fresh, self.index.fresh = self.index.fresh, []
        word, kind = np.zeros(len(fresh), np.uint64), np.zeros(len(fresh), np.int8)
        for k, text in enumerate(fresh):
            text = text.lower()
            a, b = 0, len(text)
            while a < b and not text[a].isalnum():
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if a < b:
                word[k] = xxhash.xxh64_intdigest(text[a:b].encode())
                kind[k] = 2 if text[a:b] in ANCHORS else 1
        self.word, self.kind = np.append(self.word, word), np.append(self.kind, kind)
        self.bytes += sum(map(len, fresh))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All signatures, ordered and distinct within each text, and the size of each set."""
        if len(self.index) > 400_000 or self.bytes > 16 << 20:
            self._clear()
        number, distinct, n = words_of(texts)
        number = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[number]
        self._learn()
        doc, kind = np.repeat(np.arange(len(n)), n), self.kind[number]
        number, doc, kind = number[kind > 0], doc[kind > 0], kind[kind > 0]
        word = self.word[number]
        content = np.flatnonzero(kind == 1)
        anchor = np.flatnonzero(kind == 2)
        follow = np.searchsorted(content, anchor)
        whole = follow + CHAIN <= len(content)
        whole[whole] &= doc[content[follow[whole] + CHAIN - 1]] == doc[anchor[whole]]
        anchor, follow = anchor[whole], follow[whole]
        h = mix64(word[anchor])
        for k in range(CHAIN):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word[content[follow + k]])
        of = doc[anchor]
        # a text without a chain is the set of its words, one without words is itself
        bare = np.bincount(of, minlength=len(n)) == 0
        alone = np.flatnonzero(bare[doc]) if len(doc) else np.zeros(0, np.int64)
        none = np.flatnonzero(bare & (np.bincount(doc, minlength=len(n)) == 0) & (np.diff(buffers(texts)[1]) > 0))
        own = np.array([int.from_bytes(hashlib.sha256(texts[int(k)].as_py().encode()).digest()[:8], "little") for k in none], np.uint64)
        h = np.concatenate([h, mix64(word[alone] + np.uint64(1)), own]) >> np.uint64(32)
        of = np.concatenate([of, doc[alone], none])
        order = np.lexsort((h, of))
        h, of = h[order].astype(np.uint32), of[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        return h[keep], np.bincount(of[keep], minlength=len(n)).astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> np.ndarray:
    """Jaccard likeness of the k-th sets of both; 0 where the sizes keep it under `least`.  Two empty sets are alike."""
    (x, m), (y, n) = a, b
    out = np.zeros(len(m))
    big, small = np.maximum(m, n), np.minimum(m, n)
    compared = np.flatnonzero((small >= least * big) & (small > 0))
    left = x[ranges((np.cumsum(m) - m)[compared], m[compared])]
    right = y[ranges((np.cumsum(n) - n)[compared], n[compared])]
    of = np.concatenate([np.repeat(compared, m[compared]), np.repeat(compared, n[compared])]).astype(np.uint64)
    key = np.sort((of << np.uint64(32)) | np.concatenate([left, right]).astype(np.uint64))
    common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(m))
    out[compared] = common[compared] / (m + n - common)[compared]
    out[big == 0] = 1.0
    return out


def length_parts(similar: int, most: int = 1 << 31) -> np.ndarray:
    """Where the partitions of set lengths begin: sets that can be similar lie in one partition or in two neighbours."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // similar + 1)
    return np.array(out)


def spot_buckets(similar: int) -> Buckets:
    """Buckets of signature sets: for two sets that are similar enough, the first few signatures of both, by hash, share one.

    A bucket is a signature in a length partition; a set is in those of its own partition and of the next.
    """
    parts = length_parts(similar)

    def buckets(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        few = np.where(sizes > 0, sizes - -(-sizes * similar // 100) + 1, 0)
        first = sets[ranges(np.cumsum(sizes) - sizes, few)].astype(np.uint64)
        part = np.repeat(np.searchsorted(parts, sizes, side="right"), few).astype(np.uint64)
        keys = np.stack([mix64(first * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k)) for k in (0, 1)], axis=1)
        return keys.ravel(), 2 * few

    return buckets


def spot_duplicates(docs: DataFrame, similar: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_items, component_id, kept): near-duplicates by SpotSigs.

    Documents whose signature sets are similar to `similar` per cent are linked; candidates meet in
    buckets of length partitions, sizes prune pairs before their sets are compared.  Nulls, empty texts,
    ties and repeats are treated as by `minhash.near_duplicates`.
    """

    def maker():
        spotter = Spotter()

        def make(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            sets, sizes = spotter(texts.fill_null(""))
            return sets.astype(np.uint64), sizes

        return make

    return linked(docs, maker, similar, id_col, text_col, spot_buckets(similar))


def _printed(sets: tuple[np.ndarray, np.ndarray]) -> list[str]:
    ends = np.append(0, np.cumsum(sets[1])).tolist()
    return [base64.b64encode(sets[0][a:b].astype("<u4").tobytes()).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _levels(splits: list, fan: int = 64) -> list[list]:
    """The splits as a tree of at most `fan` a list: each level tells which list of the next one to look at."""
    levels = [splits]
    while len(levels[0]) > fan:
        levels.insert(0, levels[0][fan - 1 :: fan])
    return levels


def block_of(key: Column, splits: list[tuple[int, int]], kind: str, fan: int = 64) -> Column:
    """How many of the sorted splits are not above the key, with `fan` comparisons a level."""
    at = F.lit(0)
    for level in _levels(splits, fan):
        groups = [level[k : k + fan] for k in range(0, len(level), fan)] or [[]]
        lists = F.from_json(F.lit(json.dumps([[{"a": x, "b": y} for x, y in g] for g in groups])), f"array<array<{kind}>>")
        # a key behind the last split of a level has a list of its own in the next one, which may be empty
        here = F.coalesce(F.get(lists, at.cast("int")), F.from_json(F.lit("[]"), f"array<{kind}>"))
        at = at * fan + F.size(F.filter(here, lambda x: x <= key))
    return at


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    The last third of the characters is replaced by the first as many of the next document by falling
    id (after the last: the first; a null id is last; equal ids by the hash of the text).  A null text
    is empty.  Repeated rows follow each other.  Documents are dealt into blocks that follow each other in this order,
    whose splits come from a sample of ids and hashes; the first rows of each block are also sent to the block
    before it, so texts are shuffled once.  Other columns are not returned.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # falling ids are rising ones of their bits turned round
    turned = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))))
    rows = docs.select(turned.alias("turned"), F.xxhash64(text).alias("th"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    ids = written(rows.select("turned", "th"), "ids")
    blocks = BLOCKS * partitions_of(spark)
    wanted = min(SAMPLE * blocks, MOST_SAMPLED)
    share = min(1.0, wanted / max(ids.count(), 1))
    sample = sorted(tuple(r) for r in ids.where(F.pmod(F.xxhash64("th", "turned"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().limit(2 * wanted).collect())
    splits = sorted({sample[len(sample) * k // blocks] for k in range(1, blocks)}) if sample else []
    kind = "struct<a:bigint,b:bigint>"
    block = block_of(F.struct(F.col("turned").alias("a"), F.col("th").alias("b")), splits, kind)
    heads = ids.groupBy(block.alias("block")).agg(F.min(F.struct("turned", "th")).alias("head")).orderBy("block").collect()  # a row a block
    before = [(*r["head"], heads[k - 1]["block"]) for k, r in enumerate(heads)]
    first = spark.createDataFrame(before or [(0, 0, 0)], "turned long, th long, before long")
    rows = rows.join(F.broadcast(first), ["turned", "th"], "left").withColumn("own", block)  # as many rows as blocks
    place = lambda at, head: F.struct(F.col(at).cast("long").alias("block"), F.lit(head).alias("head"))
    places = F.when(F.col("before").isNull(), F.array(place("own", False))).otherwise(F.array(place("own", False), place("before", True)))
    dealt = rows.select("turned", "th", "doc_id", "text", F.explode(places).alias("p")).select("p.block", "p.head", F.col("turned").alias("did"), "th", "doc_id", "text")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "head", "did", "th")

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter()
        held: list[tuple] = []  # the last row, which waits for its next
        for batch in sliced(batches, "text", 2 << 20):
            rows = held + list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5)), strict=True))
            held = rows[-1:]
            of = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            if not of:
                continue
            need = sorted({*of, *(k + 1 for k in of)})
            place = {k: p for p, k in enumerate(need)}
            edited = []
            for k in of:
                text, third = rows[k][3], len(rows[k][3]) // 3
                edited.append(text[: len(text) - third] + rows[k + 1][3][:third])
            sets = spotter(pa.array([rows[k][3] for k in need], pa.large_string()))
            mine = _take(sets, np.array([place[k] for k in of]))
            after = _take(sets, np.array([place[k + 1] for k in of]))
            other = spotter(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][2] for k in of], pa.int64()), pa.array([len(rows[k][3]) for k in of], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(_printed(mine)), pa.array(_printed(other)),
                    pa.array(likeness(mine, other)), pa.array(likeness(mine, after)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.mapInArrow(run, PRINTS)


def _take(sets: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.cumsum(sets[1]) - sets[1]
    return sets[0][ranges(begin[at], sets[1][at])], sets[1][at]
