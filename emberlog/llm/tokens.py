"""Tokenizing whole texts with a cache of chunks, flat token files, and counting tokens in them."""

from __future__ import annotations

import os
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import fresh_path, ranges, sliced, tidied, words_of, written

#: Distinct chunks, and bytes of them, that a Python worker remembers.
CACHED_CHUNKS, CACHED_BYTES = 400_000, 16 << 20
_STOPS = frozenset(".,;:!?")


class _Index(dict):
    """Numbers every new key and keeps the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        self.fresh.append(key)
        self[key] = number = len(self)
        return number


class ChunkCache:
    """Ids of texts from ids of their chunks.  `encode` maps new chunks to (flat ids, number of ids of each)."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.index, self.bytes = _Index(), 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends, self.count = np.zeros(1 << 14, np.int64), 0

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        if not fresh:
            return
        ids, sizes = self.encode(fresh)
        self.bytes += sum(map(len, fresh))
        used = int(self.ends[self.count - 1]) if self.count else 0
        while used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.count + len(fresh) > len(self.ends):
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        self.flat[used : used + len(ids)] = ids
        self.ends[self.count : self.count + len(fresh)] = used + np.cumsum(sizes)
        self.count += len(fresh)

    def ids(self, chunks: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts as lists of chunks: all ids, and the ids of each text."""
        each = np.fromiter(map(len, chunks), np.int64, len(chunks))
        return self._gathered(chain.from_iterable(chunks), int(each.sum()), None, each)

    def listed(self, chunks: list, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of all chunks in one list, and the chunks of each text."""
        return self._gathered(iter(chunks), len(chunks), None, each)

    def coded(self, number: np.ndarray, distinct: list, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks given by number among the distinct ones, and the chunks of each text."""
        return self._gathered(iter(distinct), len(distinct), number, each)

    def _gathered(self, keys: Iterator, count: int, number: np.ndarray | None, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHED_CHUNKS or self.bytes > CACHED_BYTES:
            self.clear()
        known = np.fromiter(map(self.index.__getitem__, keys), np.int64, count)
        self._learn()
        number = known if number is None else known[number]
        ends = self.ends[: self.count]
        begins = np.append(0, ends[:-1])[: self.count]
        sizes = (ends - begins)[number]
        flat = self.flat[ranges(begins[number], sizes)]
        total = np.append(0, np.cumsum(sizes))
        return flat, np.diff(total[np.append(0, np.cumsum(each))])


class WordTokenizer:
    """Texts to ids exactly as a tokenizers file does that drops white space, by chunks between ASCII white space.

    No token of such a tokenizer reaches over white space, nor from a letter or digit to a stop behind it,
    so the ids of a text are those of such chunks.  New chunks are encoded many at a time: words of
    letters alone between spaces, as their last id tells where a word ends, others between special tokens.
    """

    def __init__(self, path: str, specials_are_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # words that are lower case and composed already need the merges alone
        self.light = Tokenizer(self.tokenizer.model)
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between = self.specials[0]
        self.between_id = self.tokenizer.token_to_id(self.between)
        self.plain = None
        if specials_are_text:
            self.plain = Tokenizer.from_file(path)
            self.plain.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = ChunkCache(self._encode)
        self.cache = ChunkCache(self._parted)

    def forget(self) -> None:
        """Drops what was learned; done after each task, as idle workers stay in memory."""
        self.cache.clear()
        self.words.clear()

    def _parted(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, a stop behind a letter or digit apart."""
        parts: list[str] = []
        count = np.ones(len(chunks), np.int64)
        for k, c in enumerate(chunks):
            if c[-1:] in _STOPS and (before := c[-2:-1]).isalnum() and before.isascii():
                parts.append(c[:-1])
                parts.append(c[-1])
                count[k] = 2
            else:
                parts.append(c)
        return self.words.listed(parts, count)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain: list[int] = []
        rest: list[int] = []
        marked: list[int] = []
        for k, t in enumerate(texts):
            if t.isalpha() and t == t.lower() and (t.isascii() or unicodedata.is_normalized("NFC", t)):
                plain.append(k)
            elif t:
                (marked if "<" in t and any(m in t for m in self.specials) else rest).append(k)
        sizes = np.zeros(len(texts), np.int64)
        found: list[tuple[list[int], np.ndarray]] = []
        if plain:
            ids = self._joined(self.light, [texts[k] for k in plain], " ")
            sizes[plain] = np.diff(np.append(-1, np.flatnonzero(self.ends_word[ids])))
            found.append((plain, ids))
        if rest:
            ids = self._joined(self.tokenizer, [texts[k] for k in rest], f" {self.between} ")
            cut = np.flatnonzero(ids == self.between_id)
            sizes[rest] = np.diff(np.append(-1, cut)) - 1
            found.append((rest, np.delete(ids, cut)))
        for k in marked:
            ids = np.array((self.plain or self.tokenizer).encode(texts[k], add_special_tokens=False).ids, np.uint32)
            sizes[k] = len(ids)
            found.append(([k], ids))
        flat = np.zeros(int(sizes.sum()), np.uint32)
        begin = np.cumsum(sizes) - sizes
        for rows, ids in found:
            flat[ranges(begin[rows], sizes[rows])] = ids
        return flat, sizes

    def _joined(self, tokenizer, texts: list[str], between: str) -> np.ndarray:
        out = [np.zeros(0, np.uint32)]
        for k in range(0, len(texts), 500):
            got = tokenizer.encode_batch_fast([between.join([*texts[k : k + 500], ""])], add_special_tokens=False)
            out.append(np.array(got[0].ids, np.uint32))
        return np.concatenate(out)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # letters are lower-cased anyway, but a special token is only one as it stands
        lower = not pc.any(pc.match_substring(texts.fill_null(""), "<|")).as_py()
        return self.cache.coded(*words_of(texts, lower))


@lru_cache(maxsize=2)
def word_tokenizer(path: str, specials_are_text: bool = False) -> WordTokenizer:
    """One for a Python worker; reading the file takes longer than a small task."""
    return WordTokenizer(path, specials_are_text)


def with_end(flat: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end_id` behind each text."""
    out = np.full(len(flat) + len(sizes), end_id, np.uint32)
    total = np.cumsum(sizes)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
    assert len(sizes) == 0 or total[-1] == len(flat)
    return out, sizes + 1


# ---------------------------------------------------------------- flat token files

FILE = "file string, position long, doc_id long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Writes one flat file of little-endian ids for each partition, `end_id` behind every document, and nothing else.

    Returns the order of the documents, (file, position, doc_id), for those who want it; the files hold
    no index.  A file is written under another name and renamed, so a task that is run again replaces
    whole files.  Texts may hold the tokenizer's special strings; they are text, never separators.
    """

    @tidied

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer, specials_are_text=True)
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        part = f"{path}/_{name}.{uuid.uuid4().hex}"
        position, out = 0, None
        for batch in sliced(batches, "text"):
            ids, _ = with_end(*encode(batch.column(1)), end_id)
            out = out or fs.open_output_stream(part)
            out.write(ids.astype(f"<u{width}").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(position, position + n)), batch.column(0).cast(pa.int64())], names=["file", "position", "doc_id"])
            position += n
        encode.forget()
        if out:
            out.close()
            fs.move(part, f"{path}/{name}")

    return written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(write, FILE), "order")


def token_files(folder: str) -> list[tuple[str, int]]:
    """Names and sizes of the files of a folder."""
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return []
    return sorted((f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """(file, position, start, n_tokens, ended) of every document in the flat files of a folder.

    A separator scan: each block of a file is read and searched for `end_id` on its own, whatever the
    file's size.  A block tells its separators, the ids before the first and behind the last; a prefix
    scan over these summaries gives each block the number of its first document and the ids that the
    blocks before it hold of that document.  n_tokens doesn't count the separator.  Ids behind the last
    separator of a file are a document with ended false; two separators in a row hold an empty one.
    """
    block_ids = block_bytes // width
    files = spark.createDataFrame(token_files(folder) or [("", 0)], "file string, size long").where("size > 0")
    blocks = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") / width - 1) / block_ids))).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    @tidied

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['file']}") as source:
                    source.seek(row["block"] * block_bytes)
                    ids = np.frombuffer(source.read(min(block_bytes, row["size"] - row["block"] * block_bytes)), f"<u{width}")
                at = np.flatnonzero(ids == end_id).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": [row["file"]],
                        "block": pa.array([row["block"]], pa.int64()),
                        "last": [(row["block"] + 1) * block_bytes >= row["size"]],
                        "ids": pa.array([len(ids)], pa.int64()),
                        "ends": pa.array([at], pa.list_(pa.int64())),
                    }
                )

    # the positions of the separators are two bytes a document each; they are kept, the blocks are read once
    scanned = written(blocks.mapInArrow(scan, "file string, block long, last boolean, ids long, ends array<long>"), "separators")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    block_start = F.col("block") * block_ids
    summary = scanned.select("file", "block", "last", "ids", F.size("ends").alias("n"), F.element_at("ends", F.when(F.size("ends") > 0, -1)).alias("tail"))
    stitched = summary.select(
        "file", "block", "last", "ids",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.last(block_start + F.col("tail"), ignorenulls=True).over(before), F.lit(-1)).alias("ended_at"),
    )
    joined = scanned.select("file", "block", "ends").join(stitched, ["file", "block"])
    absolute = F.transform("ends", lambda x: x + block_start)
    # an open end of the file counts as one more end behind the last id
    is_open = F.col("last") & (F.coalesce(F.element_at(absolute, F.when(F.size("ends") > 0, -1)), F.col("ended_at")) < block_start + F.col("ids") - 1)
    ends = F.when(is_open, F.concat(absolute, F.array(block_start + F.col("ids")))).otherwise(absolute)
    starts = F.concat(F.array(F.col("ended_at")), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    rows = joined.where((F.size("ends") > 0) | is_open).select("file", "first", F.size("ends").alias("closed"), F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("k", "x"))
    return rows.select("file", (F.col("first") + F.col("k")).alias("position"), (F.col("x.s") + 1).alias("start"), (F.col("x.e") - F.col("x.s") - 1).alias("n_tokens"), (F.col("k") < F.col("closed")).alias("ended"))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Tokens of each document: writes flat files, counts by separator scan, and names the documents again.

    A null or empty text has no token; repeated rows are counted each; an empty table gives none.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    order = write_token_files(docs, folder, tokenizer, end_id, id_col, text_col, width)
    counts = count_tokens(spark, folder, end_id, width)
    return order.join(counts, ["file", "position"]).select("doc_id", "n_tokens", "file", "position", "start")
