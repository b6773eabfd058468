"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each text starts as its characters.  An agenda holds the adjacent pairs of symbols whose join is a
piece, ordered by score and then by place; the best pair is merged, its neighbours get new pairs, until
the agenda is empty.  No piece of such a vocabulary has a space mark behind another character, nor a
line end, so merges never cross those places: texts are cut there and every distinct chunk is encoded
once per worker.  New chunks of like length share a table in which every row is the agenda of one chunk
and every step takes the best pair of all rows; long chunks use a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ranges, sliced, tidied
from emberlog.llm.tokens import ChunkCache

MARK = "▁"
_NONE = np.int32(2**31 - 1)
#: Chunks longer than this are merged with a heap each.
LONG = 48


class MergeVocabulary:
    """Pieces, scores and special ids of a sentencepiece BPE model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(count)]
        self.byte_id = {}
        mergeable = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                mergeable[piece] = i
        self.unknown = sp.unk_id()
        # characters have ids; those without a piece of their own get ids behind all pieces
        self.char = {p: i for p, i in mergeable.items() if len(p) == 1}
        for c in sorted({c for p in mergeable for c in p}):
            self.char.setdefault(c, len(self.pieces) + len(self.char))
        symbol = mergeable | self.char
        scores = sorted({sp.get_score(i) for i in mergeable.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        pairs = {}
        for piece, i in mergeable.items():
            for k in range(1, len(piece)):
                if piece[:k] in symbol and piece[k:] in symbol:
                    pairs[symbol[piece[:k]] << 32 | symbol[piece[k:]]] = (place[sp.get_score(i)], i)
        self.pairs = pairs
        keys = sorted(pairs)
        self.key = np.array([*keys, 2**62], np.int64)
        self.priority = np.array([*(pairs[k][0] for k in keys), _NONE], np.int32)
        self.merged = np.array([*(pairs[k][1] for k in keys), -1], np.int32)
        self.mark_leads = all(MARK not in p.lstrip(MARK) for p in mergeable)
        self.line_ends_alone = all("\n" not in p for p in mergeable)
        table = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            table[ord(c)] = i
        self.table = table

    @cached_property
    def chunk(self) -> re.Pattern:
        """Chunks of a text in which spaces stand for marks."""
        if not self.mark_leads:
            return re.compile(r"(?s).+")
        return re.compile(" +[^ \n]*|\n|[^ \n]+" if self.line_ends_alone else "(?s) +[^ ]*|[^ ]+")

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Priority and result of joining symbols; symbols below 0 join with nothing."""
        key = (left.astype(np.int64) << np.int64(32)) | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.key, key)
        hit = self.key[at] == key
        return np.where(hit, self.priority[at], _NONE), np.where(hit, self.merged[at], -1)


def merge_table(v: MergeVocabulary, symbols: np.ndarray) -> np.ndarray:
    """Symbols of many chunks, one row each and -1 behind the end: merged until no agenda has a pair left."""
    symbols = symbols.copy()
    done = np.full(symbols.shape, -1, np.int32)
    live = np.arange(len(symbols))
    priority, result = v.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
    shape = (symbols.shape[0], symbols.shape[1] - 1)
    agenda, result = priority.reshape(shape), result.reshape(shape)
    column = np.arange(symbols.shape[1])
    while len(live):
        best = agenda.argmin(axis=1) if agenda.shape[1] else np.zeros(len(live), np.int64)
        row = np.arange(len(live))
        go = (agenda[row, best] != _NONE) if agenda.shape[1] else np.zeros(len(live), bool)
        if not go.all():
            out = ~go
            done[live[out], : symbols.shape[1]] = symbols[out]
            live, symbols, agenda, result, best = live[go], symbols[go], agenda[go], result[go], best[go]
            if not len(live):
                break
            row = np.arange(len(live))
        joined = result[row, best]
        # the right symbol goes and everything behind moves up
        symbols = np.where(column[None, :-1] <= best[:, None], symbols[:, :-1], symbols[:, 1:])
        symbols[row, best] = joined
        agenda = np.where(column[None, : agenda.shape[1] - 1] < best[:, None], agenda[:, :-1], agenda[:, 1:])
        result = np.where(column[None, : result.shape[1] - 1] < best[:, None], result[:, :-1], result[:, 1:])
        column = column[:-1]
        if agenda.shape[1]:
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < agenda.shape[1]))
                agenda[ok, at[ok]], result[ok, at[ok]] = v.look_up(symbols[ok, at[ok]], symbols[ok, at[ok] + 1])
    return done


def merge_heap(v: MergeVocabulary, symbols: list[int]) -> list[int]:
    """The same for one long chunk, with a heap of (priority, place)."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and symbols[i] >= 0 and symbols[j] >= 0 and (got := v.pairs.get(symbols[i] << 32 | symbols[j])):
            heapq.heappush(agenda, (got[0], i, symbols[i], symbols[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    gone = [False] * n
    while agenda:
        _, i, left, right = heapq.heappop(agenda)
        j = after[i] if not gone[i] else n
        if gone[i] or j >= n or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i] = v.pairs[left << 32 | right][1]
        gone[j] = True
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s, out in zip(symbols, gone, strict=True) if not out]


class Codec:
    """Encodes and decodes texts in lots."""

    def __init__(self, path: str) -> None:
        self.v = MergeVocabulary(path)
        self.cache = ChunkCache(self._encode)
        size = len(self.v.pieces)
        raw = [p.replace(MARK, " ").encode() for p in self.v.pieces]
        for b, i in self.v.byte_id.items():
            raw[i] = bytes([b])
        for i in range(size):
            if self.v.library.is_control(i):
                raw[i] = b""
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def _spell(self, symbol: int, char: str) -> list[int]:
        """A symbol as ids; a character without a piece becomes its bytes."""
        if 0 <= symbol < len(self.v.pieces):
            return [symbol]
        found = [self.v.byte_id.get(b, -1) for b in char.encode()]
        return [self.v.unknown] if -1 in found else found

    def _slow(self, chunk: str) -> list[int]:
        """Chunks that are long or hold characters without a piece: cut at those, which join with nothing."""
        symbols = [int(self.v.table[ord(c)]) for c in chunk]
        merged = merge_heap(self.v, list(symbols))
        out, at = [], 0
        for s in merged:
            char = chunk[at] if not 0 <= s < len(self.v.pieces) else ""
            out += self._spell(s, char)
            at += 1 if char else len(self.v.pieces[s])
        return out

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chunks = [c.replace(" ", MARK) for c in chunks]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.v.table[points]
        begins = np.cumsum(sizes) - sizes
        odd = np.logical_or.reduceat((symbols < 0) | (symbols >= len(self.v.pieces)), begins) | (sizes > LONG)
        counts = np.zeros(len(chunks), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(odd):
            ids = np.array(self._slow(chunks[k]), np.uint32)
            counts[k] = len(ids)
            found.append((np.array([k]), ids))
        for low, high in ((0, 4), (4, 7), (7, 10), (10, 14), (14, 20), (20, 32), (32, LONG)):
            for lot in np.array_split(mine := np.flatnonzero(~odd & (sizes > low) & (sizes <= high)), len(mine) // 20000 + 1):
                if not len(lot):
                    continue
                wide = int(sizes[lot].max())
                grid = np.full((len(lot), wide), -1, np.int32)
                inside = np.arange(wide)[None, :] < sizes[lot][:, None]
                grid[inside] = symbols[ranges(begins[lot], sizes[lot])]
                done = merge_table(self.v, grid)
                used = done >= 0
                counts[lot] = used.sum(axis=1)
                found.append((lot, done[used].astype(np.uint32)))
        flat = np.zeros(int(counts.sum()), np.uint32)
        begin = np.cumsum(counts) - counts
        for lot, ids in found:
            flat[ranges(begin[lot], counts[lot])] = ids
        return flat, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids without begin and end, and the ids of each text."""
        find = self.v.chunk.findall
        return self.cache.ids([find(" " + t.replace(MARK, " ")) if t else [] for t in texts])

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts of ids in UTF-8, without the space that encoding puts in front."""
        each = self.raw_size[flat]
        body = self.raw[ranges(self.raw_start[flat], each)].tobytes()
        ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(sizes))].tolist()
        return [body[a + (body[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def verify(library, names: pa.Array, texts: list[str], flat: np.ndarray, sizes: np.ndarray, decoded: list[bytes]) -> None:
    """ValueError if the library gives any text other ids, or these ids, with begin and end, another text."""
    theirs = library.encode(texts, add_bos=True, add_eos=True, out_type="numpy", num_threads=1)
    spelled = library.decode(theirs, num_threads=1)
    ends = np.append(0, np.cumsum(sizes)).tolist()
    ours = flat.astype(np.int32)
    for k, (ids, text) in enumerate(zip(theirs, spelled, strict=True)):
        if ids[1:-1].tobytes() != ours[ends[k] : ends[k + 1]].tobytes() or text.encode() != decoded[k]:
            raise ValueError(f"ids or text of document {names[k]} differ from the library's")


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One for a Python worker; its tables take longer to make than a small task."""
    return Codec(path)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def piece_codes(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; with `keep` also ids and decoded.

    ids hold begin and end.  Every text is also encoded, and its ids decoded, by the sentencepiece library;
    a difference raises ValueError.  A null text is empty; repeated rows give repeated rows, other columns
    are not returned, and an empty table gives no row.
    """

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        sp = codec.v.library
        for batch in sliced(batches, "text", 1 << 20):
            texts = batch.column(1).fill_null("").to_pylist()
            flat, sizes = codec.encode(texts)
            decoded = codec.decode(flat, sizes)
            verify(sp, batch.column(0), texts, flat, sizes, decoded)
            ends = np.append(0, np.cumsum(sizes)).tolist()
            begin, end = np.array([sp.bos_id()], "<u4").tobytes(), np.array([sp.eos_id()], "<u4").tobytes()
            ids = [begin + flat[a:b].astype("<u4").tobytes() + end for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [
                batch.column(0).cast(pa.int64()), pa.array(sizes + 2), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for x in decoded])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        codec.cache.clear()

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, DIGEST + (", ids array<int>, decoded string" if keep else ""))
