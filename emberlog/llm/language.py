"""Language identification of mixed-language text.

Words are runs of letters.  The script of a word narrows its candidates to the languages that were
seen in that script; their scores are log probabilities of the word's character n-grams.  Viterbi over
the words of a text, with a penalty for switching, labels spans; the text's language is the one with
most letters.  The model is a table of `BUCKETS` n-gram classes for each language, counted over a
bounded sample of labelled rows (`sample_docs`), so its size doesn't depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import coded, mix64, ranges, sliced, tidied
from emberlog.llm.tokens import _Index

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
SWITCH = 9.0
NO_LETTERS = r"[^\pL]+"
#: First code points of blocks of letters, and their script.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1900, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"),
    (0x2C80, "other"), (0x2DE0, "Cyrillic"), (0x2E00, "other"), (0x3005, "Han"), (0x3040, "Kana"), (0x3100, "other"),
    (0x3130, "Hangul"), (0x3190, "other"), (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xA640, "Cyrillic"), (0xA6A0, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAB30, "Latin"), (0xAC00, "Hangul"),
    (0xD800, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"), (0x32000, "other"),
)
_SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS] + [SCRIPT_NAMES.index("other")])


def letters_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Runs of letters in lower case: their numbers among the distinct ones, these, and how many each text has."""
    return coded(pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), NO_LETTERS))


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words between marks, row by row, their sizes with marks, and the script of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(sizes) - sizes + 1
    script = _SCRIPT_OF[np.searchsorted(_SCRIPT_STARTS, points[first], side="right") - 1]
    return points, sizes, script


def gram_buckets(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all n-grams, and the word of each."""
    out, of = [], []
    begin = np.cumsum(sizes) - sizes
    h = np.full(len(points), 0x1234567, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(points) - n + 1]
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :].astype(np.uint64) + np.uint64(n))
        if n in GRAMS:
            count = np.maximum(sizes - n + 1, 0)
            out.append((h[ranges(begin, count)] % np.uint64(BUCKETS)).astype(np.int64))
            of.append(np.repeat(np.arange(len(sizes)), count))
    return np.concatenate(out), np.concatenate(of)


class Model:
    """Languages, log probabilities of n-gram classes (BUCKETS x languages), and who is seen in which script."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.allowed = share >= 0.01  # scripts x languages
        self.allowed[~self.allowed.any(axis=1)] = True


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 20_000) -> Model:
    """A model from rows with a language, a sample of about `sample_docs` of them by the hash of the text.

    The driver gets at most BUCKETS counts for each language of the sample, which has no more languages than rows.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    total = rows.select("lang").count()
    share = int(min(1.0, sample_docs / max(total, 1)) * (1 << 30))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share) if share < 1 << 30 else rows

    @tidied

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text"):
            number, distinct, n = letters_of(batch.column(1))
            if not distinct:
                continue
            points, sizes, script = spelled([w or " " for w in distinct])
            bucket, of = gram_buckets(points, sizes)
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                times = np.bincount(number[np.repeat(langs == lang, n)], minlength=len(distinct))
                sums = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                sums[:BUCKETS] += np.bincount(bucket, weights=times[of], minlength=BUCKETS).astype(np.int64)
                sums[BUCKETS:] += np.bincount(script, weights=times * (sizes - 2), minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(sums[at])})

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(got)))
    for k, r in enumerate(got):
        counts[r["at"], k] = r["n"]
    return Model([r["lang"] for r in got], counts[:BUCKETS], counts[BUCKETS:])


class Labeller:
    """Viterbi labels of the words of many texts."""

    def __init__(self, model: Model, switch: float = SWITCH) -> None:
        self.model, self.switch = model, switch
        self._clear()

    def _clear(self) -> None:
        self.index, self.bytes = _Index(), 0
        self.score, self.size = np.zeros((1 << 12, len(self.model.languages)), np.float32), np.zeros(1 << 12, np.int32)
        self.count = 0

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            points, sizes, script = spelled(part)
            bucket, of = gram_buckets(points, sizes)
            got = np.stack([np.bincount(of, weights=self.model.table[bucket, k], minlength=len(part)) for k in range(len(self.model.languages))], axis=1)
            # n-grams of a word overlap: their mean over the lengths counts each letter about once
            got = got / len(GRAMS)
            got = np.maximum(got, got.max(axis=1, keepdims=True) - 30)
            got[~self.model.allowed[script]] = -1000
            while self.count + len(part) > len(self.score):
                self.score, self.size = np.concatenate([self.score, np.zeros_like(self.score)]), np.concatenate([self.size, np.zeros_like(self.size)])
            self.score[self.count : self.count + len(part)] = got - got.max(axis=1, keepdims=True)
            self.size[self.count : self.count + len(part)] = sizes - 2
            self.count += len(part)
            self.bytes += int(sizes.sum())

    def __call__(self, number: np.ndarray, distinct: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label and letters of every word of texts, from `letters_of`."""
        if len(self.index) > 400_000 or self.bytes > 8 << 20:
            self._clear()
        known = np.fromiter(map(self.index.__getitem__, [w or " " for w in distinct]), np.int64, len(distinct))
        self._learn()
        number = known[number]
        return self.viterbi(self.score, number, n), self.size[number]

    def viterbi(self, score: np.ndarray, number: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.argsort(-n, kind="stable")
        n, begin = n[order], (np.cumsum(n) - n)[order]
        stay = np.zeros((len(number), score.shape[1]), bool)  # whether the best way to a state stays in it
        best = np.zeros(len(number), np.int8 if score.shape[1] < 128 else np.int32)  # the best state at the word
        live = len(n) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), side="right")
        value = np.zeros((len(n), score.shape[1]), np.float32)
        for t, k in enumerate(live.tolist()):
            at = begin[:k] + t
            before = value[:k]
            if t:
                jump = before.max(axis=1, keepdims=True) - np.float32(self.switch)
                stay[at] = before >= jump
                before = np.maximum(before, jump)
            now = before + score[number[at]]
            now -= now.max(axis=1, keepdims=True)
            value[:k] = now
            best[at] = now.argmax(axis=1)
        label = np.zeros(len(number), best.dtype)
        state = np.zeros(len(n), best.dtype)
        for t in range(len(live) - 1, -1, -1):
            k = int(live[t])
            at = begin[:k] + t
            last = n[:k] == t + 1
            ahead = np.where(last, 0, at + 1)
            now = np.where(last | ~stay[ahead, state[:k]], best[at], state[:k])
            label[at] = now
            state[:k] = now
        return label


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """Adds lang_pred, score (0 to 1: its share of the letters) and with `spans` lang_spans: (lang, start, end) in characters.

    `und` with score 0 where the text is null or has no letter, or where no language was learned.  Ties
    go to the language that sorts first.  All other columns pass through; columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "lang_spans")
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if spans:
        schema.add("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    names = schema.names

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, switch) if model.languages else None
        for batch in sliced(batches, text_col, 4 << 20):
            texts = batch.column(batch.schema.get_field_index(text_col))
            number, distinct, n = letters_of(texts)
            pred, score = np.full(len(n), "und", object), np.zeros(len(n))
            label = np.zeros(0, np.int8)
            if labeller is not None:
                label, letters = labeller(number, distinct, n)
                of = np.repeat(np.arange(len(n)), n)
                share = np.zeros((len(n), len(model.languages)))
                for k in range(share.shape[1]):
                    share[:, k] = np.bincount(of, weights=letters * (label == k), minlength=len(n))
                total = share.sum(axis=1)
                has = total > 0
                winner = share.argmax(axis=1)
                pred[has] = np.array(model.languages, object)[winner[has]]
                score[has] = share[has, winner[has]] / total[has]
            columns = [*batch.columns, pa.array(pred, pa.string()), pa.array(score)]
            if spans:
                columns.append(pa.array(_spans(texts, label, n, model.languages), pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def _spans(texts: pa.Array, label: np.ndarray, n: np.ndarray, languages: list[str]) -> list[list[dict]]:
    """The labelled words' places: the same runs of letters of the same text in lower case, which has as many characters."""
    if not languages:
        return [[] for _ in range(len(texts))]
    out, at = [], 0
    lower = pc.utf8_lower(texts.fill_null(""))
    for text, words in zip(lower.to_pylist(), pc.split_pattern_regex(lower, NO_LETTERS).to_pylist(), strict=True):
        mine: list[dict] = []
        end = 0
        for word in filter(None, words):
            start = text.index(word, end)
            end = start + len(word)
            lang = languages[label[at]]
            at += 1
            if mine and mine[-1]["lang"] == lang:
                mine[-1]["end"] = end
            else:
                mine.append({"lang": lang, "start": start, "end": end})
        out.append(mine)
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: CRC-32 of the id as text is 2 modulo 4, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))
