"""The corpus pipeline: language ID, line dedup, near-duplicate removal, suffix-array dedup, packing.

Every stage takes what its predecessor kept and is written as Parquet before the next one reads it.
All but the last return the columns of `documents`; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import language, lines, minhash, packing, suffix
from emberlog.llm.common import delete, fresh_path, swept, table, written
from emberlog.llm.queries import tokenizer
from emberlog.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """The stage, with this package on the executors."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_shipped
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter.  A null lang becomes the predicted one."""
    model = language.learn(docs.where(~language.held_out()))
    if not model.languages:  # without a labelled row every prediction is `und`
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = language.identify(docs, model).where("lang_pred <> 'und'")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@_shipped
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many sites share; a document of nothing else goes."""
    return _documents(lines.spread_lines(docs)).where(F.trim("text") != "")


@_shipped
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five words, 0.8), that of the smallest id, a null id last.

    Rows are named by id and text: other texts under the same id, or without one, are other documents.
    """
    kept = written(minhash.representatives(docs, words=5, similar=80), "kept")
    rows = docs.withColumns(minhash.row_key()).join(kept, ["id", "th"])
    single = rows.where("copies = 1")
    repeated = rows.where("copies > 1").dropDuplicates(["id", "text"])
    return single.unionByName(repeated).select(*COLUMNS)


@_shipped
def dedup_suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 200 bytes that also starts elsewhere; a document of nothing else goes."""
    return _documents(suffix.without_spans(suffix.suffix_dedup(docs))).where(F.trim("text") != "")


@_shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: the pieces of all documents with the checksum of their ids."""
    return packing.piece_digest(packing.pack(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("suffix-array dedup", dedup_suffixes),
    ("packing", pack),
]

#: No SQL dialect expresses Viterbi labels, suffix arrays or column generation; the tests compare the
#: pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's tables go when it is written, its output when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
