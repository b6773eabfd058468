"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import language, lines, minhash, mtree, packing, pieces, spots, suffix, tokens, warc
from emberlog.llm.common import table


MTREE_SQL = """
WITH c AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT vec_id, list(floor(64 * x::DOUBLE)::BIGINT ORDER BY i) AS v FROM c GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v::DOUBLE[], p.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v p ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.d WHERE r.c < g.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n
"""


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.span_digest(suffix.suffix_dedup(docs))


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the same on all machines of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=49407)


def op3_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_codes(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out()))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.spread_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.edited_prints(table(spark, sf_dir, "documents"))


def spot_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op10's operator: near-duplicates by length partitions and pruned sets of signatures."""
    return spots.spot_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_mtree, op4_packing, op5_sentencepiece, op6_language_id, op7_warc, op8_line_dedup, op9_minhash, op10_spotsigs, spot_duplicates)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mtree": MTREE_SQL, "op7_warc": WARC_SQL, "op8_line_dedup": lines.SQL, "op9_minhash": MINHASH_SQL}
