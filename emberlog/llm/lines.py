"""Removal of lines that many sites share, with DataFrame functions only.

Every line is a hash; the sites of a hash are a HyperLogLog sketch, merged by aggregation, so a line
that a third of all documents holds is a sketch a task before the shuffle.  Lines whose estimate lies
near the threshold get an exact distinct count; the others are decided by the estimate, which is then
further off than `WIDE` standard errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import release, unskewed, unused, written

LG_K = 12
WIDE = 6


def spread_lines(docs: DataFrame, min_sites: int = 6, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Adds n_lines and n_removed, and cuts the text's lines that occur on `min_sites` sites or more.

    The first occurrence of such a line, by id and place, stays.  Lines are what line feeds part; they
    are compared without spaces around them, and blank lines stay.  A null site is no site.  A null text
    stays null and has no lines.  Rows with equal id and text are treated alike.  Other columns pass through,
    whatever their names; columns named n_lines and n_removed are replaced.
    """
    spark = docs.sparkSession
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    split = F.split(F.col(text_col), "\n", -1)
    # hashed before the lines part, else once for each line
    lines = docs.select(did.alias("did"), th.alias("th"), F.col(site_col).cast("string").alias("site"), split.alias("lines"))
    lines = lines.select("did", "th", "site", F.posexplode("lines").alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    # 96 bits name a line
    lines = written(lines.select("did", "th", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g")), "lines")

    sketches = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("did", "pos")).alias("first"), F.count("*").alias("c"))
    error = WIDE * 1.04 / (1 << LG_K) ** 0.5
    sites = F.hll_sketch_estimate("sketch")
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = written(sketches.select("h", "g", "c", "first", sites.alias("sites")).where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") <= high)
    exact = unskewed(lines, near.select("h", "g", "c"), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= min_sites)
    boiler = spread.where(F.col("sites") > high).drop("sites").union(near.drop("sites").join(exact.select("h", "g"), ["h", "g"], "left_semi"))
    boiler = written(boiler, "boiler")

    gone = unskewed(lines, boiler, ["h", "g"]).where("did <> first.did or pos <> first.pos")
    gone = written(gone.groupBy("did", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    release(spark, lines, spread, boiler)

    docs = docs.drop("n_lines", "n_removed")
    of_did, of_th, places = unused(docs, "did", "th", "gone")
    joined = docs.withColumns({of_did: did, of_th: th}).join(gone.toDF(of_did, of_th, places), [of_did, of_th], "left")
    count = F.when(F.col(text_col).isNotNull(), F.size(split)).otherwise(0)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(places))
    # an array of one element binds the lines, which would be split anew for each of them
    text = F.transform(F.array(split), lambda all_lines: F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))[0]
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(text)
    return joined.withColumns({"n_lines": count.cast("long"), "n_removed": F.coalesce(F.size(places), F.lit(0)).cast("long"), text_col: text}).drop(of_did, of_th, places)


#: The same in DuckDB's SQL: n_lines, n_removed and the SHA-256 of the kept text.
SQL = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT doc_id, source, pos, line, trim(line) AS k FROM l),
b AS (SELECT k, min((doc_id, pos)) AS first FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 6),
m AS (SELECT t.*, b.k IS NOT NULL AND (t.doc_id, t.pos) <> b.first AS gone FROM t LEFT JOIN b ON t.k = b.k),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
