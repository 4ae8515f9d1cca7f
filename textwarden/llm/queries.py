"""The queries of this subpackage, by name: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import decontaminate, jaccard, licenses, neighbours, pieces, pii, quality, sharding, tokens, toxicity
from textwarden.llm.common import held_out, table


def _judged(scored: DataFrame, modulus: int, remainder: int, *more: str) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *more
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 3, 1, "evidence")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = {f"shard-{i:02d}": 2 if i % 8 == 0 else 1 for i in range(32)}
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["doc_id"], shards).select("doc_id", "slot", "shard")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts, "op2_license_scan": op2_license_scan, "op3_quality": op3_quality, "op4_pii": op4_pii, "op5_toxicity": op5_toxicity, "op6_neighbours": op6_neighbours, "op7_decontamination": op7_decontamination, "op8_jaccard": op8_jaccard, "op9_sharding": op9_sharding, "op10_pieces": op10_pieces}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# the definitions themselves, without the methods: windows joined with windows, shingles with shingles
ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, l, array_to_string(w[p:p + l - 1], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS l FROM i WHERE len(w) > 0), unnest(range(1, len(w) - l + 2)) AS q(p)),
dw AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS k FROM d, (SELECT DISTINCT l FROM iw), unnest(range(1, len(w) - l + 2)) AS q(p)),
h AS (SELECT doc_id, p, l, item FROM dw JOIN iw USING (l, k)),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM h, unnest(range(p, p + l)) AS q(x) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_jaccard": rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM t),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.doc_id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)""",
}
