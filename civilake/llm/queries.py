"""Queries over the driver tables, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civilake.llm import exact_dedup, jaccard, langid, mixing, negatives, packing, pii, records, runs, simhash, suffix_tree, topk, toxicity

#: Where the public tokenizer files are; a parameter of the operators, never copied.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pseudonym_key(spark: SparkSession) -> bytes:
    """The secret in the session's ``civilake.pii.key``; without one a key that is public, which protects nobody."""
    return spark.conf.get("civilake.pii.key", "public key of the test tables").encode()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.op1(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op2(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op6(documents(spark, sf_dir), tokenizer_path())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op7(documents(spark, sf_dir), pseudonym_key(spark))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.op8(documents(spark, sf_dir), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op9(documents(spark, sf_dir))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op10(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.op11(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op12(documents(spark, sf_dir))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.op13(documents(spark, sf_dir))


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_token_records": op8_token_records,
    "op9_language_id": op9_language_id,
    "op10_top_k": op10_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_jaccard": op12_jaccard,
    "op13_runs": op13_runs,
}

ORACLES = {
    "op2_exact_dedup": """
WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM rows""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scores WHERE same),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5""",
}
