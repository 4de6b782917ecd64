"""Queries of the operators in this folder over their whole tables.

Only op4's links have a SQL twin: other hashes, codes and trained models can't be said in
it. tests/llm holds each against brute force, an exact round trip or held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, langid, linededup, pii, pq, quality, secrets, segment, simhash, toxicity
from quillstone.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity (0 to 3) of every document, learnt from labels.toxic."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("toxic", F.col("p_toxic") >= toxicity.LEAST)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of each document and benchmark item within 20 % word edits."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op4_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.98 within its label, and its component."""
    return pq.groups(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data of every document; the counts are of base spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    counts = {f"n_{k}": F.regexp_count("base", F.lit(f"{k}:")).cast("long") for k in pii.KINDS}
    return found.withColumns(counts).drop("base")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, and how much went."""
    found = linededup.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("runs", F.lit(0), lambda n, x: n + x["e"] - x["s"] + 1)
    words = F.aggregate("runs", F.lit(0), lambda n, x: n + x["words"])
    return found.select("doc_id", gone.alias("lines_removed"), words.alias("words_removed"), F.col("left").alias("text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of four-word shingles and its component at four bits."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, how many they are, and whether they decode to the text."""
    found = segment.encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "exact")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its score; secret tells what the forest keeps."""
    docs = table(spark, sf_dir, "documents")
    return secrets.fitted(docs).scan(docs)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_langid": op3_langid,
    "op4_pq_dedup": op4_pq_dedup,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
}
#: All pairs of a label by exact cosine, and what each vector can reach over them.
ORACLE: dict[str, str] = {
    "op4_pq_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT e.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""
}
