"""Queries of the problems on texts, files and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import authorship, credentials, mixing, neighbours, parsing, tokenizer, truncation
from weftgraph.tables import load

DIM = 384


def _near(spark: SparkSession, d: str):
    return neighbours.nearest(load(spark, d, "code_vectors").select("id", "ord", "embedding", "indexed_at"), DIM, k=5)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(*_near(spark, d), least=0.7)


def p1_knn(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar ids of every id."""
    near, names = _near(spark, d)
    other = names.select(F.col("vid").alias("other"), F.col("id").alias("other_id"))
    return near.join(names, "vid").join(other, "other").select("id", "rank", "other_id", "similarity")


_FILE = ["id", "ord", "indexed_at", "kind", "repo", "file_path", "content"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return authorship.unwritten(load(spark, d, "code_nodes").select(*_FILE)).select("id")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return authorship.unwritten(load(spark, d, "code_nodes").select(*_FILE))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return parsing.verdicts(load(spark, d, "code_nodes").select(*_FILE, "metadata"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).where(~F.col("ok")).select("id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(_verdicts(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found, _ = credentials.find(load(spark, d, "code_nodes").select(*_FILE))
    return found.select("id", "line_no").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    nodes = load(spark, d, "code_nodes").select(*_FILE)
    return credentials.redact(nodes, credentials.find(nodes)[1])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(load(spark, d, "documents").select("doc_id", "text"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokenizer.count_tokens(load(spark, d, "documents").select("doc_id", "source", "text"), ["doc_id", "source"])
    return mixing.plan_mix(sized, load(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(load(spark, d, "documents").select("doc_id", "text", "source"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("is_cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    cut = F.sum(F.col("is_cut").cast("long"))
    return _truncated(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("rate"))


QUERIES = {q.__name__: q for q in (p1_found, p1_knn, p3_found, p3_reasons, p4_found, p4_rates, p6_found, p6_redacted, p8_ids, p9_mix, p9_shares, p10_found, p10_rates)}
SQL: dict[str, str] = {}
