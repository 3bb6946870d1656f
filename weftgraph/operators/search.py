"""Lexical, vector and hybrid ranking.

The inverted index is three frames (postings, documents, one corpus row), made from nodes or read from a stored
version. A query of a stored index reads the buckets of its terms only; scores are partial sums per node. Ranked lists are frames with a rank column, so fusion is a union and
a grouped sum. Ties are broken by order of arrival. A missing text counts as empty.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import text as T
from weftgraph.sources.folder import Versions

K1, B, COMMON_SHARE, COMMON_FROM = 1.2, 0.75, 0.6, 100
RRF_K = 60
#: Fixed values of the lexical scorer.
STOP_WORDS = ["a", "an", "and", "for", "how", "of", "the", "to", "what", "where"]
ALIASES = {"portal": ["page"]}
UNINDEXED = ["directory", "cluster", "flow"]
SYMBOL_KINDS = ["function", "class", "interface", "method"]


@dataclass
class Index:
    postings: DataFrame  # term, id, tf
    docs: DataFrame  # id, ord, dl
    corpus: DataFrame  # n, avgdl


def document_text(content_chars: int = 1000) -> Column:
    """What is indexed of a node: name, kind, path and the head of its content; its length is a fixed value."""
    return F.concat_ws(" ", "name", "kind", "file_path", F.substring(F.coalesce("content", F.lit("")), 1, content_chars))


def build_index(nodes: DataFrame, text: Column | None = None) -> Index:
    docs = nodes.where(~F.col("kind").isin(UNINDEXED)).select("id", "ord", T.lexical_tokens(document_text() if text is None else text).alias("tokens"))
    postings = docs.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    sizes = docs.select("id", "ord", F.size("tokens").alias("dl"))
    return Index(postings, sizes, sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


#: Buckets of terms of a stored index; a query reads those of its terms.
TERM_BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(TERM_BUCKETS)).cast("int")


def index_tables(index: Index) -> dict[str, DataFrame]:
    """An index to be stored: postings lie together by the bucket of their term, sorted by it; the nodes of a term are
    spread over several files, so a frequent term is no single task."""
    rows = index.postings.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("term")
    return {"postings": rows, "docs": index.docs, "corpus": index.corpus}


def stored_index(store: Versions) -> Index:
    return Index(store.table("postings"), store.table("docs"), store.table("corpus"))


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(T.SEPARATORS, query.lower()) if 2 <= len(t) <= 64))


def bm25(index: Index, query: str, limit: int | None = 20) -> DataFrame:
    """``id, ord, score``; terms in more than 60 % of more than 100 documents are skipped."""
    terms = query_tokens(query)
    hit = index.postings.where(F.col("term").isin(terms))
    if "bucket" in index.postings.columns:
        hit = hit.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % TERM_BUCKETS for t in terms}))).drop("bucket")
    df = hit.groupBy("term").agg(F.count("*").alias("df")).crossJoin(index.corpus)  # a row per query term, one corpus row
    df = df.where(~((F.col("n") > COMMON_FROM) & (F.col("df") / F.col("n") > COMMON_SHARE)))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))))
    scored = hit.join(df, "term").join(index.docs, "id").groupBy("id", "ord").agg(F.round(F.sum(part), 6).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "ord", "id").limit(limit)


def update_index(index: Index, changed: DataFrame, deleted: DataFrame) -> Index:
    """Replaces the postings of changed nodes and drops those of deleted ones (column id)."""
    gone = changed.select("id").union(deleted.select("id")).distinct()
    new = build_index(changed)
    docs = index.docs.join(gone, "id", "left_anti").unionByName(new.docs)
    kept = index.postings.select("term", "id", "tf").join(gone, "id", "left_anti")
    return Index(kept.unionByName(new.postings), docs, docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def lexical_terms(query: str) -> list[str]:
    words = [w for w in re.findall(r"[\w-]+", query.lower()) if w not in STOP_WORDS]
    return list(dict.fromkeys(x for w in words for x in (w, *ALIASES.get(w, []))))


def lexical(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """``id, name, file_path, score`` by where the terms occur; no index needed, one pass over the nodes."""
    terms = lexical_terms(query)
    name, path, content = F.lower("name"), F.lower("file_path"), F.lower(F.coalesce("content", F.lit("")))
    total, covered = F.lit(0), F.lit(0)
    for t in terms:
        at_name = F.when(name == t, 14).when(name.startswith(t), 9).when(name.contains(t), 6).otherwise(0)
        s = at_name + F.when(path.contains(t), 4).otherwise(0) + F.when(content.contains(t), 2).otherwise(0)
        total, covered = total + s, covered + F.when(s > 0, 1).otherwise(0)
    n = nodes.where(~F.col("kind").isin(UNINDEXED)).select("id", "kind", "name", "file_path", total.alias("t"), covered.alias("c"))
    score = F.col("t") + F.when(F.col("c") > 1, F.col("c") * F.col("c") * 3).otherwise(0) + F.when(F.col("kind").isin(SYMBOL_KINDS), 1).otherwise(0)
    n = n.where(F.col("t") > 0).where(~T.path_intent(F.col("file_path")).isin(T.EXCLUDED_INTENTS)).select("id", "name", "file_path", score.cast("long").alias("score"))
    return n.orderBy(F.desc("score"), "name", "file_path", "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero norm divides by 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    size = F.sqrt(norm(a)) * F.sqrt(norm(b))
    return dot / F.when(size == 0, 1.0).otherwise(size)


def vector_top(vectors: DataFrame, query: DataFrame, limit: int = 20) -> DataFrame:
    """``id, score``: exact scan against one query vector (a single-row frame with column q)."""
    return vectors.crossJoin(F.broadcast(query)).select("id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)  # query: one row


def ranked(scored: DataFrame, *order) -> DataFrame:
    """``id, rank`` of a list already cut to its top; the window holds the short list only."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*(order or (F.desc("score"), "id")))))


def fuse(*lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of frames with id and rank: ``id, score, n_lists``."""
    both = None
    for i, x in enumerate(lists):
        part = x.select("id", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("s"), F.lit(i).alias("list"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"), F.countDistinct("list").alias("n_lists"))


def hybrid(nodes: DataFrame, lexical_list: DataFrame, vector_list: DataFrame, limit: int = 20) -> DataFrame:
    """``id, name, file_path, score, lexical_rank, vector_rank`` with the evidence of either list; test, fixture,
    bench and generated paths are left out."""
    fused = fuse(lexical_list, vector_list)
    out = fused.join(nodes.select("id", "name", "file_path"), "id").where(~T.path_intent(F.col("file_path")).isin(T.EXCLUDED_INTENTS))
    out = out.join(lexical_list.select("id", F.col("rank").alias("lexical_rank")), "id", "left").join(vector_list.select("id", F.col("rank").alias("vector_rank")), "id", "left")
    return out.orderBy(F.desc("score"), "name", "file_path", "id").limit(limit).select("id", "name", "file_path", "score", "lexical_rank", "vector_rank")


def scoped(mode: str, lexical_list: DataFrame, vector_list: DataFrame | None, nodes: DataFrame, limit: int = 20) -> tuple[DataFrame, dict]:
    """Runs the mode asked for, or the best available, and says so."""
    told = {"requestedMode": mode, "actualMode": mode, "fallbackReason": None}
    if mode in ("auto", "vector", "hybrid"):
        if vector_list is not None:
            return hybrid(nodes, lexical_list, vector_list, limit), told | {"actualMode": "hybrid"}
        told |= {"actualMode": "bm25", "fallbackReason": "vector index unavailable"}
    return lexical_list.join(nodes.select("id", "name", "file_path"), "id").orderBy("rank").limit(limit), told


def federated(per_repo: DataFrame, limit: int = 20) -> DataFrame:
    """``repo, id, score`` from (repo, id, score): ranked within each repo, fused over repos. Keyed by both columns."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "id"))
    return per_repo.withColumn("r", rank).where(F.col("r") <= limit).select("repo", "id", F.round(F.lit(1.0) / (RRF_K + F.col("r")), 9).alias("score")).orderBy(F.desc("score"), "repo", "id").limit(limit)


def embedding_text(limit: int = 512) -> Column:
    """The text to embed: kind, name, signature and summary if there is a summary, else the code."""
    signature = F.trim(F.substring_index(F.coalesce("content", F.lit("")), "\n", 1))
    summary = F.try_variant_get(F.try_parse_json("metadata"), "$.summary", "string")
    told = F.concat_ws("\n", F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("name")), signature, summary)
    code = F.concat_ws("\n", F.concat_ws(" ", "kind", "name"), "file_path", F.coalesce("content", F.lit("")))
    return F.substring(F.when(summary.isNotNull(), told).otherwise(code), 1, limit)


def embed(texts: DataFrame, model, batch: int = 64) -> DataFrame:
    """``id, embedding`` by a callable from a list of texts to vectors, in batches inside each task."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(model(list(part["text"])))})

    return texts.select("id", "text").mapInPandas(run, "id string, embedding array<float>")


def embedding_plan(has_vectors: bool, rebuilt: bool, n_changed: int, n_deleted: int) -> tuple[str, str]:
    if not has_vectors:
        return "full", "no-vectors"
    if rebuilt:
        return "full", "rebuilt"
    return ("incremental", "changes") if n_changed or n_deleted else ("skip", "no-changes")
