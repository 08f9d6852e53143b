"""Rank fusion, reranking and the retrieval service."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W


def rrf(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: query_id, rank, chunk_id, score, best_rank, ranks.

    ``lists`` has query_id, list_name, chunk_id, rank. A chunk counts once in a list, at its best rank; scores are sums
    of weight / (k + rank); ties go to the better best rank, then the smaller chunk_id. ``ranks`` maps lists to ranks.
    """
    if k < 0:
        raise ValueError("k is negative")
    best = lists.groupBy("query_id", "list_name", "chunk_id").agg(F.min("rank").alias("r"))
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("list_name") == name, F.lit(float(value))).otherwise(w)
    fused = best.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(w / (k + F.col("r"))), 9).alias("score"), F.min("r").alias("best_rank"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("list_name", "r")))).alias("ranks")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "chunk_id", "score", "best_rank", "ranks")


def multi_query(searches: DataFrame) -> DataFrame:
    """search_id, nth, query: the queries of a search trimmed, empty ones dropped, repeats dropped, in order."""
    q = F.array_distinct(F.filter(F.transform("queries", lambda x: F.trim(x)), lambda x: x != ""))
    return searches.select("search_id", F.posexplode(q).alias("nth", "query"))


def best_query(lists: DataFrame) -> DataFrame:
    """The query whose list ranked a chunk highest, ties to the list's name."""
    return lists.groupBy("query_id", "chunk_id").agg(F.min_by("query", F.struct("rank", "list_name")).alias("best_query"))


def rerank(hits: DataFrame, texts: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], top: int) -> DataFrame:
    """The first ``top`` hits of a query in the order of an injected scorer, the rest behind them in their own order.

    ``hits`` has query_id, query, rank, chunk_id; ``texts`` chunk_id, text.
    """

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), t.tolist()), dtype=float)

    head = hits.where(F.col("rank") <= top).join(texts, "chunk_id").withColumn("rerank_score", score("query", "text")).drop("text")
    tail = hits.where(F.col("rank") > top).withColumn("rerank_score", F.lit(None).cast("double"))
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rank"))
    return head.unionByName(tail).withColumn("new_rank", F.row_number().over(order))


def fuse_units(hits: DataFrame, k: int = 60) -> DataFrame:
    """Fusion over units of several texts: hits have query_id, list_name, unit, rank."""
    return rrf(hits.withColumnRenamed("unit", "chunk_id"), k).withColumnRenamed("chunk_id", "unit").drop("ranks")


def section_hits(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections with their chunk IDs in reading order."""
    c = chunks.where("section_id is not null").groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "chunk_id"))), lambda s: s.chunk_id).alias("chunk_ids"))
    return sections.join(c, "section_id", "left")


def chunk_ids(chunks: DataFrame, section: str | None = None) -> DataFrame:
    """Chunk IDs of documents in reading order, of one section on request."""
    c = chunks.where(F.col("section") == section) if section else chunks
    return c.select("doc_id", "chunk_id", F.row_number().over(W.partitionBy("doc_id").orderBy("char_start", "chunk_id")).alias("place"))


def case_by_title(documents: DataFrame, title: str, threshold: float = 0.4, k: int = 10) -> DataFrame:
    from ..functions.text import word_similarity

    s = F.round(word_similarity(F.lit(title), F.col("title")), 6)
    return documents.withColumn("similarity", s).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "doc_id").limit(k)


def confirm_provision(provisions: DataFrame, section_chunks: DataFrame, hits: DataFrame, edges: DataFrame, candidates: DataFrame, least: int = 3) -> DataFrame:
    """Sections that search found a chunk of, or that at least ``least`` candidate judgments cite."""
    found = provisions.join(section_chunks, "section_id").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select("section_id")
    cited = edges.join(candidates.select(F.col("doc_id").alias("source_doc_id")), "source_doc_id", "left_semi").groupBy(F.col("target_section_id").alias("section_id")).agg(F.count_distinct("source_doc_id").alias("n")).where(F.col("n") >= least).select("section_id")
    return provisions.join(found.unionByName(cited).distinct(), "section_id", "left_semi")


def research_pool(hits: DataFrame, confirmed: DataFrame, cap: int, most: int, least: int) -> DataFrame:
    """Per issue: chunks of confirmed sections first, then search hits capped by document; ranked anew."""
    from .windows import per_document_cap

    capped = per_document_cap(hits.withColumnRenamed("issue_id", "query_id"), cap, most, least).withColumnRenamed("query_id", "issue_id")
    first = confirmed.select("issue_id", "chunk_id", F.lit(0).alias("tier"), F.col("place").cast("long").alias("rank"))
    rest = capped.join(confirmed.select("issue_id", "chunk_id"), ["issue_id", "chunk_id"], "left_anti").select("issue_id", "chunk_id", F.lit(1).alias("tier"), F.col("rank").cast("long").alias("rank"))
    return first.unionByName(rest).select("issue_id", "chunk_id", F.row_number().over(W.partitionBy("issue_id").orderBy("tier", "rank", "chunk_id")).alias("place"))


def targeted_search(hits: DataFrame, held: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The best k chunks not yet held for each query, and how many of the hits are held."""
    new = hits.join(held.select("chunk_id"), "chunk_id", "left_anti")
    new = new.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)
    return new, hits.join(held.select("chunk_id"), "chunk_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("held"))


def hybrid_search(index, vectors: DataFrame, queries: DataFrame, k: int = 10, depth: int = 100) -> DataFrame:
    """Lexical and dense lists of every query fused: query_id, rank, chunk_id, score, best_rank.

    ``index`` is an ``inverted_index.StoredIndex``; ``queries`` has query_id, query and embedding (null: lexical list alone).
    """
    from . import dense, inverted_index, lexical

    terms = lexical.query_terms(queries).where("kind = 'terms'")
    known = lexical.analyse_terms(terms, index.lexemes, index.chunks).where("df > 0").withColumnRenamed("term", "lexeme")
    lex = inverted_index.search_any(index, known, depth).withColumn("list_name", F.lit("lexical"))
    den = dense.cosine_exact(vectors, queries.where("embedding is not null"), depth).withColumn("list_name", F.lit("dense"))
    cols = ["query_id", "list_name", "chunk_id", "rank"]
    return rrf(lex.select(*cols).unionByName(den.select(*cols))).where(F.col("rank") <= k).drop("ranks")
