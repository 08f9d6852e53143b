"""The opN_ queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import centroids, divergence, line_suffix
from .chat_tools import link_tools
from .licenses import document_files, scan
from .mtree import top_products
from .packing import pack
from .passage_chains import repeated_passages
from .quality_rules import quality_rules
from .sentencepiece_bpe import encoding_digests
from .simhash_trie import simhash_components
from .token_files import token_files
from .weak_labels import classify


def op1_sentencepiece(spark, sf_dir):
    return encoding_digests(table(spark, sf_dir, "documents"))


def op2_mtree_topk(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op5_weak_labels(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"))


def op6_simhash_trie(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_suffix.dedup_lines(docs)


def op8_license_scan(spark, sf_dir):
    """Documents as files source/lang/doc_id; such names tell nothing, so a document that is a notice as a whole is its directory's licence file."""
    found = scan(document_files(table(spark, sf_dir, "documents")), whole_texts=True)
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "licence", "cosine", "origin", "licence_file")


def op9_chat_tools(spark, sf_dir):
    return link_tools(table(spark, sf_dir, "conversations"))


def op10_passage_chains(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark, sf_dir):
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_weak_labels": op5_weak_labels,
    "op6_simhash_trie": op6_simhash_trie,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_chat_tools": op9_chat_tools,
    "op10_passage_chains": op10_passage_chains,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op7_line_dedup": line_suffix.ORACLE_SQL,
    "op11_centroid_clusters": centroids.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
}
