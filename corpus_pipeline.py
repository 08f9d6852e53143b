"""A corpus pipeline: quality rules, line dedup, near-duplicate documents, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last
return the columns of ``documents``: texts that a stage cuts come back with their new n_chars, and documents of
which a cut leaves no word are dropped. The last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlstone.llm.common import SPACES
from marlstone.llm.line_suffix import dedup_lines
from marlstone.llm.near_duplicates import keep_one_per_near_class
from marlstone.llm.packing import pack
from marlstone.llm.passage_chains import cut_passages
from marlstone.llm.quality_rules import keep_good
from marlstone.session import discard, materialise


def _after_cut(before: DataFrame, after: DataFrame) -> DataFrame:
    left = after.select(before.columns).withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return left.where(F.length(F.btrim("text", F.lit(SPACES))) > 0)


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _after_cut(docs, dedup_lines(docs))


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_near_class(docs)


def passage_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _after_cut(docs, cut_passages(docs))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", passage_stage),
    ("best_fit_packing", packing_stage),
]

#: The first, third and fourth stages are iterative, so SQL cannot express the whole.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
