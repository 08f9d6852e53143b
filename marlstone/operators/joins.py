"""Join operators: lookups, anti and semi joins, range, as-of and containment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def join_chunk_document(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents, "doc_id")


def chunk_records(chunks: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with their document (inner) and their statute section (left outer)."""
    return chunks.join(documents, "doc_id").join(sections, "section_id", "left")


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model."""
    return chunks.join(embeddings.where(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def semi_join_keys(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on), on, "left_semi")


def lookup_join(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges with the document at either their resolved target or their reference (left outer on a computed key)."""
    key = edges.withColumn("key", F.coalesce("target_doc_id", "target_ref"))
    return key.join(documents.withColumnRenamed("doc_id", "key"), "key", "left")


#: Widths of the page bins of ``range_join_page``: the powers of this from 1 to BIN_LEVELS.
BIN_BASE, BIN_LEVELS = 64, 10


def _bin(page: Column, level: int) -> Column:
    """The first page of a page's bin; beyond the last level all pages are one bin."""
    return page - F.pmod(page, F.lit(BIN_BASE**level)) if level <= BIN_LEVELS else page * 0


def range_join_page(citations: DataFrame, reports: DataFrame) -> DataFrame:
    """Citations whose page lies in a report of the same year and volume.

    Bins of pages are part of the equi-key, so a citation meets the reports around its page and not all of its volume. A
    report lies in bins of the least width that is not under its own, hence in two at most; a citation is in one bin of
    each width that some report has.
    """
    r = reports.where("first_page <= last_page").select("year", "volume", "first_page", "last_page", "doc_id")
    level = F.lit(BIN_LEVELS + 1)
    for i in range(BIN_LEVELS, 0, -1):
        level = F.when(F.col("last_page") - F.col("first_page") < BIN_BASE**i, i).otherwise(level)
    r = r.withColumn("level", level)
    levels = sorted(x[0] for x in r.select("level").distinct().collect())
    pick = lambda page: F.coalesce(*[F.when(F.col("level") == i, _bin(F.col(page), i)) for i in levels])
    if not levels:
        return citations.join(r, ["year", "volume"]).select(*[citations[x] for x in citations.columns], "doc_id")
    r = r.withColumn("bin", F.explode(F.array_distinct(F.array(pick("first_page"), pick("last_page"))))).alias("r")
    bins = F.array(*[F.struct(F.lit(i).alias("level"), _bin(F.col("page"), i).alias("bin")) for i in levels])
    c = citations.select("*", F.explode(bins).alias("at_bin")).alias("c")
    on = (F.col("c.year") == F.col("r.year")) & (F.col("c.volume") == F.col("r.volume")) & (F.col("c.at_bin.level") == F.col("r.level")) & (F.col("c.at_bin.bin") == F.col("r.bin"))
    inside = F.col("c.page").between(F.col("r.first_page"), F.col("r.last_page"))
    return c.join(r, on & inside).select(*[F.col(f"c.`{x}`") for x in citations.columns], "r.doc_id")


def equi_join_first_page(citations: DataFrame, reports: DataFrame) -> DataFrame:
    """Citations resolved by the exact first page within year, supplement and volume; the least document of equals."""
    first = reports.groupBy("year", "supp", "volume", F.col("first_page").alias("page")).agg(F.min("doc_id").alias("doc_id"))
    return citations.join(first, ["year", "supp", "volume", "page"])


def offset_to_paragraph(offsets: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """As-of join: for each (doc_id, offset) the last paragraph that starts at or before it, null before the first.

    Both sides are merged in one sorted window per document, so there is no range join and no product.
    """
    marks = paragraphs.select("doc_id", F.col("char_start").alias("at"), F.lit(0).alias("side"), "seq", F.lit(None).cast("long").alias("offset"))
    asks = offsets.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(paragraphs.schema["seq"].dataType).alias("seq"), F.col("offset").cast("long").alias("offset"))
    w = W.partitionBy("doc_id").orderBy("at", "side", "seq").rowsBetween(W.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("para_seq", F.last("seq", ignorenulls=True).over(w)).where("side = 1").select("doc_id", "offset", "para_seq")


def offset_map_back(offsets: DataFrame, runs: DataFrame, strict: bool = True) -> DataFrame:
    """Raw offsets of clean offsets through runs (clean_start, raw_start, len) of a document.

    The run is found as-of; an offset in no run is an error, or null when not ``strict``.
    """
    marks = runs.select("doc_id", F.col("clean_start").alias("at"), F.lit(0).alias("side"), F.struct("clean_start", "raw_start", "len").alias("run"))
    asks = offsets.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(marks.schema["run"].dataType).alias("run"))
    w = W.partitionBy("doc_id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    found = marks.unionByName(asks).withColumn("hit", F.last("run", ignorenulls=True).over(w)).where("side = 1")
    inside = F.col("at") - F.col("hit.clean_start")
    none = F.raise_error(F.concat(F.lit("offset in no run: "), F.col("at").cast("string"))).cast("long") if strict else F.lit(None).cast("long")
    return found.select("doc_id", F.col("at").alias("offset"), F.when((inside >= 0) & (inside < F.col("hit.len")), F.col("hit.raw_start") + inside).otherwise(none).alias("raw_offset"))


def containing_chunk(paragraphs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The smallest chunk of the same document whose paragraph span covers a paragraph; ties to the least chunk_id."""
    c = chunks.select(F.col("doc_id").alias("c_doc"), "chunk_id", "para_start", "para_end")
    hit = paragraphs.join(c, (F.col("doc_id") == F.col("c_doc")) & F.col("seq").between(F.col("para_start"), F.col("para_end")))
    best = F.min(F.struct((F.col("para_end") - F.col("para_start")).alias("span"), "chunk_id")).alias("best")
    return hit.groupBy("doc_id", "seq").agg(best).select("doc_id", "seq", F.col("best.chunk_id").alias("chunk_id"))


def merge_on_key(base: DataFrame, extra: DataFrame, key: str, accept: Column, order: list[Column]) -> DataFrame:
    """Left join with the first acceptable row of ``extra`` (by ``order``); outcome merged, rejected or absent.

    ``accept`` may use the columns of both sides; a key with rows of which none is accepted is rejected.
    """
    w = W.partitionBy(key).orderBy(F.col("accepted").desc(), *order)
    both = base.join(extra, key, "left").withColumn("accepted", F.coalesce(accept, F.lit(False)))
    first = both.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    seen = extra.select(key).distinct().withColumn("seen", F.lit(True))
    out = first.join(seen, key, "left")
    return out.withColumn("outcome", F.when(F.col("accepted"), "merged").when(F.col("seen"), "rejected").otherwise("absent")).drop("seen", "accepted")


def alias_fallback(citations: DataFrame, direct: DataFrame, aliases: DataFrame, majority: DataFrame) -> DataFrame:
    """Target of a citation by documents, else by the alias table, else by the citation graph's majority; and how."""
    out = citations.join(direct.select("canonical", F.col("doc_id").alias("d1")), "canonical", "left")
    out = out.join(aliases.select("canonical", F.col("target_ref").alias("d2")), "canonical", "left")
    out = out.join(majority.select("canonical", F.col("target_ref").alias("d3")), "canonical", "left")
    how = F.when(F.col("d1").isNotNull(), "document").when(F.col("d2").isNotNull(), "alias").when(F.col("d3").isNotNull(), "citation_graph")
    return out.select("canonical", F.coalesce("d1", "d2", "d3").alias("target"), how.alias("how"))


def orphan_rows(child: DataFrame, parent: DataFrame, key: str, parent_key: str, problem: str) -> DataFrame:
    """Rows of ``child`` whose non-null key is not in ``parent``, with the problem's name."""
    p = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(p, key, "left_anti").withColumn("problem", F.lit(problem))


def evidence_to_document(citations: DataFrame, evidence: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return citations.join(evidence, "evidence_id").join(chunks, "chunk_id").join(documents, "doc_id")


def paired_items(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Items with a value in both experiments: a, b and b - a."""
    left = a.where("value is not null").select(*key, F.col("value").alias("a"))
    right = b.where("value is not null").select(*key, F.col("value").alias("b"))
    return left.join(right, key).withColumn("difference", F.col("b") - F.col("a"))
