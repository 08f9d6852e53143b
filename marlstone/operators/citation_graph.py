"""The citation graph: mentions, parallel groups, aliases learnt in one pass, edges resolved in the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions.citations import find_citations, resolve_act, statute_mentions, treatment_cues
from ..functions.text import context_window
from ..session import spread
from .aggregates import alias_table
from .joins import offset_to_paragraph


def mentions(documents: DataFrame) -> DataFrame:
    """doc_id, nth, start, end, raw, reporter, canonical, year, volume, supp, page, gap, treatment, context of all citations.

    ``gap`` is the text between a citation and the one before it (null for the first).
    """
    d = spread(documents.where("text is not null").select("doc_id", "text")).select("doc_id", "text", find_citations("text").alias("spans"))
    # no filter on spans: it would be pushed below them and parse each text once more; texts without any give no rows
    d = d.withColumn("cues", treatment_cues("text", "spans"))
    zipped = F.transform("spans", lambda s, i: F.struct(i.alias("nth"), s.alias("s"), F.get("cues", i).alias("treatment"), F.when(i > 0, F.substring(F.col("text"), F.get("spans", i - 1)["end"] + 1, s["start"] - F.get("spans", i - 1)["end"])).alias("gap"), context_window(F.col("text"), s["start"], s["end"]).alias("context")))
    return d.select("doc_id", F.inline(zipped)).select("doc_id", "nth", "s.*", "gap", "treatment", "context")


def parallel_groups(found: DataFrame, longest: int = 6) -> DataFrame:
    """Mentions with ``grp``: citations printed together, parted by a colon or equals sign alone."""
    together = F.col("gap").rlike(r"^\s*[:=]\s*$") & (F.length("gap") <= longest)
    w = W.partitionBy("doc_id").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    return found.withColumn("grp", F.sum(F.when(F.coalesce(together, F.lit(False)), 0).otherwise(1)).over(w))


def build_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report positions (year, supp, volume, page, target) and neutral citations (canonical, target) of path rows.

    Paths read year_volume_first_last, with S_ before supplementary volumes; the first row of a path counts.
    """
    p = r"^(S_)?(\d{4})_(\d+)_(\d+)_(\d+)$"
    one = rows.where(F.col("path").rlike(p)).groupBy("path").agg(F.min("case_id").alias("case_id"))
    g = lambda i: F.regexp_extract("path", p, i)
    spans = one.select(g(2).cast("int").alias("year"), (g(1) != "").alias("supp"), g(3).cast("int").alias("volume"), g(4).cast("int").alias("page"), F.concat(F.lit("SC-"), "path").alias("target"))
    neutral = one.select(F.trim(F.regexp_replace("case_id", r"\s+", " ")).alias("canonical"), F.concat(F.lit("SC-"), "path").alias("target")).where("canonical <> ''")
    return spans.groupBy("year", "supp", "volume", "page").agg(F.min("target").alias("target")), neutral.groupBy("canonical").agg(F.max("target").alias("target"))


def direct_targets(found: DataFrame, spans: DataFrame, neutral: DataFrame) -> DataFrame:
    """Mentions with ``direct``: the report that begins on a cited page, or the neutral citation's; else null."""
    a = found.join(spans.withColumnRenamed("target", "t1").withColumn("reporter", F.lit("SCR")), ["reporter", "year", "supp", "volume", "page"], "left")
    b = a.join(neutral.withColumnRenamed("target", "t2").withColumn("reporter", F.lit("INSC")), ["reporter", "canonical"], "left")
    return b.withColumn("direct", F.coalesce("t1", "t2")).drop("t1", "t2")


def learn_aliases(grouped: DataFrame) -> DataFrame:
    """alias, target_ref, evidence: what groups with exactly one direct target teach about their other citations."""
    t = grouped.groupBy("doc_id", "grp").agg(F.min("direct").alias("lo"), F.max("direct").alias("hi")).where("lo = hi")
    learnt = grouped.where(~F.col("reporter").isin("SCR", "INSC")).join(t, ["doc_id", "grp"]).select(F.col("canonical").alias("alias"), F.col("lo").alias("target_ref"))
    return alias_table(learnt)


def resolve_edges(grouped: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions with target_ref and resolution: direct, else alias; a group with two targets is a conflict without any."""
    a = grouped.join(aliases.select(F.col("alias").alias("canonical"), F.col("target_ref").alias("via")), "canonical", "left")
    a = a.withColumn("t", F.coalesce("direct", "via"))
    w = W.partitionBy("doc_id", "grp")
    clash = F.coalesce(F.min("t").over(w) != F.max("t").over(w), F.lit(False))
    a = a.withColumn("clash", clash)
    return a.withColumn("target_ref", F.when(~F.col("clash"), F.col("t"))).withColumn("resolution", F.when(F.col("clash"), "conflict").when(F.col("direct").isNotNull(), "direct").when(F.col("via").isNotNull(), "alias")).drop("t", "via", "clash", "direct")


def drop_self_citations(resolved: DataFrame) -> DataFrame:
    """Without the groups that resolve to the citing document itself."""
    own = F.coalesce(F.bool_or(F.col("target_ref") == F.col("doc_id")).over(W.partitionBy("doc_id", "grp")), F.lit(False))
    return resolved.withColumn("own", own).where("not own").drop("own")


def era_rule(mentions_: DataFrame, acts: DataFrame) -> DataFrame:
    """Statute mentions (with act_id, act, decided): an undated name in a judgment older than the Act is another Act."""
    j = mentions_.join(acts.select("act_id", "commencement"), "act_id", "left")
    older = (F.col("decided") < F.col("commencement")) & ~F.col("act").rlike(r"\d{4}")
    return j.withColumn("act_id", F.when(~F.coalesce(older, F.lit(False)), F.col("act_id"))).drop("commencement")


def statute_edges(documents: DataFrame, acts: DataFrame) -> DataFrame:
    """One row for each section number that a document mentions: doc_id, start, end, section, act, act_id, raw."""
    m = spread(documents.where("text is not null").select("doc_id", "decided", "text")).select("doc_id", "decided", F.inline(statute_mentions("text")))
    return era_rule(resolve_act(m, acts, "act"), acts)


def document_edges(documents: DataFrame, paragraphs: DataFrame, index_rows: DataFrame, acts: DataFrame) -> DataFrame:
    """All case and statute citations of documents (doc_id, text, decided), resolved: two passes over the mentions.

    The first learns the alias table from all documents, the second resolves with it; the mentions are written down
    between the passes, so texts are parsed once.
    """
    from ..session import materialise

    spans, neutral = build_index(index_rows)
    grouped = materialise(direct_targets(parallel_groups(mentions(documents)), spans, neutral), "mentions")
    case = drop_self_citations(resolve_edges(grouped, learn_aliases(grouped)))
    case = case.select("doc_id", F.lit("case").alias("kind"), "raw", "canonical", "reporter", "start", "end", "target_ref", "resolution", "treatment")
    s = statute_edges(documents, acts)
    named = F.coalesce(F.concat_ws(":", "act_id", "section"), F.lit(""))
    law = s.select("doc_id", F.lit("statute").alias("kind"), "raw", F.when(F.col("act_id").isNotNull(), named).otherwise(F.concat_ws(":", "act", "section")).alias("canonical"), F.lit(None).cast("string").alias("reporter"), "start", "end", F.concat(F.lit("ACT-"), "act_id").alias("target_ref"), F.when(F.col("act_id").isNotNull(), "act").alias("resolution"), F.lit(None).cast("string").alias("treatment"))
    edges = case.unionByName(law)
    para = offset_to_paragraph(edges.select("doc_id", F.col("start").alias("offset")).distinct(), paragraphs)
    return edges.join(para.select("doc_id", F.col("offset").alias("start"), F.col("para_seq").alias("source_para_seq")), ["doc_id", "start"], "left")
