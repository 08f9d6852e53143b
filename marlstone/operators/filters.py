"""Search filters, selection rules and derived flags (column expressions and semi-joins)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class SearchFilters:
    """Conjunction of optional conditions on documents; an empty tuple or None sets none.

    Courts, court levels and dates restrict judgments only: other kinds pass. A null date fails a date bound.
    """

    kinds: tuple[str, ...] = ()
    courts: tuple[str, ...] = ()
    court_levels: tuple[str, ...] = ()
    acts: tuple[str, ...] = field(default=())
    date_from: str | None = None
    date_to: str | None = None

    def __post_init__(self):
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from lies after date_to")


def judgment_only(condition: Column, kind: str = "kind") -> Column:
    """``kind <> 'judgment' OR condition`` with SQL's three-valued logic."""
    return (F.col(kind) != "judgment") | condition


def filter_column(f: SearchFilters) -> Column:
    """All conditions but the one on acts, which needs the citation edges."""
    out = F.lit(True)
    if f.kinds:
        out &= F.col("kind").isin(*f.kinds)
    if f.courts:
        out &= judgment_only(F.col("court").isin(*f.courts))
    if f.court_levels:
        out &= judgment_only(F.col("court_level").isin(*f.court_levels))
    if f.date_from:
        out &= judgment_only(F.col("decision_date") >= F.lit(f.date_from).cast("date"))
    if f.date_to:
        out &= judgment_only(F.col("decision_date") <= F.lit(f.date_to).cast("date"))
    return out


def filter_by_act(documents: DataFrame, edges: DataFrame, acts: tuple[str, ...]) -> DataFrame:
    """Documents that are one of the Acts or cite a section of one through a resolved edge.

    ``edges`` has source_doc_id and target_doc_id; the keys of both cases are joined once, as a left semi join.
    """
    if not acts:
        return documents
    citing = edges.where(F.col("target_doc_id").isin(*acts)).select(F.col("source_doc_id").alias("doc_id"))
    own = documents.where(F.col("doc_id").isin(*acts)).select("doc_id")
    return documents.join(citing.unionByName(own).distinct(), "doc_id", "left_semi")


def search_filters(documents: DataFrame, f: SearchFilters, edges: DataFrame | None = None) -> DataFrame:
    out = documents.where(filter_column(f))
    return filter_by_act(out, edges, f.acts) if f.acts else out


def core_rule(signals: DataFrame, min_mentions: int, min_refs: int) -> DataFrame:
    """Per document: sums of mentions and section references over acts, and whether either reaches its bound."""
    sums = signals.groupBy("doc_id").agg(F.sum("mentions").alias("mentions"), F.sum("section_refs").alias("section_refs"))
    return sums.withColumn("is_core", (F.col("mentions") >= min_mentions) | (F.col("section_refs") >= min_refs))


def usable_scan_rows(scan: DataFrame, first_year: int, last_year: int) -> DataFrame:
    return scan.where(F.col("year").between(first_year, last_year) & F.col("error").isNull() & (F.col("chars") > 0))


def case_type(title: Column) -> Column:
    """Upper-cased part of a title before its first slash, trimmed; null without a slash."""
    return F.when(F.instr(title, "/") > 0, F.upper(F.trim(F.substring_index(title, "/", 1))))


def quality_flags(text: Column, pages: Column, min_chars_per_page: int = 200, min_latin: float = 0.85) -> tuple[Column, Column]:
    """needs_ocr (too few characters a page) and language_flag (too few basic Latin letters)."""
    from ..functions.text import latin_ratio

    return F.length(text) / F.greatest(pages, F.lit(1)) < min_chars_per_page, latin_ratio(text) < min_latin


#: Fixed formats of record identifiers.
ID_PATTERNS = {
    "evidence": r"^E-\d{3,}$",
    "claim": r"^C-\d{3,}$",
    "issue": r"^I-\d+$",
    "position": r"^I-\d+\.[A-C]$",
    "argument": r"^A-\d{3,}$",
    "counterargument": r"^R-\d{3,}$",
    "objection": r"^O-\d{3,}$",
    "juror": r"^J-\d+$",
}


def id_pattern_check(kind: str, value: Column) -> Column:
    return value.rlike(ID_PATTERNS[kind])


def profile_for(doc_id: Column) -> Column:
    """Cleaning profile by the prefix of a document's ID."""
    return F.when(doc_id.startswith("SC-"), "sc").when(doc_id.startswith("HC-"), "hc").when(doc_id.startswith("ACT-"), "statute")


def document_projection(documents: DataFrame, paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """Readable units of documents: sections by char_start for statutes, paragraphs by seq for others; blanks dropped."""
    kinds = documents.select("doc_id", "kind")
    para = paragraphs.join(kinds.where("kind <> 'statute'"), "doc_id").select("doc_id", F.col("seq").cast("long").alias("place"), F.col("no").cast("string").alias("label"), "text")
    sect = sections.join(kinds.where("kind = 'statute'"), "doc_id").select("doc_id", F.col("char_start").cast("long").alias("place"), F.col("section").cast("string").alias("label"), "text")
    return para.unionByName(sect).where(F.trim("text") != "")
