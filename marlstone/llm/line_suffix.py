"""Line deduplication by a suffix array over line-ID sequences, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import discard, materialise, spread
from .common import SPACES, fresh

#: A repeated run has at least so many lines. A single line counts as one if it has LONG_LINE words, as many as a
#: repeated passage, or is the only line of its document.
MIN_LINES, LONG_LINE = 2, 50
NEWLINE = "\n"


def _split(text):
    return F.split(text, NEWLINE, -1)


def line_positions(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """doc, copy, line_no, a, b, long for every line that has a word: its 128-bit ID, and if it has ``long_words`` words."""
    lines = spread(docs.where("doc_id is not null").select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("copy"), F.posexplode(_split(F.col("text").cast("string"))).alias("line_no", "line"))
    lines = lines.where(F.length(F.btrim("line", F.lit(SPACES))) > 0)
    words = F.size(F.split(F.btrim("line", F.lit(SPACES)), r"[ \t\n\x0b\f\r]+"))
    long = F.lit(False) if long_words is None else words >= long_words
    return lines.select("doc", "copy", "line_no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), long.alias("long"))


def _ranked(classes: DataFrame, *keys: str) -> DataFrame:
    """Number classes in the order of their keys: rows of a range-partitioned sort have rising ids."""
    return materialise(classes.orderBy(*keys).withColumn("rank_new", F.monotonically_increasing_id()), "ranks")


def suffix_levels(docs: DataFrame, long_words: int | None = None, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """Prefix doubling over the line sequences of all documents.

    A level ranks, in suffix order, the positions whose next n lines also stand elsewhere; a rank is an interval of the
    suffix array with a longest common prefix of at least n lines. n doubles from 1; min_lines is a level too, made of two
    overlapping windows of the level before, and doubles on from there. Positions that are alone leave, since every longer
    prefix of theirs is alone too, and doubling ends when all have left. A document is a sequence of its own, so no
    prefix runs over its end. With ``long_words``, intervals of one line count too where the line has so many words
    or is the only one of its document.

    Returns the positions of repeated lines (doc, copy, pos, line_no), and for each position that is not the first of
    some interval the longest such prefix and where its first copy starts (doc, copy, pos, lines, first).
    """
    lines = line_positions(docs, long_words).distinct()
    place = F.row_number().over(W.partitionBy("doc", "copy").orderBy("line_no")) - 1
    if long_words is not None:
        lines = lines.withColumn("long", F.col("long") | (F.count("*").over(W.partitionBy("doc", "copy")) == 1))
    lines = materialise(lines.withColumn("pos", place), "lines")
    here = F.struct("doc", "copy", "pos")
    first = F.min(here).alias("first")
    classes = _ranked(lines.groupBy("a", "b").agg(F.count("*").alias("n"), first).where("n > 1"), "a", "b")
    base = materialise(lines.join(classes, ["a", "b"]).select("doc", "copy", "pos", "line_no", "long", F.col("rank_new").alias("rank"), "first"), "level")
    discard(lines)
    later = lambda level, n: level.where(here > F.col("first")).select("doc", "copy", "pos", F.lit(n).alias("lines"), "first")
    found = [] if long_words is None else [later(base.where("long"), 1)]
    level, n = base, 1
    while True:
        step = min(n, min_lines - n) if n < min_lines else n
        ahead = W.partitionBy("doc", "copy").orderBy("pos").rangeBetween(step, step)
        pairs = materialise(level.withColumn("next", F.max("rank").over(ahead)).where("next is not null").select("doc", "copy", "pos", "rank", "next"), "pairs")
        classes = _ranked(pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), first).where("n > 1"), "rank", "next")
        if not classes.limit(1).count():
            break
        level = materialise(pairs.join(classes, ["rank", "next"]).select("doc", "copy", "pos", F.col("rank_new").alias("rank"), "first"), "level")
        discard(pairs)
        discard(classes)
        n += step
        if n >= min_lines:
            found.append(later(level, n))
    if not found:
        return base, later(base.where("false"), 0)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return base, every.groupBy("doc", "copy", "pos").agg(F.max_by("first", "lines").alias("first"), F.max("lines").alias("lines"))


def repeated_runs(docs: DataFrame, long_words: int | None = None, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """Positions of repeated lines, and the repeated runs: doc, copy, start and end (positions, end exclusive), source_doc,
    source_copy, source_start.

    Neighbouring positions whose first copies are neighbours too lie on one diagonal: they make one run, which ends where
    the longest of their prefixes end. Each place in a run of n lines starts an interval of its own as long as min_lines
    lines are left, so a run comes out with all its lines. Runs within a longer one of their document are left out.
    """
    base, found = suffix_levels(docs, long_words, min_lines)
    order = W.partitionBy("doc", "copy").orderBy("pos")
    source = F.struct(F.col("first.doc"), F.col("first.copy"), (F.col("first.pos") - F.col("pos")).alias("shift"), (F.col("lines") < min_lines).alias("single"))
    rows = found.withColumn("source", source)
    new = F.coalesce((F.lag("source").over(order) != F.col("source")) | (F.lag("pos").over(order) < F.col("pos") - 1), F.lit(True))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(order))
    runs = rows.groupBy("doc", "copy", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("lines")).alias("end"), F.min("source").alias("source"))
    before = W.partitionBy("doc", "copy").orderBy("start", F.desc("end"), "run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("reach", F.max("end").over(before)).where("reach is null or reach < end")
    return base, runs.select("doc", "copy", "start", "end", F.col("source.doc").alias("source_doc"), F.col("source.copy").alias("source_copy"), (F.col("start") + F.col("source.shift")).alias("source_start"))


def later_copies(docs: DataFrame, long_words: int | None = None, min_lines: int = MIN_LINES) -> DataFrame:
    """doc, copy, gone (lines to delete: sorted spans of line numbers, with their lengths) and deleted (their number)."""
    base, runs = repeated_runs(docs, long_words, min_lines)
    order = W.partitionBy("doc", "copy").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0)
    none = F.lit(None).cast("int")
    marks = base.select("doc", "copy", "pos", F.lit(1).alias("kind"), "line_no", none.alias("end"))
    marks = marks.unionByName(runs.select("doc", "copy", F.col("start").alias("pos"), F.lit(0).alias("kind"), none.alias("line_no"), "end"))
    gone = marks.withColumn("reach", F.max("end").over(order)).where("kind = 1 and reach > pos")
    at = F.row_number().over(W.partitionBy("doc", "copy").orderBy("line_no"))
    spans = gone.withColumn("island", F.col("line_no") - at).groupBy("doc", "copy", "island").agg(F.min("line_no").alias("start"), F.count("*").cast("int").alias("n"))
    return spans.groupBy("doc", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("gone"), F.sum("n").alias("deleted"))


def dedup_lines(docs: DataFrame, long_words: int | None = LONG_LINE, min_lines: int = MIN_LINES) -> DataFrame:
    """Documents without the later copies of repeated line runs; with ``long_words``, also of single lines of so many
    words and of lines that are the only one of their document.

    Returns the columns of ``docs`` with the new text (remaining lines joined again) and the columns
    lines_total and lines_deleted (lines with a word), which take the place of any of these names. Copies are earlier by
    doc_id, then (rows that share a doc_id) by a hash of their text, then by line; identical rows count once and are cut
    alike. Lines without a word are no part of runs and stay. Null texts and rows without doc_id come back as they
    are, with counts of null and zero lines deleted; an empty table gives an empty result.
    """
    if min_lines < 2:
        raise ValueError("a run has two lines at least")
    doc, copy, gone, deleted = (fresh(docs, c) for c in ("doc", "copy", "gone", "deleted"))
    cuts = later_copies(docs, long_words, min_lines).withColumnsRenamed({"doc": doc, "copy": copy, "gone": gone, "deleted": deleted})
    text = F.col("text").cast("string")
    here = docs.join(cuts, (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(copy)), "left")
    lines, spans = _split(text), F.col(gone)
    ends = lambda s: s["start"] + s["n"]
    upto = F.transform(spans, lambda s, i: F.slice(lines, F.when(i > 0, ends(F.get(spans, i - 1))).otherwise(0) + 1, s["start"] - F.when(i > 0, ends(F.get(spans, i - 1))).otherwise(0)))
    last = ends(F.element_at(spans, -1))
    left = F.concat(F.flatten(upto), F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0))))
    wordy = F.size(F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)).cast("long")
    return here.select(
        *[(F.when(spans.isNull(), F.col("text")).otherwise(F.array_join(left, NEWLINE)).alias(c) if c == "text" else docs[c]) for c in docs.columns if c not in ("lines_total", "lines_deleted")],
        F.when(text.isNotNull() & F.col("doc_id").isNotNull(), wordy).alias("lines_total"),
        F.coalesce(F.col(deleted), F.lit(0)).cast("long").alias("lines_deleted"),
    )


#: The same result in SQL: runs of two lines that stand earlier, each with both its lines deleted, and the single lines.
ORACLE_SQL = r"""
WITH raw AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, i - 1 AS line_no, parts[i] AS line
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM raw)
), wordy AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, count(*) OVER (PARTITION BY doc_id) AS n_lines,
        len(regexp_split_to_array(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \t\n\x0b\f\r]+')) AS n_words
    FROM lines WHERE length(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0
), runs AS (
    SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next_line FROM wordy
), later AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, pos) AS nth
        FROM runs WHERE next_line IS NOT NULL)
    WHERE nth > 1
), single AS (
    SELECT doc_id, line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM wordy)
    WHERE nth > 1 AND (n_words >= 50 OR n_lines = 1)
), gone AS (
    SELECT w.doc_id, w.line_no FROM wordy w JOIN later l ON w.doc_id = l.doc_id AND w.pos IN (l.pos, l.pos + 1)
    UNION SELECT doc_id, line_no FROM single
), kept AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text
    FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.text, '') AS text,
    (SELECT count(*) FROM wordy w WHERE w.doc_id = d.doc_id) AS lines_total,
    (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS lines_deleted
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
