"""Scalar text, date and list functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed: curly and angled quotes, and the straight one each becomes.
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″«»"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise_quote(text: Column, fold: bool = False) -> Column:
    """Straight quotes, single spaces, trimmed; lower case on request."""
    out = collapse(F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)))
    return F.lower(out) if fold else out


def quote_in_text(quote: Column, text: Column, fold: bool = False) -> Column:
    """Whether a normalised quote is not empty and stands in the normalised text."""
    needle = normalise_quote(quote, fold)
    return (needle != "") & F.contains(normalise_quote(text, fold), needle)


def legal_text(text: Column) -> Column:
    """Citation shorthand in full: u/s 74, s. 74 and Art. 14 as words, number ranges as two numbers."""
    out = F.regexp_replace(text, r"(?i)\bu/ss?\.?\s*(?=\d)", "under section ")
    out = F.regexp_replace(out, r"(?i)\b(ss?\.|secs?\.?)\s*(?=\d)", "section ")
    out = F.regexp_replace(out, r"(?i)\barts?\.\s*(?=\d)", "article ")
    return F.regexp_replace(out, r"(\d)-(?=\d)", "$1 ")


def header_title(header: Column) -> Column:
    """A chunk header without its last paragraph label."""
    return F.regexp_replace(header, " — (¶|paras |front matter|headnote)[^—]*$", "")


def latin_ratio(text: Column) -> Column:
    """Basic Latin letters over all letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit("[A-Za-z]")) / letters).otherwise(F.lit(0.0))


def ocr_noise(text: Column) -> Column:
    """Share of tokens with symbols between letters; 0 without tokens."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))
    noisy = F.filter(tokens, lambda t: t.rlike(r"[A-Za-z]+[!{}|~\\^`@#$%*<>\[\]]+[A-Za-z]+"))
    return F.when(F.size(tokens) > 0, F.size(noisy) / F.size(tokens)).otherwise(F.lit(0.0))


def act_mentions(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def act_section_refs(text: Column, act: str, window: int = 90) -> Column:
    """Section numbers of lists that run right up to a mention of an Act, within ``window`` characters before it."""
    number = r"\d+[A-Z]?(?:\s*\([^)]{1,6}\))*"
    listed = rf"(?i)\b(?:sections?|secs?\.?|ss?\.|u/s\.?)\s*({number}(?:\s*(?:,|and|&|to|-)\s*{number})*)[\s,()a-z]{{0,{window}}}(?={act})"
    lists = F.regexp_extract_all(text, F.lit(listed), F.lit(1))
    return F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"(\d+[A-Z]?)"), F.lit(1))))


#: Citation styles of the Supreme Court, by name.
AUTHORITY_STYLES = {
    "scr": r"\[(\d{4})\]\s*(\d+)\s*S\.?\s?C\.?\s?R\.?\s*(\d+)",
    "insc": r"\b(\d{4})\s*INSC\s*(\d+)\b",
    "scc": r"\((\d{4})\)\s*(\d+)\s*SCC\s*(\d+)",
    "air_sc": r"\bAIR\s*(\d{4})\s*SC\s*(\d+)\b",
}


def cited_authorities(text: Column, style: str) -> Column:
    """Distinct citations of one style, their groups joined by slashes, sorted."""
    pattern = AUTHORITY_STYLES[style]
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(pattern.count("(\\d"))]
    names = [f"g{i}" for i in range(len(groups))]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names)])
    return F.array_sort(F.array_distinct(F.transform(zipped, lambda s: F.concat_ws("/", *[s.getField(n) for n in names]))))


def natural_key(label: Column) -> Column:
    """Sort key of labels such as 19A: number, then suffix; labels of another form first, as text."""
    number = F.regexp_extract(label, r"^(\d+)([A-Z]*)$", 1)
    return F.struct(F.when(number != "", number.cast("long")).otherwise(F.lit(0).cast("long")).alias("n"), F.when(number != "", F.regexp_extract(label, r"^(\d+)([A-Z]*)$", 2)).otherwise(label).alias("s"))


def expand_range(spec: Column) -> Column:
    """'76-79' as its numbers, anything else as itself."""
    a, b = (F.regexp_extract(spec, r"^(\d+)-(\d+)$", i) for i in (1, 2))
    lo, hi = F.when(a != "", a).cast("long"), F.when(b != "", b).cast("long")
    return F.when(lo.isNull(), F.array(spec)).when(lo > hi, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.coalesce(lo, F.lit(0)), F.greatest(F.coalesce(hi, F.lit(0)), F.coalesce(lo, F.lit(0)))), lambda x: x.cast("string")))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"([a-z]{3,})"), F.lit(1)))


def title_overlap(a: Column, b: Column) -> Column:
    """Words of three or more letters that both titles have, over the smaller set."""
    x, y = title_words(a), title_words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))


#: Words that distinguish no party.
PARTY_STOPWORDS = ("the", "and", "state", "union", "india", "ltd", "limited", "others", "another", "ors", "anr", "versus", "company", "pvt", "private")


def same_parties(a: Column, b: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in PARTY_STOPWORDS])
    return F.arrays_overlap(F.array_except(title_words(a), stop), F.array_except(title_words(b), stop))


def comparable(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def comparable_list(values: Column) -> Column:
    return F.array_sort(F.transform(values, comparable))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the words, two spaces before and one after each."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(grams))


def word_similarity(query: Column, text: Column) -> Column:
    """Share of the query's trigrams that the text has, wherever they stand (no extent, unlike a database's)."""
    q = trigrams(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, trigrams(text))) / F.size(q)).otherwise(F.lit(0.0))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def clean_record_id(raw: Column, prefix: str) -> Column:
    """E3, [e-03] and E-003 as E-003; anything else stripped of brackets and spaces."""
    text = F.trim(F.regexp_replace(F.trim(raw), r"^[\[\]()]+|[\[\]()]+$", ""))
    number = F.regexp_extract(text, rf"(?i)^{prefix}\s*-?\s*0*(\d+)$", 1)
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return F.when(number != "", F.concat(F.lit(f"{prefix}-"), padded)).otherwise(text)


def pinpoint(section: Column, para_start: Column, para_end: Column, page_start: Column, page_end: Column, header: Column) -> Column:
    """Section, paragraphs, pages or header, whichever is there first."""

    def span(one, many, a, b):
        return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, F.concat(F.lit(one), a.cast("string"))).otherwise(F.concat(F.lit(many), a.cast("string"), F.lit("-"), b.cast("string"))))

    return F.coalesce(F.concat(F.lit("s. "), section), span("para ", "paras ", para_start, para_end), span("p. ", "pp. ", page_start, page_end), header, F.lit("chunk"))


_INLINE = r"(?i)\[\s*E\s*-?\s*0*(\d+)\s*\]"


def inline_refs(text: Column) -> Column:
    """Evidence IDs cited in brackets, in order, once each."""
    numbers = F.regexp_extract_all(text, F.lit(_INLINE), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("E-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))))


def drop_ref(sentence: Column, evidence_id: Column) -> Column:
    """A sentence without its citations of one evidence."""
    number = F.regexp_extract(evidence_id, r"0*(\d+)$", 1)
    return F.regexp_replace(sentence, F.concat(F.lit(r"(?i)\s*\[\s*E\s*-?\s*0*"), number, F.lit(r"\s*\]")), F.lit(""))


def context_window(text: Column, start: Column, end: Column, pad: int = 160) -> Column:
    lo = F.greatest(start - pad, F.lit(0))
    return collapse(F.substring(text, lo + 1, end + pad - lo))


def short_label(text: Column, limit: int = 80) -> Column:
    t = collapse(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def passage_cut(passage: Column, quote: Column, size: int) -> Column:
    """At most ``size`` characters of a passage with the quote in their middle; the beginning if it isn't there."""
    at = F.instr(passage, quote) - 1
    lo = F.greatest(F.lit(0), F.least(at + F.floor(F.length(quote) / 2) - size // 2, F.length(passage) - size))
    return F.when(F.length(passage) <= size, passage).when(at < 0, F.substring(passage, 1, size)).otherwise(F.substring(passage, lo.cast("int") + 1, F.lit(size)))


def windows(text: Column, size: int = 300, limit: int | None = None) -> Column:
    """Consecutive windows of ``size`` words; a text without words is one empty window."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size))
    out = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))
    return F.slice(out, 1, limit) if limit else out


def embedding_input(header: Column, text: Column) -> Column:
    return F.concat_ws("\n", header, text)


def cache_key(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of named fields."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])])), 256)


def parse_date(text: Column) -> Column:
    """ISO, day-month-year and "Mon d, yyyy" dates; null for others and for days that are not."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d([ T][\d:.]+)?$"), F.substring(t, 1, 10))
    dmy = r"^(\d\d?)[-/.](\d\d?)[-/.](\d{4})$"
    from_dmy = F.when(t.rlike(dmy), F.concat_ws("-", F.regexp_extract(t, dmy, 3), F.lpad(F.regexp_extract(t, dmy, 2), 2, "0"), F.lpad(F.regexp_extract(t, dmy, 1), 2, "0")))
    named = r"^([A-Za-z]{3,9})\.?\s+(\d\d?),?\s+(\d{4})$"
    months = F.create_map(*[F.lit(x) for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1) for x in (m, f"{i:02d}")])
    month = F.try_element_at(months, F.lower(F.substring(t, 1, 3)))
    from_named = F.when(t.rlike(named) & month.isNotNull(), F.concat(F.regexp_extract(t, named, 3), F.lit("-"), month, F.lit("-"), F.lpad(F.regexp_extract(t, named, 2), 2, "0")))
    return F.coalesce(*[F.try_to_date(x, "yyyy-MM-dd") for x in (iso, from_dmy, from_named)])


def path_year(path: Column) -> Column:
    y = F.regexp_extract(path, r"(\d{4})", 1)
    return F.when(y != "", y.cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a share; (0, 1) without trials."""
    p = hits / F.greatest(n, F.lit(1))
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(F.lit(0.0)), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(F.lit(1.0))


def list_parse(value: Column) -> Column:
    """A list given as JSON or with single quotes; another string is a list of itself; null is empty."""
    json = F.from_json(value, "array<string>")
    loose = F.from_json(F.translate(value, "'", '"'), "array<string>")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), F.coalesce(json, loose, F.array(value))).otherwise(F.array(value))


def json_merge(a: Column, b: Column) -> Column:
    """Maps joined; the second's value wins for a key of both."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def decade(year: Column) -> Column:
    return F.floor(year / 10) * 10
