"""Lexical retrieval: tokens, stems, postings, and batches of queries in one job."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.udfs import arrow_udf
from ..session import bounded, materialise, spread, text_batches

#: Fixed: English words that carry no signal (a shortened public list; a database's may differ).
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during "
    "each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or "
    "other our ours out over own s same she should so some such t than that the their theirs them then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with you your yours"
).split()

#: Words whose stems a task remembers.
STEMS = 200_000

_VOWEL = "[aeiouy]"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
#: Suffix rules of the Snowball English stemmer (public algorithm), longest match first within a step.
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=len, reverse=True)
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes", "sky": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        m = re.search(f"{_VOWEL}[^aeiouy]", w)
        r1 = m.end() if m else len(w)
    m = re.search(f"{_VOWEL}[^aeiouy]", w[r1:])
    return r1, (r1 + m.end() if m else len(w))


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def stem(word: str) -> str:
    """English stem of a lower-case word (Snowball English, as published)."""
    if len(word) <= 2 or word in _EXCEPTIONS:
        return _EXCEPTIONS.get(word, word)
    w = re.sub("^y|([aeiouy])y", lambda m: (m[1] or "") + "Y", word.strip("'"))
    r1, r2 = _regions(w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    # 1b: past and progressive forms
    m = re.search("(eedly|ingly|edly|eed|ing|ed)$", w)
    if m:
        if m[1] in ("eed", "eedly"):
            if m.start() >= r1:
                w = w[: m.start()] + "ee"
        elif re.search(_VOWEL, w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    # 1c: y
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2 to 4: derivational suffixes
    for old, new in _STEP2:
        if w.endswith(old):
            if len(w) - len(old) >= r1:
                w = w[: -len(old)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3] in _LI:
            w = w[:-2]
    for old, new in _STEP3:
        if w.endswith(old):
            if len(w) - len(old) >= r1:
                w = w[: -len(old)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for old in _STEP4:
        if w.endswith(old):
            if len(w) - len(old) >= r2:
                w = w[: -len(old)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    # 5: final e and l
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@arrow_udf("string")
def stem_word(words: pd.Series) -> pd.Series:
    return words.map({w: stem(w) for w in words.dropna().unique()})


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Fixed: how legal shorthand is rewritten before words are taken, in lower case and in order ("u/s 55", "s. 74", "Art. 14", "73-74").
LEGAL = [
    (r"(^|[^\p{L}\p{N}_])u/ss?\.?[ \t\n\r\f]*([0-9])", r"\1under section \2"),
    (r"(^|[^\p{L}\p{N}_])(?:ss?\.|secs?\.?)[ \t\n\r\f]*([0-9])", r"\1section \2"),
    (r"(^|[^\p{L}\p{N}_])arts?\.[ \t\n\r\f]*([0-9])", r"\1article \2"),
    *[(r"([0-9])-([0-9])", r"\1 \2")] * 2,
]


def legal_text(text: Column) -> Column:
    """A text in lower case with its shorthand for sections and articles written out and number ranges parted."""
    out = F.lower(text)
    for old, new in LEGAL:
        out = F.regexp_replace(out, old, new.replace("\\", "$"))
    return out


def token_rows(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunk_id, pos (from 1, stop words counted), word, without stop words."""
    rows = spread(chunks.select("chunk_id", text)).select("chunk_id", F.posexplode(words_of(F.col(text))).alias("p", "word"))
    return rows.where(~F.col("word").isin(*STOP_WORDS)).select("chunk_id", (F.col("p") + 1).alias("pos"), "word")


def tsvector(chunks: DataFrame, header: str = "header", text: str = "text", stemmed: bool = True) -> DataFrame:
    """Postings with weights: chunk_id, lexeme, weight (B for header, A for text), positions.

    Legal shorthand is written out, stop words drop out, the other words are stemmed (unless ``stemmed`` is false). The words of a text are gathered where the text is; only chunks whose id comes more than once are brought together by a shuffle.
    """
    repeated = materialise(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("again")), "repeated")
    n = repeated.count()
    if not n:
        return _gathered(chunks, header, text, stemmed)
    repeated, same = F.broadcast(repeated) if n <= 200_000 else repeated, F.col("chunk_id").eqNullSafe(F.col("again"))
    parts = _gathered(chunks.join(repeated, same, "left_semi"), header, text, stemmed)
    merged = parts.groupBy("chunk_id", "lexeme", "weight").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return _gathered(chunks.join(repeated, same, "left_anti"), header, text, stemmed).unionByName(merged)


def _gathered(chunks: DataFrame, header: str, text: str, stemmed: bool) -> DataFrame:
    """The postings of every row by itself."""
    none = F.array().cast("array<string>")
    part = lambda name, weight: spread(chunks.select("chunk_id", name)).select("chunk_id", F.lit(weight).alias("weight"), F.coalesce(words_of(legal_text(F.col(name))), none).alias("words"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return text_batches(part(text, "A").unionByName(part(header, "B"))).mapInArrow(_weighted(stemmed), f"chunk_id {kind}, lexeme string, weight string, positions array<int>")


def _weighted(stemmed: bool):
    """One row for each text and lexeme of a batch, without stop words; a word is stemmed once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for b in batches:
            words = b.column(2)
            sizes = np.diff(words.offsets.to_numpy())
            flat = words.flatten().dictionary_encode()
            known = flat.dictionary.to_pylist()
            code = flat.indices.to_numpy().astype(np.int64)
            keep = ~np.isin(np.array(known, object), STOP_WORDS)[code] if known else np.zeros(0, bool)
            if not keep.any():
                continue
            if stemmed:
                if len(stems) > STEMS:
                    stems.clear()
                stems.update((w, stem(w)) for w in known if w not in stems)
                lexemes = pa.array([stems[w] for w in known]).dictionary_encode()
                known, code = lexemes.dictionary.to_pylist(), lexemes.indices.to_numpy()[code].astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            key, pos = (row * len(known) + code)[keep], pos[keep]
            order = np.argsort(key, kind="stable")
            key, pos = key[order], pos[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            at = pa.array(key[first] // len(known))
            offsets = pa.array(np.append(first, len(key)).astype(np.int32))
            columns = [b.column(0).take(at), pa.array(known).take(pa.array(key[first] % len(known))), b.column(1).take(at), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "lexeme", "weight", "positions"])

    return run


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunk_id, lexeme (unstemmed), tf: counted before any shuffle of positions."""
    return token_rows(chunks, text).groupBy("chunk_id", F.col("word").alias("lexeme")).agg(F.count("*").alias("tf"))


#: Fixed: how queries refer to sections and articles.
_REFERENCE = r"(?<![\w/])(?:u/ss?\.?|sections?|secs?\.?|ss?\.|arts?\.|articles?)\s*\d+[A-Za-z]{0,2}(?:\s*\(\s*[0-9A-Za-z]{1,5}\s*\))*"
#: The tokens of a query: phrases (closed or not), references, words.
_TOKENS = re.compile(rf'(?P<phrase>"[^"]*"?)|(?P<reference>(?i:{_REFERENCE}))|(?P<sign>-(?="|(?i:{_REFERENCE})))|(?P<word>\S)')


def _tokens(query: str):
    """Kind and text of each token in order, with the place where it starts; single characters of words one by one."""
    return ((m.lastgroup, m[0], m.start()) for m in _TOKENS.finditer(query))


def quote_references(query: str) -> str:
    """A query with its section and article references, outside quotes, put in quotes."""
    out, at = [], 0
    for kind, text, start in _tokens(query):
        out += [query[at:start], f'"{text}"' if kind == "reference" else text]
        at = start + len(text)
    return "".join(out) + query[at:]


def parse_query(query: str) -> dict[str, list[str]]:
    """Terms and excluded terms; phrases keep their quotes; "or" and signs alone are no terms.

    A word runs up to white space, a reference or a phrase; a minus before a word or phrase excludes it.
    """
    out: dict[str, list[str]] = {"terms": [], "excluded": []}
    word, end, negative = "", -1, False

    def settle():
        bare = word.removeprefix("-")
        if re.search(r"[^\W_]", word) and word.lower() != "or":
            minus = bare != word and re.match(r"[^\W_]", bare)
            out["excluded" if minus else "terms"].append(bare if minus else word)

    for kind, text, start in _tokens(query):
        if word and (kind != "word" or start != end):
            settle()
            word = ""
        if kind == "word":
            word, end = word + text, start + 1
        elif kind in ("phrase", "reference") and (inner := text.strip('"').strip()):
            out["excluded" if negative else "terms"].append(f'"{inner}"')
        negative = kind == "sign"
    settle()
    return out


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, kind (terms or excluded), term for a table of queries."""
    parsed = F.pandas_udf(lambda s: pd.DataFrame(s.map(parse_query).tolist(), columns=["terms", "excluded"]), "terms array<string>, excluded array<string>")
    p = queries.select("query_id", parsed("query").alias("p"))
    pick = lambda k: p.select("query_id", F.lit(k).alias("kind"), F.explode(f"p.{k}").alias("term"))
    return pick("terms").unionByName(pick("excluded"))


def analyse_terms(terms: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """query_id, term, df (the least of a phrase's words, 0 if unknown), idf; repeats and stop words drop out."""
    t = terms.select("query_id", F.array_join(words_of(F.col("term")), " ").alias("term")).distinct()
    words = t.select("query_id", "term", F.explode(F.split("term", " ")).alias("lexeme")).where((F.col("lexeme") != "") & ~F.col("lexeme").isin(*STOP_WORDS))
    df = words.join(stats, "lexeme", "left").groupBy("query_id", "term").agg(F.min(F.coalesce("ndoc", F.lit(0))).alias("df"))
    return df.withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def rare_terms(most: int) -> Column:
    """Whether the frequencies of a query's terms from the rarest up to this one sum to at most ``most``."""
    return F.sum("df").over(W.partitionBy("query_id").orderBy("df", "lexeme").rowsBetween(W.unboundedPreceding, 0)) <= most


def search_any(postings: DataFrame, terms: DataFrame, k: int, max_candidates: int | None = None, density_weight: float = 0.1, excluded: DataFrame | None = None) -> DataFrame:
    """Chunks with at least one term, by the share of the query's idf they cover plus a little for density.

    ``terms`` has query_id, lexeme, df, idf of single words with df over 0. All chunks with a term are candidates; with
    ``max_candidates``, those alone that have one of the rarest terms whose frequencies sum to at most that many, or, if
    none fits, all terms. Density is tf / (tf + 1) of the matched terms together. Returns query_id, rank, chunk_id, score;
    ties go to the smaller chunk_id.
    """
    q = W.partitionBy("query_id")
    t = terms.withColumn("rare", F.lit(True) if max_candidates is None else rare_terms(max_candidates)).withColumn("total", F.sum("idf").over(q)).withColumn("any_rare", F.bool_or("rare").over(q)).withColumn("n_terms", F.count("*").over(q))
    hits = postings.join(bounded(t), "lexeme").groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("idf") / F.col("total")).alias("coverage"), F.sum("tf").alias("tf"), F.bool_or("rare").alias("has_rare"), F.max("any_rare").alias("any_rare"), F.count("*").alias("matched"), F.max("n_terms").alias("n_terms")
    )
    hits = hits.where(F.when(F.col("any_rare"), F.col("has_rare")).otherwise(F.col("matched") == F.col("n_terms")))
    if excluded is not None:
        bad = postings.join(bounded(excluded), "lexeme").select("query_id", "chunk_id").distinct()
        hits = hits.join(bad, ["query_id", "chunk_id"], "left_anti")
    score = F.round(F.col("coverage") + density_weight * F.col("tf") / (F.col("tf") + 1), 6)
    return _top(hits.withColumn("score", score), k)


def search_all(postings: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Chunks with every term, by density."""
    n = terms.groupBy("query_id").agg(F.count_distinct("lexeme").alias("n_terms"))
    hits = postings.join(bounded(terms.select("query_id", "lexeme").distinct()), "lexeme").groupBy("query_id", "chunk_id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"))
    hits = hits.join(bounded(n), "query_id").where("matched = n_terms")
    return _top(hits.withColumn("score", F.round(F.col("tf") / (F.col("tf") + 1), 6)), k)


def search_phrase(tokens: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """Chunks in which the words of a phrase stand side by side, by how often.

    ``tokens`` has chunk_id, pos, word; ``phrases`` query_id, word, nth (from 0). Each word votes for the position where
    the phrase would begin: one join and one aggregate for phrases of any length.
    """
    n = phrases.groupBy("query_id").agg(F.count("*").alias("n_words"))
    votes = tokens.join(bounded(phrases), "word").groupBy("query_id", "chunk_id", (F.col("pos") - F.col("nth")).alias("at")).agg(F.count("*").alias("met"))
    hits = votes.join(bounded(n), "query_id").where("met = n_words").groupBy("query_id", "chunk_id").agg(F.count("*").alias("tf"))
    return _top(hits.withColumn("score", F.round(F.col("tf") / (F.col("tf") + 1), 6)), k)


def _top(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
