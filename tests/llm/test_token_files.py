import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from marlstone.llm import token_files as T
from marlstone.llm.common import vocabulary_path


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=400), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_block_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    assert (T.unpack_block(T.pack_block(ids, percentile)) == ids).all()


def test_outliers_are_exceptions_and_width_is_by_percentile():
    ids = np.array([7] * 950 + [7 + 2**31] * 74, np.uint32)
    raw = T.pack_block(ids)
    least, n, width, patches = T._BLOCK.unpack_from(raw)
    assert (least, n, width, patches) == (7, 1024, 0, 74) and len(raw) == T._BLOCK.size + 6 * 74
    assert (T.unpack_block(raw) == ids).all()


def test_ids_equal_the_library(lib):
    own = T.WordTokenizer()
    rng = random.Random(1)
    texts = ["", " ", "It's  a\tB\x1cc\x85d e　f", "x<|endoftext|>y <|startoftext|>", "́ á \n̸=", "  ", "ΑΣ ΟΔΟΣ, Σ", "İstanbul 10th", "a" * 5000, "don't I'LL we're 's", "﻿a​b"]
    chars = [chr(c) for c in (*range(0x0, 0x250), *range(0x300, 0x370), 0x1100, 0x1161, 0x11A8, 0x3A3, 0x3C2, 0x2000, 0x200D, 0x3000, 0x1F600, 0xAC00, 0xFB01)]
    texts += ["".join(rng.choice(chars + [" ", "\n", "a", "'s"] * 30) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    ends = [a + t for a in ("word", "été", "ﬁ", "x1", "'", "İ", "a\u0338") for t in ("...", "'s", "<", "=\u0338", "-*", "_", "\u0301.", "|>", "$5", "”")]
    texts += ends + ["w" * 70 + ".", "w" * 70, "Ab.", "ab.", "ab"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    ids, ends = own(pa.array(texts))
    assert len(ends) == len(texts) and ends[-1] == len(ids)
    for t, w, a, z in zip(texts, want, [0, *ends], ends):
        assert ids[a:z].tolist() == w, repr(t)
    for t, w in zip(texts, want):
        assert own(pa.array([t]))[0].tolist() == w, repr(t)


def test_lower_case_letters_stay_one_by_one(lib):
    """What the short way relies on: letters below U+0250 but U+0130 are in normal form, and lower case keeps them single letters."""
    import unicodedata

    for c in map(chr, range(0x250)):
        if c.isalpha() and c != "\u0130":
            assert unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower().isalpha()
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha() and c != 0x130]
    own = T.WordTokenizer()
    for t in ["".join(letters[i : i + 3]) for i in range(0, len(letters), 3)]:
        assert own(pa.array([t]))[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_file_index_reads_ranges(tmp_path):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 49408, rng.integers(0, 5000)).astype(np.uint32) for _ in range(40)]
    w = T.TokenWriter(str(tmp_path / "a.tok"), block=100)
    for i, d in enumerate(docs):
        w.add(None if i == 3 else i, d)
    w.close()
    r = T.TokenReader(str(tmp_path / "a.tok"))
    everything = np.concatenate(docs)
    assert r.n_ids == len(everything)
    for _ in range(50):
        lo, hi = sorted(rng.integers(-5, len(everything) + 5, 2))
        assert (r.ids(lo, hi) == everything[max(lo, 0) : max(hi, 0)]).all()
    for i, d in enumerate(docs):
        assert (r.document(i) == d).all()
    found = list(r.checksums())
    assert [f[0] for f in found] == [None if i == 3 else i for i in range(40)]
    assert [f[3] for f in found] == [zlib.crc32(d.tobytes()) for d in docs]
    raw = (tmp_path / "a.tok").read_bytes()
    (tmp_path / "b.tok").write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        T.TokenReader(str(tmp_path / "b.tok"))


def test_query_equals_plain_form(spark, lib):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["Zebra", "été", "42", "foo-bar"]) + str(rng.randint(0, 99)) for _ in range(rng.choice([1, 30, 900]))), 1) for i in range(300)]
    docs += [(-5, None, 1), (1000, "", 1), (7, docs[7][1], 1), (8, "other", 1), (None, "no key", 1), (None, None, 1), (2000, "long " * 60_000, 1)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, start int").repartition(5)
    rows = T.token_files(df, files=9).collect()
    want = sorted((d is not None, d or 0, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for d, t, _ in docs for e in [lib.encode(t or "", add_special_tokens=False).ids + [2]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(rows, key=lambda r: r.start)]
    assert keys == sorted(keys)
    assert T.token_files(df.limit(0)).count() == 0
