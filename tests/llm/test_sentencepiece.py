import hashlib
import random
from array import array

import pytest
import sentencepiece

from marlstone.llm.common import vocabulary_path
from marlstone.llm.sentencepiece_bpe import MergeCodec, encode_documents, encoding_digests


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return MergeCodec(vocabulary_path("piece_bpe_32k.model"))


TEXTS = ["", " ", "   ", "a", " a", "a ", "  a  b ", "\n", "\t\nx \n", "Ünïcode ß ﬁ Ａ", "漢字かな 😀👍🏽‍", "▁x ▁▁ y", "<s> </s> <unk> <0x41>", "a\u0000b", "x" * 3000, " " * 700, "aab" * 900 + " " + "é" * 300, "in   the end\r\n"]


def test_equal_library(lib, codec):
    rng = random.Random(9)
    words = ["the", "Thing", "ouère", "a", "", "\n", "zz9", "–", "ﬂ", "▁", "könnte", "...", "🙂"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    for t, (ids, text) in zip(texts, codec.encode_batch(texts)):
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert array("I", ids).tolist() == want, t
        assert text.decode() == lib.decode(want) == codec.decode(want), t
    for ids in ([1, 2], [13, 29871, 263], [230, 100, 250], [0, 5], [1, 29871, 29871, 35]):
        assert codec.decode(ids) == lib.decode(ids), ids


def test_documents(spark, lib):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "k"), (None, "null id", "k"), (99, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted(((d, lib.encode(t or "", add_bos=True, add_eos=True)) for d, t, _ in rows), key=repr)
    full = encode_documents(df).collect()
    assert sorted(((r.doc_id, r.ids) for r in full), key=repr) == want
    assert sorted((r.decoded for r in full)) == sorted(lib.decode(i) for _, i in want)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoding_digests(df).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(((d, len(i), sha(array("I", i).tobytes()), sha(lib.decode(i).encode())) for d, i in want), key=repr)
    assert encoding_digests(df.limit(0)).count() == 0
