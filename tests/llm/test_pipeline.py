"""The pipeline on a planted corpus, against what each stage must leave, worked out by hand."""

import random
import zlib
from array import array
from collections import Counter

import pytest
from tokenizers import Tokenizer

from marlstone.llm.common import vocabulary_path
from marlstone.llm.packing import cut

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 7)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    clean = {i: "\n".join(line(rng.randint(25, 40)) for _ in range(6)) for i in range(80)}
    docs = dict(clean)
    expect = dict(clean)
    docs[100] = "too short to keep"  # quality: under 50 words
    docs[101] = "again and again " * 40  # quality: repeated windows
    docs[102] = clean[3]  # line dedup: all lines stand in document 3
    run = clean[5].split("\n")[1:4]  # line dedup: three lines of document 5 amid new ones
    own = [line(30), line(30)]
    docs[103] = "\n".join([own[0], *run, own[1]])
    expect[103] = "\n".join(own)
    near = clean[7].replace("\n", " ")  # near copy of document 7 in one line: an equal fingerprint
    docs[104] = near
    passage = clean[9].split("\n")[2:4]
    stolen = " ".join(passage).split()  # 50 words or more of document 9, inside other lines
    a, b = line(60)[:-1], line(60)
    docs[105] = a + " " + " ".join(stolen) + " " + b
    expect[105] = a + " " + b
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == df.columns, name
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text for r in frame.collect()})
        assert all(r.n_chars == len(r.text) for r in frame.collect())
    assert set(docs) - set(kept[0]) == {100, 101}
    assert set(kept[0]) - set(kept[1]) == {102} and kept[1][103] == expect[103] and kept[1][5] == clean[5]
    assert set(kept[1]) - set(kept[2]) == {104}
    assert set(kept[3]) == set(kept[2]) and kept[3][105] == expect[105]
    assert kept[3] == expect
    lib = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in expect.items():
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        want.update((d, k, s, n, zlib.crc32(array("I", ids[s : s + n]).tobytes())) for k, (s, n) in enumerate(cut(len(ids))))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
