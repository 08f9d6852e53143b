import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from marlstone.llm import packing as K
from marlstone.llm.common import vocabulary_path


def one_by_one(lengths, cap):
    """Best-two-fit with one bin at a time and plain lists."""
    left, bins = Counter(lengths), []
    while +left:
        got, gap = [], cap
        while fits := [n for n in left if left[n] and n <= gap]:
            got.append(max(fits))
            left[max(fits)] -= 1
            gap -= max(fits)
        s = min(got)
        if gap:
            have = [n for n in left if left[n]]
            pairs = [(a + b, a, b) for a in have for b in have if a + b <= gap + s and (a != b or left[a] > 1)]
            if pairs and max(pairs)[0] > s:
                total = max(pairs)[0]
                _, a, b = max((t, min(a, b), max(a, b)) for t, a, b in pairs if t == total)
                a, b = min((min(a, b), max(a, b)) for t, a, b in pairs if t == total)
                got.remove(s)
                left[s] += 1
                left[a] -= 1
                left[b] -= 1
                got += [a, b]
        bins.append(sorted(got))
    return bins


def test_plan_equals_one_by_one():
    rng = random.Random(2)
    for cap in (12, 40, 64):
        for _ in range(40):
            lengths = [rng.randint(1, rng.choice([cap, cap // 2 + 1, 5])) for _ in range(rng.randint(1, 120))]
            counts = np.bincount(lengths, minlength=cap + 1)
            plan = [sorted(m) for m, times in K.best_two_fit(counts) for _ in range(times)]
            assert all(sum(m) <= cap for m in plan)
            assert Counter(n for m in plan for n in m) == Counter(lengths)
            assert len(plan) == len(one_by_one(lengths, cap))


def test_cut():
    assert K.cut(1, 4) == [(0, 1)] and K.cut(4, 4) == [(0, 4)] and K.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_ids_equal_the_tokenizers_library():
    lib = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    own = K.ByteTokenizer()
    texts = ["\n" * 1_000_000 + "x", "", " ", "a", "It's <|endoftext|> fine", "été\r\n\n  x\t", "😀👍🏽 漢字   ", "a" * 3000, " " * 5000 + "x", "'s'T'll  \x00 1234567 !!??"]
    for t in texts:
        assert own(t) == lib.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w%d" % rng.randint(0, 99) for _ in range(rng.choice([1, 5, 40, 300, 2500]))), 1) for i in range(120)]
    docs += [(500, None, 1), (501, "", 1), (None, "x", 1), (7, docs[7][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, offset int")
    rows = K.pack(df).collect()
    lib = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = Counter()
    for d, t, _ in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(K.cut(len(ids))):
            want[(d, k, s, n, zlib.crc32(array("I", ids[s : s + n]).tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in rows) // 2048) + 2
    assert K.pack(df.limit(0)).count() == 0
