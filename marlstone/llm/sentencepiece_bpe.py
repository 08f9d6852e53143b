"""SentencePiece merge-type encoding and decoding with a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .common import text_batches, vocabulary_path

#: Units remembered by a worker, and the longest one remembered; both bound its memory.
MEMO_UNITS, MEMO_CHARS = 500_000, 48
#: Units up to this length keep their agenda as a list that is scanned, longer ones as a heap.
SHORT = 32
_SPACE = "▁"
_NEVER = float("-inf")


class MergeCodec:
    """Encoder and decoder of one BPE model with byte fallback.

    In the vocabularies served no piece has the space mark after another character, so a merge never joins two
    units (a run of spaces with the run of other characters behind it); units are encoded on their own and
    remembered. A model for which that does not hold, or that normalises texts, is refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.scores = {p: (sp.get_score(i), i) for i, p in enumerate(names) if not special[i]}
        self.pair_score = {p: s for p, (s, _) in self.scores.items()}.get
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        self.unknown, self.bos, self.eos = sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.pieces = [None if s else p.replace(_SPACE, " ").encode() for p, s in zip(names, special)]
        for b, i in self.byte_ids.items():
            self.pieces[i] = bytes([b])
        if any(_SPACE in p.lstrip(_SPACE) for p in self.scores):
            raise ValueError("a piece spans words; units would not be independent")
        probe = "Ａ ﬁ  x\té é "
        if len(self.byte_ids) != 256 or sp.decode(sp.encode(probe)) != probe or sp.decode(sp.encode(" a")) != " a":
            raise ValueError("only models with byte fallback and without normalisation are served")
        self.units = re.compile(f"[ {_SPACE}]*[^ {_SPACE}]+|[ {_SPACE}]+").findall
        self.memo: dict[str, bytes] = {}

    def merge(self, symbols: str) -> list[int]:
        """ids of a unit: the best-scored adjacent pair is merged first, the leftmost among equals."""
        sym = self._merge_short(symbols) if len(symbols) <= SHORT else self._merge_long(symbols)
        scores, ids = self.scores, []
        for s in sym:
            if (got := scores.get(s)) is not None:
                ids.append(got[1])
            else:
                ids.extend([self.byte_ids[b] for b in s.encode()])
        return ids

    def _merge_short(self, symbols: str) -> list[str]:
        sym = list(symbols)
        score = self.pair_score
        agenda = [score(a + b, _NEVER) for a, b in zip(sym, symbols[1:])]
        while agenda and (best := max(agenda)) is not _NEVER:
            i = agenda.index(best)
            sym[i] = pair = sym[i] + sym[i + 1]
            del sym[i + 1], agenda[i]
            if i:
                agenda[i - 1] = score(sym[i - 1] + pair, _NEVER)
            if i < len(agenda):
                agenda[i] = score(pair + sym[i + 1], _NEVER)
        return sym

    def _merge_long(self, symbols: str) -> list[str]:
        sym: list[str | None] = list(symbols)
        n = len(sym)
        scores = self.scores
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (got := scores.get(pair := sym[i] + sym[i + 1])) is not None:
                agenda.append((-got[0], i, i + 1, pair))
        heapify(agenda)
        while agenda:
            _, i, j, pair = heappop(agenda)
            left, right = sym[i], sym[j]
            if left is None or right is None or nxt[i] != j or len(left) + len(right) != len(pair):
                continue  # one of the two has been merged since
            sym[i], sym[j] = pair, None
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (got := scores.get(new := pair + sym[k])) is not None:
                    heappush(agenda, (-got[0], i, k, new))
            if (h := prev[i]) >= 0 and (got := scores.get(new := sym[h] + pair)) is not None:
                heappush(agenda, (-got[0], h, i, new))
        return [s for s in sym if s is not None]

    def _new_units(self, units: list[str]) -> None:
        """Encode units not yet known, hold them against the library (all in one call) and decode them again."""
        ids = [self.merge(u.replace(" ", _SPACE)) for u in units]
        # the library puts one space before what it is given; every unit of a text begins with one
        # (a lone space at a text's end can't be given that way; it is the piece of that name)
        want = self.library.encode([u[1:] for u in units], num_threads=1)
        bad = [u for u, i, w in zip(units, ids, want) if i != (w or [self.library.piece_to_id(_SPACE)])]
        bad += [u for u, i in zip(units, ids) if self.raw(i) != u.replace(_SPACE, " ").encode()]
        if bad:
            raise ValueError(f"agenda, library and decoding differ on {bad[:3]!r}")
        self.memo.update((u, array("I", i).tobytes()) for u, i in zip(units, ids))

    def raw(self, ids) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] or b"" for i in ids])

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers with begin and end ids, decoded UTF-8) of every text."""
        bos, eos = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()
        found = [self.units(" " + t) if t else [] for t in texts]
        new = set().union(*found).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_UNITS:
            self.memo.clear()
            new = set().union(*found)
        self._new_units(list(new))
        ids_of = self.memo.__getitem__
        # every unit decodes to itself (checked when it was new), with its space marks as spaces
        out = [(bos + b"".join(map(ids_of, u)) + eos, "".join(u).replace(_SPACE, " ")[1:].encode()) for u in found]
        for u in new:
            if len(u) > MEMO_CHARS:
                del self.memo[u]
        return out

    def encode(self, text: str | None, bos: bool = True, eos: bool = True) -> list[int]:
        ids = array("I", self.encode_batch([text or ""])[0][0]).tolist()
        return ids[0 if bos else 1 : None if eos else -1]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, bytes join to characters (U+FFFD where they cannot), the first space goes."""
        data, n = bytearray(), 0
        for i in ids:
            if i == self.unknown:
                data += " ⁇ ".encode()
            elif self.pieces[i] is not None:
                piece = self.pieces[i]
                data += piece[1:] if not n and piece[:1] == b" " and i not in self.byte_ids.values() else piece
                n += 1
        return data.decode("utf-8", errors="replace")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Whole texts as ids and back.

    Returns doc_id, ids (array of int, with begin and end ids) and decoded. Null and empty texts are the two
    end ids and an empty string. Rows are independent: repeats, null doc_ids and other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = MergeCodec(path or vocabulary_path("piece_bpe_32k.model"))
        for b in batches:
            got = codec.encode_batch([x.as_py() or "" for x in b.column(1)])
            ids = pa.array([array("i", x) for x, _ in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([y.decode() for _, y in got], pa.string())], names=["doc_id", "ids", "decoded"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text_batches(spread(src)).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: ``encode_documents`` without its large columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = MergeCodec(path or vocabulary_path("piece_bpe_32k.model"))
        sha = hashlib.sha256
        for b in batches:
            got = codec.encode_batch([x.as_py() or "" for x in b.column(1)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([sha(x).hexdigest() for x, _ in got]), pa.array([sha(y).hexdigest() for _, y in got])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text_batches(spread(src)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
