"""Token-ID files: patched frame-of-reference blocks in document order, written by tasks and read back by block."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import materialise, shared_folder
from .common import text_batches, vocabulary_path

#: ids of a block; the share of a block's ids that its width must hold, the others being exceptions.
BLOCK = 1024
PERCENTILE = 0.9
#: Blocks that a reader decodes at once.
READ_BLOCKS = 256
MAGIC = b"MSPFOR1\n"
#: Block header: least id, ids, width, exceptions. Footer: blocks, documents, ids, place of the index, its crc32, magic.
_BLOCK = struct.Struct("<IHBxH2x")
_FOOTER = struct.Struct("<QQQQI8s")
#: Bytes of texts whose words are encoded together; words of one text for the library.
TOGETHER, JOINED = 4 << 20, 1000
#: Latin letters below U+0250, without U+0130; then ASCII characters that are no letters, digits or apostrophes.
_WORD = "^(?P<base>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<tail>[.,;:!?()\\[\\]{}\"#%&*+/\\\\@^_`|~$-]*)$"


class WordTokenizer:
    """ids of the tokenizers library, each different word of a batch of texts encoded once.

    The vocabulary's normaliser and splitter drop white space and look at nothing across it, so a text's ids are those of its
    stretches between spaces and newlines, one after the other. Between Latin letters and a tail of ASCII signs the splitter
    always parts, so such a tail is encoded apart. Latin letters below U+0250 are in normal form, and lower case maps them one by one
    (U+0130 aside, which gains a mark), so words of them go to the library in lower case, many in one text, with its normaliser
    and splitter replaced by white space alone. That text is parted at the ids that end a word; each word has just one.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        path = path or vocabulary_path("word_bpe_49k.json")
        self.library, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = self.library.get_vocab()
        self.last = np.zeros(max(words.values()) + 1, bool)
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ").to_pylist()
        ids = np.array([i for e in self.plain.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word of letters has not one end")
        return ids, np.diff(ends, prepend=0)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (none null), and where each text's end."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        parts = pc.extract_regex(words, _WORD)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        kept = parts.filter(pa.array(simple))
        bases, tails = pc.utf8_lower(kept.field("base")).dictionary_encode(), kept.field("tail").dictionary_encode()
        ids, sizes = zip(self._encode_plain(bases.dictionary), self._encode(tails.dictionary), self._encode(words.filter(pa.array(~simple))))
        table, size = np.concatenate(ids), np.append(np.concatenate(sizes), 0)
        n, m = len(bases.dictionary), len(tails.dictionary)
        pieces = np.full((len(words), 2), len(size) - 1)  # a word's one or two pieces; the last piece is empty
        pieces[simple, 0] = bases.indices.to_numpy()
        pieces[simple, 1] = tails.indices.to_numpy() + n
        pieces[~simple, 0] = np.arange(n + m, len(size) - 1)
        at = pieces[coded.indices.to_numpy()].ravel()
        each = size[at]
        ends = np.append(0, np.cumsum(each))
        first = (np.cumsum(size) - size)[at] - ends[:-1]
        out = table[np.repeat(first, each) + np.arange(ends[-1])]
        return out, ends[2 * np.cumsum(pc.list_value_length(lists).to_numpy())]


_LOADED: dict[str | None, WordTokenizer] = {}


def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """The tokenizer of this Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of 1 to 65,535 ids: header, low bits of all differences from the least id, exceptions' places and high bits.

    The width is the bits of the difference at the percentile; a wider difference is an exception and keeps its high bits apart.
    """
    least = int(ids.min())
    rest = (ids - np.uint32(least)).astype(np.uint32)
    at = min(len(ids) - 1, int(percentile * len(ids)))
    width = int(np.partition(rest, at)[at]).bit_length()
    patched = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, int)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little") if width else rest[:0]
    high = (rest[patched] >> np.uint32(width)).astype("<u4") if len(patched) else np.zeros(0, "<u4")
    return _BLOCK.pack(least, len(ids), width, len(patched)) + np.packbits(bits, bitorder="little").tobytes() + patched.astype("<u2").tobytes() + high.tobytes()


def unpack_block(raw: memoryview | bytes) -> np.ndarray:
    least, n, width, patches = _BLOCK.unpack_from(raw)
    at = _BLOCK.size
    packed = (n * width + 7) // 8
    out = np.zeros((n, 4), np.uint8)
    if width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, packed, at), count=n * width, bitorder="little").reshape(n, width)
        low = np.packbits(bits, axis=1, bitorder="little")
        out[:, : low.shape[1]] = low
    ids = out.view("<u4").ravel().copy()
    if patches:
        places = np.frombuffer(raw, "<u2", patches, at + packed)
        ids[places] |= np.frombuffer(raw, "<u4", patches, at + packed + 2 * patches) << np.uint32(width)
    return ids + np.uint32(least)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TokenWriter:
    """Writes documents' ids into one file: blocks as they fill, then the index of block starts and of documents."""

    def __init__(self, path: str, block: int = BLOCK, percentile: float = PERCENTILE):
        self.system, self.path = _open(path)
        self.out = self.system.open_output_stream(self.path)
        self.block, self.percentile = block, percentile
        self.at, self.count = 0, 0
        self.starts, self.docs, self.ends = array("q"), array("q"), array("q")
        self.nulls = bytearray()
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.count += len(ids)
        self.docs.append(0 if doc is None else doc)
        self.nulls.append(doc is None)
        self.ends.append(self.count)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, whole, self.block):
            self.starts.append(self.at)
            self._put(pack_block(ids[i : min(whole, i + self.block)], self.percentile))
        self.waiting = [ids[whole:]]
        self.held = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = b"".join((np.asarray(self.starts, "<u8").tobytes(), np.asarray(self.docs, "<i8").tobytes(), np.asarray(self.ends, "<u8").tobytes(), np.packbits(np.frombuffer(self.nulls, bool)).tobytes()))
        place = self.at
        self._put(index)
        self._put(_FOOTER.pack(len(self.starts), len(self.docs), self.count, place, zlib.crc32(index), MAGIC))
        self.out.close()


class TokenReader:
    """Reads a file of TokenWriter: its index, any range of ids by the blocks that hold it, and all documents in order."""

    def __init__(self, path: str):
        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        if size < len(MAGIC) + _FOOTER.size:
            raise ValueError(f"{path} is no token file")
        blocks, docs, self.n_ids, self.place, crc, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        index = self.file.read_at(size - _FOOTER.size - self.place, self.place) if magic == MAGIC else b""
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{path} is no whole token file")
        self.starts = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(self.place)).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.ends = np.frombuffer(index, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)
        self.nulls = np.unpackbits(np.frombuffer(index, np.uint8, -1, 8 * (blocks + 2 * docs)), count=docs).astype(bool)
        self.block = _BLOCK.unpack(self.file.read_at(_BLOCK.size, int(self.starts[0])))[1] if blocks else BLOCK

    def blocks(self, first: int, last: int) -> np.ndarray:
        """ids of the blocks first to last - 1."""
        raw = memoryview(self.file.read_at(int(self.starts[last] - self.starts[first]), int(self.starts[first])))
        cuts = self.starts[first : last + 1] - self.starts[first]
        return np.concatenate([unpack_block(raw[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]) if last > first else np.zeros(0, np.uint32)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """ids lo to hi - 1 of the file, from the blocks that hold them alone."""
        lo, hi = max(lo, 0), min(hi, self.n_ids)
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first = lo // self.block
        return self.blocks(first, (hi - 1) // self.block + 1)[lo - first * self.block : hi - first * self.block]

    def document(self, nth: int) -> np.ndarray:
        return self.ids(int(self.ends[nth - 1]) if nth else 0, int(self.ends[nth]))

    def checksums(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, ids, crc32) of every document in order; a few blocks are held at once, however long a document is."""
        doc, crc, at = 0, 0, 0
        for first in range(0, len(self.starts) - 1, READ_BLOCKS):
            ids = self.blocks(first, min(len(self.starts) - 1, first + READ_BLOCKS))
            raw, base, stop = memoryview(ids.astype("<u4").tobytes()), at, at + len(ids)
            while doc < len(self.ends) and self.ends[doc] <= stop:
                end = int(self.ends[doc])
                begin = int(self.ends[doc - 1]) if doc else 0
                yield None if self.nulls[doc] else int(self.docs[doc]), begin, end - begin, zlib.crc32(raw[4 * (at - base) : 4 * (end - base)], crc)
                doc, crc, at = doc + 1, 0, end
            crc = zlib.crc32(raw[4 * (at - base) :], crc)
            at = stop

    def close(self) -> None:
        self.file.close()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to tables of about TOGETHER bytes of texts."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Write the ids of all texts, end_id after each, in ascending order of doc_id; one row for each file.

    Returns file (int, in order), path, n_ids, n_docs, base (ids of all files before). Texts are dealt out by ranges of doc_id (rows
    that share one by a hash of the text), as many as the session's shuffle partitions unless ``files`` is given, so a task writes one file as it encodes. A task that runs again writes a file of another
    name; the row it returns, written down before anything reads it, decides which file counts. ``folder`` must be shared by
    all executors and reachable for pyarrow's file systems (local or mounted, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    folder = (folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        writer = encode = None
        for t in _together(batches):
            if writer is None and t.num_rows:
                name = f"{folder}/part-{part:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.tok"
                writer, encode = TokenWriter(name), word_tokenizer(path)
            if t.num_rows:
                ids, ends = encode(pc.fill_null(t.column(1).combine_chunks(), ""))
                for doc, a, z in zip(t.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                    writer.add(doc, np.append(ids[a:z], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "path": [name], "n_ids": [writer.count], "n_docs": [len(writer.docs)]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    key = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*[files] * bool(files), *key).sortWithinPartitions(*key)
    done = materialise(text_batches(ordered).mapInArrow(run, "file int, path string, n_ids long, n_docs long"), "token-files")
    # The running sum over files is made by blocks of files, so that no task sees all of them.
    wide = done.withColumn("block", F.floor(F.col("file") / 4096))
    blocks = wide.groupBy("block").agg(F.sum("n_ids").alias("all")).select("block", (F.sum("all").over(W.orderBy("block")) - F.col("all")).alias("lead"))
    inside = F.sum("n_ids").over(W.partitionBy("block").orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids")
    return wide.withColumn("inside", inside).join(blocks, "block").select("file", "path", "n_ids", "n_docs", (F.col("lead") + F.col("inside")).alias("base"))


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``write_tokens``, decoded from their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = TokenReader(path)
                rows = reader.checksums()
                while part := [r for _, r in zip(range(50_000), rows)]:
                    doc, start, n, crc = zip(*part)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "start": pa.array([base + s for s in start], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                reader.close()

    spark = files.sparkSession
    held = materialise(files.select("path", "base"), "token-manifest")
    parts = max(1, min(held.count(), 100 * spark.sparkContext.defaultParallelism))
    return held.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Write all documents' ids to files and give what the files hold: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone. Rows without doc_id come first, rows that share one are documents of their own in
    an order set by their texts; texts of any length are whole; other columns are ignored; an empty table writes no file.
    """
    return read_digests(write_tokens(docs, None, path, end_id, files))
