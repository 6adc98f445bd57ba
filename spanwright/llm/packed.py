"""Token ids of a table in files of fixed-width bit-packed ids.

A file image holds documents in order: a header, the document ids, the number of ids before each document,
byte offsets of blocks of `BLOCK` ids, and the ids at the least number of bits that fits the vocabulary, lowest bit
first. Blocks start at whole bytes, so any block, and any document through its blocks, can be read alone; unpacking is
numpy throughout.

A table is laid out by ranges of document ids; each task encodes its range and cuts file images of about `SHARD_IDS`
ids. The images are rows of a Parquet folder, so that they are written and read through Spark on any store.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.llm.bpe import gather
from spanwright.llm.words import groups, utf8

MAGIC = b"TOKBITS1"
BLOCK = 4096
SHARD_IDS = 2_000_000
CACHE_WORDS = 1_000_000
PIECE_BYTES = 8 << 20
_HEADER = struct.Struct("<8sBxxxIQ")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values below 2**width as little-endian bits without gaps."""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes | memoryview, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def image(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A file image of documents with so many ids each."""
    blocks = [pack_bits(ids[at:at + BLOCK], width) for at in range(0, len(ids), BLOCK)]
    return b"".join([
        _HEADER.pack(MAGIC, width, len(doc_ids), len(ids)),
        np.array([i is not None for i in doc_ids], np.uint8).tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes(),
        np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8").tobytes(), *blocks])


@dataclass
class Image:
    """A file image opened for reading; `ids` reads only the blocks that a document touches."""

    width: int
    n_ids: int
    doc_ids: list[int | None]
    before: np.ndarray
    offsets: np.ndarray
    body: memoryview

    @classmethod
    def open(cls, raw: bytes) -> Image:
        magic, width, n_docs, n_ids = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at, n_blocks = _HEADER.size, -(-n_ids // BLOCK)
        known = np.frombuffer(raw, np.uint8, n_docs, at)
        doc_ids = np.frombuffer(raw, "<i8", n_docs, at + n_docs)
        before = np.frombuffer(raw, "<u8", n_docs + 1, at + 9 * n_docs).astype(np.int64)
        offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at + 17 * n_docs + 8).astype(np.int64)
        body = memoryview(raw)[at + 17 * n_docs + 8 + 8 * (n_blocks + 1):]
        return cls(width, n_ids, [i if k else None for i, k in zip(doc_ids.tolist(), known.tolist(), strict=True)], before, offsets, body)

    def block(self, k: int) -> np.ndarray:
        return unpack_bits(self.body[self.offsets[k]:self.offsets[k + 1]], self.width, min(BLOCK, self.n_ids - k * BLOCK))

    def ids(self, doc: int) -> np.ndarray:
        low, high = self.before[doc], self.before[doc + 1]
        if low == high:
            return np.zeros(0, "<u4")
        first = low // BLOCK
        found = np.concatenate([self.block(k) for k in range(first, (high - 1) // BLOCK + 1)])
        return found[low - first * BLOCK:high - first * BLOCK]


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts by a tokenizer that drops white space: words between white space are encoded once and remembered."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.values, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        parts = []
        for low in range(0, len(words), 10_000):
            parts += [e.ids for e in self.tokenizer.encode_batch_fast(words[low:low + 10_000], add_special_tokens=False)]
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        sizes = np.array([len(p) for p in parts], np.int64)
        self.values = np.concatenate((self.values, np.array([i for p in parts for i in p], "<u4")))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text with the end id, all ids)."""
        words = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if len(self.number) > CACHE_WORDS:
            self._forget()
        self._learn([w for w in distinct if w not in self.number])
        codes = np.array([self.number[w] for w in distinct], np.int64)[flat.indices.to_numpy(zero_copy_only=False)]
        sizes = np.diff(self.bounds)[codes]
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))]
        return np.diff(cuts) + 1, np.insert(gather(self.values, self.bounds, codes), cuts[1:], end)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of this worker; what it remembers serves the next tasks too."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text and write the file images to the folder `path`.

    Rows are in ascending order of id_col (nulls first), rows with one id in the order of their texts' hashes. Each document ends
    with `end_id`; a null or empty text has only that. Repeated rows are written each. The tokenizer must drop white space.
    Columns: part and shard (the order of files), before (ids of the part in earlier shards), n_ids, payload (the image).
    """
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
            .repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        doc_ids, lengths, ids, held, before, shard = [], [], [], 0, 0, 0

        def cut() -> pa.RecordBatch:
            raw = image(doc_ids, np.concatenate(lengths), np.concatenate(ids), encoder.width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before]), pa.array([held]), pa.array([raw], pa.binary())],
                ["part", "shard", "before", "n_ids", "payload"])

        for batch in batches:
            for low, high in groups(utf8(batch.column(1))[1], PIECE_BYTES):
                piece = batch.slice(low, high - low)
                n, found = encoder.encode(piece.column(1), end_id)
                doc_ids += piece.column(0).to_pylist()
                lengths.append(n)
                ids.append(found)
                held += len(found)
                if held >= SHARD_IDS:
                    yield cut()
                    before, shard = before + held, shard + 1
                    doc_ids, lengths, ids, held = [], [], [], 0
        if doc_ids:
            yield cut()

    rows.mapInArrow(each, "part int, shard int, before long, n_ids long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder, read from the images.

    start counts the ids of all documents before it; ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per task of the writer
             .select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                opened = Image.open(raw.as_buffer().to_pybytes())
                found = [opened.ids(k) for k in range(len(opened.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(opened.doc_ids, pa.int64()), pa.array(start + opened.before[:-1]), pa.array([len(f) for f in found], pa.int64()),
                     pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "payload")
            .mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long"))
