"""Byte-level BPE over a whole table: every distinct pre-token is encoded once.

Documents are cut into blocks (runs of rows of a task). A block posts each of its distinct pre-tokens once, to
the bucket of the hash of its bytes, and numbers them in that order; the positions are one array of such numbers.
One shuffle brings equal pre-tokens of all blocks together, where each is encoded once; a second one brings the
ids back to the blocks, whose documents are reassembled by position. The pre-tokens that a block posts to one bucket
travel as one packed row, and the text's order is moved once, packed: a frequent pre-token costs one entry per
block, not a row per occurrence, and no bucket holds more because of it.

Decoding joins each id with its bytes from the rank table.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

BUCKETS_PER_PARTITION = 4
BLOCK_CHARS = 16 << 20
"""A block ends after so many characters; a longer text is a block of its own."""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(all token bytes in id order, bounds): the table that decoding joins."""
    known = encoder(path, pattern)._mergeable_ranks
    parts = [b""] * (max(known.values()) + 1)
    for raw, rank in known.items():
        parts[rank] = raw
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def gather(values: np.ndarray, bounds: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The slices `picks` of a flat array of slices, one after the other."""
    sizes = (bounds[1:] - bounds[:-1])[picks]
    ends = np.cumsum(sizes)
    at = np.repeat(bounds[picks] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return values[at]


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    return gather(*token_bytes(path, pattern), ids).tobytes()


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as compressed byte planes."""
    return zlib.compress(b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays), 1)


def _numbers(raw: bytes) -> np.ndarray:
    """One array that was squeezed."""
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


class _Block:
    """Distinct pre-tokens of a run of documents, and the positions as numbers of them."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.positions: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_ids: pa.Array, texts: list[str], pieces: regex.Pattern) -> None:
        found = [pieces.findall(t) for t in texts]
        flat = pa.array([p for piece in found for p in piece], pa.string()).dictionary_encode()
        known = self.number
        own = np.array([known.setdefault(w, len(known)) for w in flat.dictionary.to_pylist()], np.int64)
        self.positions.append(own[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64))
        self.doc_ids.append(doc_ids)
        self.counts.append(np.array([len(piece) for piece in found], np.int64))
        self.chars += sum(map(len, texts))

    def posted(self, buckets: int) -> tuple[dict[int, list[bytes]], bytes]:
        """(sorted pre-tokens by bucket, squeezed positions): a position counts through the buckets in order."""
        words = [w.encode() for w in self.number]
        order = sorted(range(len(words)), key=lambda k: (zlib.crc32(words[k]) % buckets, words[k]))
        by_bucket: dict[int, list[bytes]] = {}
        for k in order:
            by_bucket.setdefault(zlib.crc32(words[k]) % buckets, []).append(words[k])
        renumbered = np.empty(len(words), np.int64)
        renumbered[order] = np.arange(len(words))
        return by_bucket, _squeezed(renumbered[np.concatenate(self.positions)])


def _words_packed(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words])
    return len(words).to_bytes(4, "little") + zlib.compress(sizes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(words), 1)


def _words_unpacked(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:4], "little")
    body = zlib.decompress(raw[4:])
    ends = 4 * n + np.cumsum(np.frombuffer(body, np.uint8, 4 * n).reshape(4, -1).T.copy().view("<u4").reshape(-1))
    return [body[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): the BPE ids of every row's whole text; each match of `pattern` is encoded by itself.

    A null or empty text has no ids. Null ids and repeated rows are kept, one result row per row. Other columns are
    ignored. The rank file must be readable under `path` on every executor.
    """
    return _reassembled(docs, path, pattern, id_col, text_col, digest=False)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) per row: encoded, then decoded again; see `encode`.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers.
    """
    return _reassembled(docs, path, pattern, id_col, text_col, digest=True)


def _reassembled(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_PARTITION * partitions
    row = f"block string, bucket int, words binary, doc_ids array<{kind}>, counts array<int>, positions binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, task = regex.compile(pattern), TaskContext.get().partitionId()
        block, n = _Block(), 0
        schema = None
        for batch in batches:
            schema = batch.schema
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                block.add(part.column(0), [t or "" for t in part.column(1).to_pylist()], pieces)
                if block.chars >= BLOCK_CHARS:
                    yield from posted(block, f"{task}-{n}", schema)
                    block, n = _Block(), n + 1
        if block.doc_ids:
            yield from posted(block, f"{task}-{n}", schema)

    def posted(block: _Block, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        id_type = pa.list_(schema.field(0).type)
        names = ["block", "bucket", "words", "doc_ids", "counts", "positions"]
        ids, counts = pa.concat_arrays(block.doc_ids), np.concatenate(block.counts)
        by_bucket, positions = block.posted(buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([positions], pa.binary())], names)
        n = len(by_bucket)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * n, pa.string()), pa.array(list(by_bucket), pa.int32()), pa.array([_words_packed(w) for w in by_bucket.values()], pa.binary()),
             pa.nulls(n, id_type), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary())], names)

    posted_rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, row)
                   .withColumn("key", F.coalesce(F.col("bucket").cast("string"), F.col("block")))
                   .repartition(partitions, "key"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = encoder(path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}  # the distinct pre-tokens of one partition
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(2)))
            out = []
            for raw in batch.column(2):
                words = _words_unpacked(raw.as_py())
                for w in words:
                    if w not in known:
                        known[w] = piece(w)
                sizes = np.array([len(known[w]) for w in words])
                out.append(len(words).to_bytes(4, "little") + _squeezed(sizes, np.array([i for w in words for i in known[w]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    ids = posted_rows.mapInArrow(encoded, "block string, bucket int, ids binary")
    # The rows of positions already lie by block. The condition is marked as not deterministic and all columns are
    # kept, so that this branch reads the same shuffle as the other one instead of cutting the documents again.
    texts = posted_rows.where(F.when(F.spark_partition_id() >= 0, F.col("bucket").isNull()))
    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"id {kind}, ids array<int>"

    def assemble(left: list[pa.RecordBatch], right: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in right if batch.num_rows]
        if not rows:
            return
        answers = sorted((b, raw) for batch in left for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("ids").to_pylist(), strict=True))
        sizes, values = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
        for _, raw in answers:
            n, body = int.from_bytes(raw[:4], "little"), zlib.decompress(raw[4:])
            for part, into in ((body[:4 * n], sizes), (body[4 * n:], values)):
                into.append(np.frombuffer(part, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1))
        values = np.concatenate(values)
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes).astype(np.int64))))
        for batch in rows:
            for k in range(batch.num_rows):
                docs_of = batch.column("doc_ids").slice(k, 1).flatten()
                cuts = np.concatenate(([0], np.cumsum(batch.column("counts")[k].as_py())))
                yield from results(docs_of, cuts, _numbers(batch.column("positions")[k].as_py()), values, bounds)

    def results(docs_of: pa.Array, cuts: np.ndarray, positions: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(docs_of), 256):
            part = docs_of.slice(low, 256)
            found = [gather(values, bounds, positions[cuts[low + i]:cuts[low + i + 1]]) for i in range(len(part))]
            if digest:
                columns = [pa.array([len(f) for f in found], pa.int64()),
                           pa.array([hashlib.sha256(f.tobytes()).hexdigest() for f in found]),
                           pa.array([hashlib.sha256(decode(f, path, pattern)).hexdigest() for f in found])]
                yield pa.RecordBatch.from_arrays([part, *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
                flat = pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32())
                yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(offsets, flat)], ["id", "ids"])

    result = to_arrow_schema(spark.createDataFrame([], out).schema)
    return (ids.withColumn("key", F.col("block")).groupBy("key").cogroup(texts.groupBy("key"))
            .applyInArrow(lambda a, b: pa.Table.from_batches(list(assemble(a.to_batches(), b.to_batches())), schema=result), out)
            .withColumnRenamed("id", id_col))


def decoded(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with a binary column `decoded`: the bytes of the ids, joined from the token table. Null ids stay null."""
    schema = encoded.withColumn("decoded", F.lit(None).cast("binary")).schema
    at = encoded.columns.index(ids_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if v is None else decode(np.array(v, np.int64), path, pattern) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], schema.names)

    return encoded.mapInArrow(each, schema)
