"""Groups of similar shingle sets as bit matrices, and exact links between the members of two groups.

A group has at most `GROUP` classes. It is kept as the union of its members' tokens with a mask of holders for each; one
product of two such matrices gives all intersections of two groups, so near copies never travel pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.words import U64, groups, row_slices, shingles, utf8, word_hashes

GROUP = 32
"""Members of a group at most: the bits of one mask."""
SLOTS = 1 << 19
"""Bound of the tables of hashed ids by which texts and matrices are filtered before they are shuffled."""


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, bounds = utf8(column)
    for low, high in groups(bounds):
        rows, words = word_hashes(data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low])
        cuts = row_slices(rows, high - low)
        for k in range(high - low):
            yield np.unique(shingles(words[cuts[k]:cuts[k + 1]], width))


def digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def grouped(classes: DataFrame) -> DataFrame:
    """(c, g, n, rep, set_id): similar classes in groups of at most GROUP, from one sort by two minimum values.

    Range partitions are cut anywhere between classes, so that not even equal minimum values make a large task.
    """
    kind = classes.schema["rep"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, g, held = None, -1, 0
        for batch in batches:
            numbers = []
            for part, m1 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m1 != last or held == GROUP:
                    last, g, held = m1, g + 1, 0
                held += 1
                numbers.append((part << 36) + g)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(numbers, pa.int64()), *batch.columns[3:]], ["c", "g", "n", "rep", "set_id"])

    placed = classes.repartitionByRange("m1", "m2", "c").sortWithinPartitions("m1", "m2", "c")
    return placed.select(F.spark_partition_id().alias("part"), "m1", "c", "n", "rep", "set_id").mapInArrow(
        each, f"c bigint, g bigint, n bigint, rep {kind}, set_id binary")


def members_of(docs: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(g, c, tokens) of the classes, from the texts of their representatives."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(SLOTS)).cast("int").alias("slot")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).where("rep is not null")
    few = texts.withColumn("slot", slot).join(F.broadcast(classes.select(slot).distinct()), "slot", "left_semi").drop("slot")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, done = batch.column(3).to_pylist(), []
            for k, s in enumerate(shingle_sets(batch.column(0), width) if batch.num_rows else []):
                if digest(s) == want[k]:  # another row may have the same id
                    done.append((k, s.tobytes()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array([k for k, _ in done], pa.int64())) for i in (1, 2)],
                                              pa.array([b for _, b in done], pa.binary())], ["g", "c", "tokens"])

    return few.join(classes, "rep").select("text", "g", "c", "set_id").mapInArrow(each, "g bigint, c bigint, tokens binary")


def _matrix(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(union, mask of the members that hold it) of the tokens of up to GROUP sets."""
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    order = np.argsort(flat, kind="stable")
    tokens = flat[order]
    heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    return tokens[heads], np.bitwise_or.reduceat(np.left_shift(np.uint32(1), owner[order].astype(np.uint32)), heads)


def _bits(masks: np.ndarray, width: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(width, dtype=np.uint32) & np.uint32(1)).astype(np.float32)


def _common(one: tuple, two: tuple) -> np.ndarray:
    """Intersection sizes of all members of two groups, each (sizes, union, masks)."""
    _, at, other = np.intersect1d(one[1], two[1], assume_unique=True, return_indices=True)
    total = np.zeros((len(one[0]), len(two[0])))
    for low in range(0, len(at), 1 << 16):  # exact: float32 counts up to 2^24
        total += _bits(one[2][at[low:low + (1 << 16)]], len(one[0])).T @ _bits(two[2][other[low:low + (1 << 16)]], len(two[0]))
    return total


def _forest(pairs: list[tuple[int, int]], known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """The pairs that connect something not connected by `known` or the ones before."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in known:
        top[root(b)] = root(a)
    kept = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            top[rb] = ra
            kept.append((a, b))
    return kept


def _links(one: tuple, two: tuple, ids: list[int], ids2: list[int], percent: int,
           known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    common = _common(one, two)
    sizes, sizes2 = np.asarray(one[0], float), np.asarray(two[0], float)
    found = np.argwhere(common * 100 >= (sizes[:, None] + sizes2[None, :] - common) * percent)
    return _forest([(ids[a], ids2[b]) for a, b in found.tolist() if ids[a] != ids2[b]], known)


_LINKS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _as_links(pairs: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": min(p), "b": max(p)} for p in x] for x in pairs], _LINKS)


def blocks_of(members: DataFrame, percent: int) -> DataFrame:
    """(g, ids, sizes, tokens, masks, links): the matrix of each group and the links inside it."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(g: int, held: list) -> pa.RecordBatch:
            sets = [s for _, s in held]
            ids = [c for c, _ in held]
            tokens, masks = _matrix(sets)
            sizes = [len(s) for s in sets]
            inside = _links((sizes, tokens, masks), (sizes, tokens, masks), ids, ids, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([g]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([tokens.tobytes()], pa.binary()), pa.array([masks.tobytes()], pa.binary()), _as_links([inside])],
                ["g", "ids", "sizes", "tokens", "masks", "links"])

        now, held = None, []
        for batch in batches:
            out = []
            for g, c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g != now:
                    out += [row(now, held)] if held else []
                    now, held = g, []
                held.append((c, np.frombuffer(raw.as_buffer(), U64)))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if held:
            yield row(now, held)

    return members.repartition("g").sortWithinPartitions("g").mapInArrow(
        each, "g bigint, ids array<bigint>, sizes array<bigint>, tokens binary, masks binary, links array<struct<a:bigint,b:bigint>>")


def opened(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the members of each pair of groups (g, g2) that connect more than those inside the two do."""
    fields = ("ids", "sizes", "tokens", "masks", "links")
    slot = F.pmod(F.xxhash64("g"), F.lit(SLOTS)).cast("int").alias("slot")  # the matrices of other groups stay where they are
    wanted = pairs.select("g").union(pairs.select("g2")).select(slot).distinct()
    blocks = blocks.withColumn("slot", slot).join(F.broadcast(wanted), "slot", "left_semi").drop("slot")
    for at, end in (("g", ""), ("g2", "2")):
        pairs = pairs.join(blocks.select(F.col("g").alias(at), *[F.col(f).alias(f + end) for f in fields]).hint("merge"), at)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, inside, ids2, sizes2, inside2 = (batch.column(k).to_pylist() for k in (0, 1, 4, 5, 6, 9))
            found = []
            for k in range(batch.num_rows):
                tokens, tokens2 = (np.frombuffer(batch.column(c)[k].as_buffer(), U64) for c in (2, 7))
                masks, masks2 = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in (3, 8))
                found += _links((sizes[k], tokens, masks), (sizes2[k], tokens2, masks2), ids[k], ids2[k], percent,
                                [(x["a"], x["b"]) for x in inside[k] + inside2[k]])
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    return pairs.select(*fields, *[f + "2" for f in fields]).mapInArrow(each, "a bigint, b bigint")
