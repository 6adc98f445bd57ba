"""N-gram Jaccard join through a matrix of tokens and document groups.

Texts with equal shingle sets are one class. Similar classes form groups of at most `GROUP` members, and
a group is known by the union of its members' tokens. A class can only have a partner in a group with
enough of its tokens, so groups meet as wholes, and only pairs of groups that qualify are opened:

* tokens have one global order, rare ones first, from a count table of fixed size (`SKETCH` cells; it only
  orders, any error in it costs speed). Two linked sets share their first `meet` common tokens, and these lie in the
  first `size - need + meet` of either set. `meet` grows with the smaller size, since large sets share a few tokens by
  chance. The matrix holds these prefixes: (token, group). Sets with too few tokens that others hold too are left out;
* groups that share fewer than `meet` such tokens, or whose sizes are too far apart, stay closed;
* so do groups whose members are all in one component already: each group is opened first with the
  group that it shares most tokens with by being first in their lists, and only lists not settled by these links are
  paired out, group by group.

An opened pair is one product of two bit matrices (members x shared tokens), which gives all intersections
of two groups exactly; of the links found it returns a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.blocks import blocks_of, digest, grouped, members_of, opened, shingle_sets
from spanwright.llm.minhash import connect
from spanwright.llm.words import U64, mix
from spanwright.session import durable

MEET = 4
"""Common tokens that the prefixes of a linked pair share at least; one more for every `STEP` tokens of the smaller set."""
STEP = 50
SKETCH = 1 << 22


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def token_counts(docs: DataFrame, width: int, text_col: str):
    """A broadcast table of how often tokens fall into each cell; SKETCH cells, whatever the input.

    A task hands over a byte for each cell (255 for more), in pieces that are summed apart.
    """
    piece = SKETCH >> 8

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH, np.int32)
        for batch in batches:
            if batch.num_rows:
                for s in shingle_sets(batch.column(0), width):
                    np.add.at(seen, _cells(s), 1)
        low = np.minimum(seen, 255).astype(np.uint8)
        at = [k for k in range(256) if low[k * piece:(k + 1) * piece].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([low[k * piece:(k + 1) * piece].tobytes() for k in at], pa.binary())],
                                         ["piece", "counts"])

    def summed(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(piece, np.int64)
        for part in parts:
            for k in range(part.num_rows):
                total += np.frombuffer(part.column(1)[k].as_buffer(), np.uint8)
        counts = np.minimum(total, 65535).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([counts], pa.binary())], ["piece", "counts"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(each, "piece int, counts binary")
    found = parts.groupBy("piece").applyInArrow(summed, "piece int, counts binary").toArrow()
    counts = np.zeros(SKETCH, np.uint16)
    for at, part in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        counts[at * piece:(at + 1) * piece] = np.frombuffer(part, np.uint16)
    return docs.sparkSession.sparkContext.broadcast(counts)


def need(sizes, percent: int):
    """Least number of common tokens that a partner of a set of this size has with it."""
    return (sizes * percent + 99) // 100


def meet(sizes):
    """Common tokens that the prefixes of two linked sets share at least, by the size of the smaller one."""
    return MEET + sizes // STEP


def _meet(size: str) -> Column:
    return MEET + F.floor(F.col(size) / STEP)


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set in the global order; none if only an equal set could be linked."""
    spare = len(tokens) - need(len(tokens), percent)
    if len(tokens) * 100 < (len(tokens) + 1) * percent:  # too small even for a partner with one more token
        return np.zeros(0, U64)
    order = np.lexsort((tokens, counts[_cells(tokens)]))
    return tokens[order[:spare + meet(len(tokens))]]


def described(docs: DataFrame, width: int, percent: int, counts, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set_id, m1, m2, prefix) per row; set_id is null for an empty set, prefix empty where no partner is possible."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width)) if batch.num_rows else []
            firsts = [prefix(s, order, percent) for s in sets]
            least = [[int(mix(s ^ U64(salt)).min() >> U64(1)) if len(s) else None for s in sets] for salt in (0, 0x5D)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(f) for f in firsts]))), pa.int32()),
                                             pa.array(np.concatenate([*firsts, np.zeros(0, U64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), *[pa.array(v, pa.int64()) for v in least], lists],
                ["id", "n", "set_id", "m1", "m2", "prefix"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        each, f"id {kind}, n bigint, set_id binary, m1 bigint, m2 bigint, prefix array<bigint>")


def _fit(a: str, b: str, percent: int) -> Column:
    """Sizes of two groups (lo, hi with these endings) that leave room for a link."""
    return (F.col("hi" + a) * 100 >= F.col("lo" + b) * percent) & (F.col("hi" + b) * 100 >= F.col("lo" + a) * percent)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than `width` words is one
    shingle. Rows are linked when 100 * intersection >= percent * union of their shingle sets (64-bit hashes);
    component_id is the smallest id reachable over links. No link between different texts is lost.

    A null or empty text has no shingles and is linked with nothing. A row with a null id has a null component. Repeated
    rows are members of one component. Rows with one id and different texts share its component where either is
    linked. Other columns are ignored, whatever their names. An empty table gives an empty result. `percent` below 80
    is refused: a linked pair of small sets could have fewer than MEET tokens in common.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    counts = token_counts(docs, width, text_col)
    rows = durable(described(docs, width, percent, counts, id_col, text_col))
    usable = F.col("id").isNotNull() & F.col("set_id").isNotNull()
    classes = durable(rows.where(usable).groupBy("set_id").agg(
        F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "m1", "m2", "prefix")])).withColumn("c", F.monotonically_increasing_id())
    named = _class_components(docs, classes, width, percent, id_col, text_col)
    # a component is named by the smallest id of its classes
    lowest = durable(named.join(classes.select(F.col("c").alias("rep"), F.col("rep").alias("id"), "set_id"), "rep"))
    least = lowest.groupBy("component").agg(F.min("id").alias("least"))
    moved = lowest.join(least, "component").select("set_id", "least")
    known = classes.select("set_id", "rep").join(moved, "set_id", "left")
    component = F.when(F.col("set_id").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("least", "rep"))
    return rows.select("id", "n", "set_id").join(known, "set_id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _class_components(docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, component) of the numbers of all classes that may have a link."""
    postings = classes.select("c", "n", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = durable(postings.join(shared.select("token"), "token"))
    # the smallest partner of a set of n tokens has need(n) of them
    able = (met.groupBy("c", F.expr(f"(n * {percent} + 99) div 100").alias("least")).agg(F.count(F.lit(1)).alias("k"))
            .where(F.col("k") >= _meet("least")).select("c"))
    placed = durable(grouped(classes.join(able, "c")))
    span = placed.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("members"))
    matrix = durable(met.select("c", "token").join(placed.select("c", "g"), "c").select("token", "g").distinct().join(span.drop("members"), "g"))
    labels = placed.select(F.col("c").alias("rep"), F.col("c").alias("component"))

    # each group with the one that is first in most of its lists
    first = Window.partitionBy("g").orderBy(F.desc("k"), "g2")
    heads = matrix.groupBy("token").agg(F.min(F.struct("g", "lo", "hi")).alias("h"))
    hubs = (matrix.join(heads, "token").select("g", "lo", "hi", F.col("h.g").alias("g2"), F.col("h.lo").alias("lo2"), F.col("h.hi").alias("hi2"))
            .where((F.col("g") != F.col("g2")) & _fit("", "2", percent)).groupBy("g", "g2", F.least("lo", "lo2").alias("least"))
            .agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= _meet("least")).withColumn("at", F.row_number().over(first)).where("at = 1"))
    tried = durable(hubs.select(F.least("g", "g2").alias("g"), F.greatest("g", "g2").alias("g2")).distinct())

    def built(wanted: DataFrame) -> DataFrame:
        members = placed.join(wanted, "g").select("rep", "set_id", "g", "c")
        return durable(blocks_of(members_of(docs, members, width, id_col, text_col), percent))

    wanted = tried.select("g").union(tried.select("g2")).union(span.where("members > 1").select("g")).distinct()
    blocks = built(wanted)
    links = durable(blocks.select(F.inline("links")).union(opened(tried, blocks, percent)))
    after = connect(labels, links)

    # lists whose groups are not all in one component are paired out, group by group
    of = placed.select(F.col("c").alias("rep"), "g").join(after, "rep").groupBy("g").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    at = matrix.join(of, "g")
    open_ = at.groupBy("token").agg(F.min("c1").alias("l"), F.max("c2").alias("h")).where("l < h").select("token")
    here = durable(at.join(open_, "token"))
    other = here.select("token", *[F.col(c).alias(c + "2") for c in ("g", "lo", "hi")], F.col("c1").alias("d1"), F.col("c2").alias("d2"))
    settled = (F.col("c1") == F.col("c2")) & (F.col("d1") == F.col("d2")) & (F.col("c1") == F.col("d1"))
    pairs = durable(here.join(other, "token").where((F.col("g") < F.col("g2")) & _fit("", "2", percent) & ~settled)
                    .groupBy("g", "g2", F.least("lo", "lo2").alias("least")).agg(F.count(F.lit(1)).alias("k"))
                    .where(F.col("k") >= _meet("least")).select("g", "g2")
                    .join(tried, ["g", "g2"], "left_anti"))
    more = pairs.select("g").union(pairs.select("g2")).distinct().join(blocks.select("g"), "g", "left_anti")
    extra = built(more)
    late = durable(extra.select(F.inline("links")).union(opened(pairs, blocks.union(extra), percent)))
    return connect(after, late)
