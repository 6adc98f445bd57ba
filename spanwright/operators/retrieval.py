"""Exact top-k retrieval: BM25 by blocks of queries and entries, dense block products, rank fusion.

entries(ord, code, description, norm[, vector]); queries(key, norm[, vector]), one row per
distinct query. hits(key, rank, code, score, description) with 0-based rank.
"""

from __future__ import annotations

import math
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.functions.text import tokens
from spanwright.session import broadcast_if_small, durable

# Okapi constants, over-fetch factor and fusion constant.
K1, B, EPSILON = 1.5, 0.75, 0.25
OVERFETCH = 3
RRF_K = 60

QUERY_ROWS = 4096          # queries, entries and postings of a block
BLOCK_ENTRIES = 65_536
HOT_POSTINGS = 2_000_000


def query_keys(mentions: DataFrame, norm: str = "norm") -> DataFrame:
    """Distinct queries: a mention repeated in a third of all rows is searched once."""
    return mentions.select(F.md5(F.encode(F.col(norm), "UTF-8")).alias("key"),
                           F.col(norm).alias("norm")).distinct()


def top_ranked(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).withColumn(
        name, F.col("_n") - 1).drop("_n")


class Index(NamedTuple):
    """Tokens of the entries and the weight of every term; kept for several searches."""

    split: DataFrame   # (ord, t, dl)
    idf: DataFrame     # (term, df, idf)
    length: float      # mean number of tokens


def bm25_index(entries: DataFrame) -> Index:
    """Tokens per entry and idf per term, from one reading of the entries.

    A term is counted once per entry, so the counts are combined where the entries are read and only one row per term
    and task is shuffled. Postings are made per search, for the terms of its queries.
    """
    split = durable(entries.select("ord", tokens(F.col("norm")).alias("t")).withColumn("dl", F.greatest(F.size("t"), F.lit(0))))
    totals = split.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avgdl")).first()
    n_docs, avgdl = totals["n_docs"], totals["avgdl"] or 1.0
    raw = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    counted = durable(split.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term")
                      .agg(F.count("*").alias("df")).withColumn("idf", raw))
    mean_idf = counted.agg(F.avg("idf")).first()[0] or 0.0
    floor = F.when(F.col("idf") < 0, F.lit(EPSILON * mean_idf)).otherwise(F.col("idf"))
    return Index(split, counted.select("term", "df", floor.alias("idf")), avgdl)


def bm25_search(queries: DataFrame, entries: DataFrame, k: int = 20, index: Index | None = None) -> DataFrame:
    """Exact BM25 top-k, including the zero-score entries that fill up short result lists.

    Entries keep their postings together, so a score is summed where its entry lies and no (query, entry) pair is
    shuffled: queries and entries are cut into blocks of bounded size, a block pair is one task that adds the posting
    lists of a query as arrays, and only the best entries per query leave it. Only terms that some query holds are posted.
    """
    index = bm25_index(entries) if index is None else index
    depth = OVERFETCH * k
    asked = durable(queries.select("key", tokens(F.col("norm")).alias("t")))
    known = asked.select(F.explode("t").alias("term")).distinct().join(index.idf, "term")
    terms = durable(known.withColumn("tid", F.monotonically_increasing_id()))
    size = asked.count(), index.split.count(), terms.agg(F.sum("df")).first()[0] or 0
    n_q = max(1, math.ceil(size[0] / QUERY_ROWS))
    n_e = max(1, math.ceil(size[1] / BLOCK_ENTRIES), min(size[1], math.ceil(size[2] / HOT_POSTINGS)))
    terms = broadcast_if_small(terms)

    def blocks(df: DataFrame, name: str, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64(name), F.lit(own)).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    # a row without a term stands for each query and each entry, also for those that share no term
    alone = [F.lit(None).cast("long").alias("tid"), F.lit(0.0).alias("w")]
    left = (asked.select("key", F.explode("t").alias("term")).groupBy("key", "term").agg(F.count("*").alias("qtf"))
            .join(terms.select("term", "tid"), "term").select("key", F.col("tid").alias("tid"), F.col("qtf").cast("double").alias("w"))
            .unionByName(asked.select("key", *alone)))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.length))
    right = (index.split.select("ord", "dl", F.explode("t").alias("term")).join(terms.select("term", "tid", "idf"), "term")
             .groupBy("ord", "tid").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("idf").alias("idf"))
             .select("ord", F.col("tid").alias("tid"), (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("w"))
             .unionByName(index.split.select("ord", *alone)))
    schema = T.StructType([left.schema["key"], right.schema["ord"], T.StructField("score", T.DoubleType())])
    parts = (blocks(left, "key", n_q, n_e, "qb", "eb").groupBy("qb", "eb")
             .cogroup(blocks(right, "ord", n_e, n_q, "eb", "qb").groupBy("qb", "eb")).applyInArrow(_block_scores(depth), schema))
    ranked = durable(top_ranked(parts, ["key"], [F.desc("score"), F.asc("ord")], depth, "pos"))
    return best_per_code(broadcast_if_small(ranked).join(entries.select("ord", "code", "description"), "ord"), k)


def _block_scores(depth: int):
    """The best `depth` entries of one block for every query of one block: score, then ord."""

    def run(q: pa.Table, e: pa.Table) -> pa.Table:
        kind = pa.schema([("key", q.schema.field("key").type), ("ord", e.schema.field("ord").type), ("score", pa.float64())])
        ords = np.sort(e["ord"].filter(pc.is_null(e["tid"])).to_numpy())
        keys = q["key"].filter(pc.is_null(q["tid"])).combine_chunks()
        if not len(ords) or not len(keys):
            return kind.empty_table()
        e, q = e.filter(pc.is_valid(e["tid"])), q.filter(pc.is_valid(q["tid"]))
        tid = e["tid"].to_numpy()
        by_term = np.argsort(tid, kind="stable")
        place, weight = np.searchsorted(ords, e["ord"].to_numpy())[by_term], e["w"].to_numpy()[by_term]
        asked, times = q["tid"].to_numpy(), q["w"].to_numpy()
        first, last = (np.searchsorted(tid[by_term], asked, side) for side in ("left", "right"))
        whose = pc.index_in(q["key"], value_set=keys).to_numpy()
        of_query = np.argsort(whose, kind="stable")
        ends = np.searchsorted(whose[of_query], np.arange(len(keys) + 1))
        kept, n = min(depth, len(ords)), len(ords)
        took, scores = np.empty((len(keys), kept), dtype="int64"), np.empty((len(keys), kept))
        for i in range(len(keys)):
            mine = [j for j in of_query[ends[i]:ends[i + 1]] if first[j] < last[j]]
            total = np.zeros(n)
            if mine:
                total = np.round(np.bincount(np.concatenate([place[first[j]:last[j]] for j in mine]),
                                             np.concatenate([weight[first[j]:last[j]] * times[j] for j in mine]), n), 9)
            # all above the last useful score, then the first entries that have it
            edge = -np.partition(-total, kept - 1)[kept - 1]
            above = np.flatnonzero(total > edge)
            picked = np.concatenate([above, np.flatnonzero(total == edge)[:kept - len(above)]])
            took[i], scores[i] = picked, total[picked]
        return pa.Table.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(keys)), kept))),
                                     pa.array(ords[took.ravel()], kind.field("ord").type), pa.array(scores.ravel())], schema=kind)

    return run


def number_entries(entries: DataFrame) -> DataFrame:
    """(ord, slot): entries numbered from 0 by ord, range by range.

    Entries go to ranges of ord, each range is numbered by itself, and the counts of the ranges before it (one number
    per shuffle partition) are added.
    """
    ranges = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(entries.select("ord").repartitionByRange(ranges, "ord").withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0) + 1))]
    own = F.row_number().over(Window.partitionBy("range").orderBy("ord")) - 1
    return placed.select("ord", (F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("range")) + own).alias("slot"))


def _zero_fill(queries: DataFrame, scored: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """The `depth` lowest-ord entries without any query term, for queries with fewer than `depth` hits.

    The numbers of a query's scored entries, whatever their sign, are sorted; the free numbers are the gaps between
    them, and only the gaps that hold the first `depth` free numbers are listed.
    """
    hits = scored.groupBy("key").agg(F.count_if(F.col("score") > 0).alias("n"))
    short = durable(queries.select("key").join(hits, "key", "left").fillna(0, ["n"]).filter(F.col("n") < depth).select("key"))
    slots = durable(number_entries(entries))
    total = slots.count()
    taken = scored.join(short, "key", "left_semi").join(slots, "ord").select("key", "slot")
    ends = taken.unionByName(short.select("key", F.lit(total).cast("long").alias("slot")))
    w = Window.partitionBy("key").orderBy("slot")
    gaps = (ends.withColumn("at", F.coalesce(F.lag("slot").over(w) + 1, F.lit(0).cast("long")))
            .withColumn("free", F.col("at") - (F.row_number().over(w) - 1))  # free numbers before this gap
            .withColumn("to", F.least(F.col("slot"), F.col("at") + depth - F.col("free")) - 1).filter("at <= to"))
    wanted = durable(gaps.select("key", F.explode(F.sequence("at", "to")).alias("slot")))
    pool = slots.join(wanted.select("slot").distinct(), "slot", "left_semi")
    return wanted.join(broadcast_if_small(pool), "slot").select("key", "ord", F.lit(0.0).alias("score"))


def best_per_code(ranked: DataFrame, k: int) -> DataFrame:
    """First position of every code, then the top k codes."""
    first = ranked.groupBy("key", "code").agg(
        F.min_by(F.struct("score", "description"), "pos").alias("b"), F.min("pos").alias("pos"))
    return top_ranked(first.select("key", "code", "pos", "b.score", "b.description"), ["key"],
                      [F.asc("pos")], k).select("key", "rank", "code", "score", "description")


BLOCK_ROWS = 65_536                            # rows of a block, and bytes of its vectors
QUERY_BYTES, ENTRY_BYTES = 4 << 20, 16 << 20
TILE = 512, 8192                               # queries and entries multiplied at once


def dense_search(queries: DataFrame, entries: DataFrame, k: int = 20) -> DataFrame:
    """Exact inner-product top-k over L2-normalised vectors.

    Both sides are packed to hash blocks of bounded size, one row of plain numbers each; each block pair is one task of
    small matrix products, and only the best rows per query leave it. Shuffled are queries x entry blocks and entries x query blocks.
    """
    depth = OVERFETCH * k
    kind = queries.schema["vector"].dataType
    width = 4 if kind == entries.schema["vector"].dataType == T.ArrayType(T.FloatType(), kind.containsNull) else 8
    slots = 2 * queries.sparkSession.sparkContext.defaultParallelism

    def number(df: DataFrame, size: int, least: int = 1) -> int:
        rows, dim = df.agg(F.count("*"), F.max(F.size("vector"))).first()
        return max(1, min(least, rows), math.ceil(rows / BLOCK_ROWS), math.ceil(rows * width * max(dim or 1, 1) / size))

    n_q, n_e = number(queries, QUERY_BYTES, slots), number(entries, ENTRY_BYTES)

    def blocks(df: DataFrame, name: str, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        packed = df.select(F.pmod(F.xxhash64(name), F.lit(own)).cast("int").alias(mine), F.col(name).alias("id"),
                           F.col("vector").cast(f"array<{'float' if width == 4 else 'double'}>").alias("vector"))
        shape = T.StructType([T.StructField(mine, T.IntegerType()), T.StructField("ids", T.ArrayType(df.schema[name].dataType)),
                              T.StructField("vectors", T.BinaryType())])
        return packed.groupBy(mine).applyInArrow(_packed(mine), shape).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = blocks(queries, "key", n_q, n_e, "qb", "eb")
    right = blocks(entries, "ord", n_e, n_q, "eb", "qb")
    schema = T.StructType([queries.schema["key"], entries.schema["ord"], T.StructField("score", T.DoubleType())])
    parts = left.groupBy("qb", "eb").cogroup(right.groupBy("qb", "eb")).applyInArrow(_block_products(depth, width), schema)
    ranked = top_ranked(parts, ["key"], [F.desc("score"), F.asc("ord")], depth, "pos")
    return best_per_code(ranked.join(entries.select("ord", "code", "description"), "ord"), k)


def _packed(name: str):
    """One row of a block: its ids, and its vectors one after another."""

    def run(rows: pa.Table) -> pa.Table:
        vectors = rows["vector"].combine_chunks()
        numbers, sizes = vectors.flatten(), pc.list_value_length(vectors)
        if vectors.null_count or numbers.null_count or len(pc.unique(sizes)) > 1:
            raise ValueError("vectors must be whole and of one length")
        ids = rows["id"].combine_chunks()
        return pa.Table.from_arrays([rows[name].slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                                     pa.array([numbers.to_numpy(zero_copy_only=False).tobytes()], pa.binary())], [name, "ids", "vectors"])

    return run


def _block_products(depth: int, width: int):
    """The best `depth` entries of one block for every query of one block: score, then ord."""

    def matrix(block: pa.Table) -> tuple[pa.Array, np.ndarray]:
        ids = block["ids"].combine_chunks().flatten()
        return ids, np.frombuffer(block["vectors"][0].as_buffer(), f"<f{width}").reshape(len(ids), -1)

    def run(q: pa.Table, e: pa.Table) -> pa.Table:
        kind = pa.schema([("key", q.schema.field("ids").type.value_type), ("ord", e.schema.field("ids").type.value_type), ("score", pa.float64())])
        if not len(q) or not len(e):
            return kind.empty_table()
        (keys, asked), (ords, known) = matrix(q), matrix(e)
        order = pc.sort_indices(ords)
        ords, known = ords.take(order), known[order.to_numpy()].astype(np.float64)
        found = [_best(asked[low:low + TILE[0]].astype(np.float64), known, depth) for low in range(0, len(keys), TILE[0])]
        row = np.concatenate([at + n * TILE[0] for n, (at, _, _) in enumerate(found)])
        return pa.Table.from_arrays([keys.take(pa.array(row)), ords.take(pa.array(np.concatenate([c for _, c, _ in found]))),
                                     pa.array(np.concatenate([s for _, _, s in found]))], schema=kind)

    return run


def _best(asked: np.ndarray, known: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the best `depth` columns of every row of asked x known; of equal scores the first columns.

    Only products that reach the last of the best so far are rounded and compared.
    """
    row, column, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(asked), -np.inf)
    for low in range(0, len(known), TILE[1]):
        sims = asked @ known[low:low + TILE[1]].T
        if low == 0 and sims.shape[1] > depth:
            least = np.partition(sims, -depth, axis=1)[:, -depth]
        r, c = np.nonzero(~(sims < (least - 1e-8)[:, None]))
        row, column, score = (np.concatenate(pair) for pair in ((row, r), (column, c + low), (score, np.round(sims[r, c], 9))))
        order = np.lexsort((column, -score, row))
        row, column, score = row[order], column[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < depth
        row, column, score, place = row[kept], column[kept], score[kept], place[kept]
        last = place == depth - 1
        least[row[last]] = score[last]
    return row, column, score


def fuse(rankings: list[DataFrame], k: int = 20, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties and descriptions follow the first list holding the code."""
    tagged = None
    for i, hits in enumerate(rankings):
        part = hits.select("key", "code", "description", "rank", F.lit(i).alias("source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    fused = tagged.groupBy("key", "code").agg(
        F.round(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank") + 1)), 12).alias("score"),
        F.min(F.struct("source", "rank")).alias("first"),
        F.min_by("description", F.struct("source", "rank")).alias("description"))
    return top_ranked(fused, ["key"], [F.desc("score"), F.asc("first")], k).select(
        "key", "rank", "code", "score", "description")
