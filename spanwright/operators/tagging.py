"""Dictionary tagger: learn phrase -> type by majority, then longest-match tagging."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.functions.batches import lists_of_tuples
from spanwright.functions.text import match_key
from spanwright.operators.concepts import seen_at, with_text
from spanwright.session import BROADCAST_BYTES, broadcast_if_small, measured_bytes

HEAD = r"(?s)^(?:[\p{L}\p{N}]+|.)"
_TILE = re.compile(r"[^\W_]+|.", re.DOTALL)
_MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                     T.StructField("phrase", T.StringType())]))


def fit_gazetteer(concepts: DataFrame) -> DataFrame:
    """phrases(phrase, type, rank): majority type per key, first seen wins a tie.

    Votes are counted per (key, type) first, so a key that fills the table costs one row per type.
    """
    votes = (concepts.withColumn("phrase", match_key(F.col("text"))).filter("phrase <> ''")
             .groupBy("phrase", "type")
             .agg(F.count("*").alias("n"), F.min(seen_at()).alias("first")))
    return votes.groupBy("phrase").agg(
        F.min_by("type", F.struct(-F.col("n"), F.col("first"))).alias("type"),
        F.min("first").alias("rank"))


def _candidate_udf(lengths_by_head: dict[str, list[int]] | None, any_lengths: list[int]):
    """Boundary-clean substrings of a lower-cased text that may be phrases."""

    def clean(low: str, pos: int) -> bool:
        return pos >= len(low) or not low[pos].isalnum()

    def scan(low: str) -> list[tuple[int, str]]:
        found, blocked = [], False
        for tile in _TILE.finditer(low):
            start, head = tile.start(), tile.group()
            wordlike = head[0].isalnum()
            if wordlike or not blocked:
                lengths = any_lengths if lengths_by_head is None else lengths_by_head.get(head, ())
                for n in lengths:
                    if start + n <= len(low) and clean(low, start + n):
                        found.append((start, low[start:start + n]))
            blocked = wordlike
        return found

    fields = [pa.field("start", pa.int32()), pa.field("phrase", pa.string())]

    @F.arrow_udf(_MATCHES)
    def candidates(texts: pa.Array) -> pa.Array:
        return lists_of_tuples(texts, lambda chunk: [scan(low) for low in chunk], fields)

    return candidates


def tag(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """concepts(doc_id, cid, text, type, start, end): non-overlapping longest matches.

    Word starts whose first word begins no phrase are dropped at the scan; each surviving
    substring meets at most one phrase in an equi-join. The table of first words is used at
    the scan only while its measured size is small; beyond that every phrase length is tried
    and the join alone decides. Offsets refer to the lower-cased text, as matching does.
    """
    usable = phrases.filter(F.length("phrase") >= 2).select("phrase", "type", "rank")
    heads = usable.groupBy(F.regexp_extract("phrase", HEAD, 0).alias("head")).agg(
        F.collect_set(F.length("phrase")).alias("lengths"))
    table, lengths = None, []
    if measured_bytes(heads) <= BROADCAST_BYTES:
        table = {r["head"]: sorted(r["lengths"]) for r in heads.toLocalIterator()}
    else:
        lengths = sorted(r[0] for r in usable.select(F.length("phrase")).distinct().toLocalIterator())
    low = F.lower("text")
    hits = (docs.select("doc_id", F.inline(_candidate_udf(table, lengths)(low)))
            .join(broadcast_if_small(usable), "phrase")
            .select("doc_id", "start", (F.col("start") + F.length("phrase")).alias("end"), "type", "rank"))
    chosen = longest_first(hits)
    numbered = chosen.withColumn("cid", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("start")) - 1)
    return slice_text(docs, numbered)


def longest_first(hits: DataFrame) -> DataFrame:
    """Greedy non-overlapping choice by (length desc, rank, start) in each document.

    Overlap chains are separated first, so the ordered fold runs on short arrays only.
    """
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chains = (hits.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
              .withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("doc_id", "_chain")
              .agg(F.array_sort(F.collect_list(F.struct(
                  (F.col("start") - F.col("end")).alias("order"), "rank", "start", "end", "type"))).alias("m")))
    empty = F.array().cast(chains.schema["m"].dataType)

    def take(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    picked = F.when(F.size("m") == 1, F.col("m")).otherwise(F.aggregate("m", empty, take))
    return chains.select("doc_id", F.inline(picked)).select("doc_id", "start", "end", "type")


def slice_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Fill the raw text of spans and the empty label arrays."""
    sliced = with_text(docs, spans,
                       text=lambda t, c: t.slice(c["start"], c["end"]))
    none = F.array().cast("array<string>")
    return sliced.select("doc_id", "cid", "text", "type", "start", "end",
                         none.alias("assertions"), none.alias("candidates"))
