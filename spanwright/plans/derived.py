"""Concept tables that Spark derives from the supplied tables, for the registered queries.

`oracle.py` states the same derivations in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions.batches import words_of
from spanwright.functions.text import fold_punctuation
from spanwright.operators.models import tokenize_column
from spanwright.session import bounded_tasks, computed_once, read_table, spread

_WORD = re.compile(r"[^\W_]+")


def word_tokenizer():
    """Tokens are runs of letters and digits; the id of a token is its length."""

    def run(texts: list[str]):
        return [[(m.end() - m.start(), m.start(), m.end()) for m in _WORD.finditer(t)] for t in texts]

    return run


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"), "doc_id")


def outlines(spark: SparkSession, sf: str) -> DataFrame:
    """One sectioned document per order, rendered from its lines."""
    parts = read_table(spark, sf, "part").select("p_partkey", "p_name")
    lines = numbered_lines(spark, sf).join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
            "cid", F.concat(F.lit("- "), "p_name", F.lit(", "), "l_linestatus").alias("t")))).alias("l"))
    orders = read_table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    # the key of the lines keeps their layout, so mentions of an outline stay where it is
    return orders.select(F.col("l_orderkey").alias("doc_id"), F.concat_ws(
        "\n",
        F.concat(F.lit("1. "), "o_orderpriority"),
        F.concat(F.lit("Status "), "o_orderstatus", F.lit(":")),
        F.array_join("l.t", "\n"),
        F.lit(""),
        F.lit("Shipping notes"),
        F.concat(F.lit("    Customer "), F.col("o_custkey").cast("string")),
        F.lit("2) 1.5 mg"),
        F.lit("Nothing else was reported."),
        F.concat(F.lit("Total "), F.floor("o_totalprice").cast("string"))).alias("text"))


def shared_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """The outlines for queries that read them more than once."""
    return computed_once(outlines(spark, sf), "doc_id", read_table(spark, sf, "orders").count())


def word_tokens(docs: DataFrame) -> DataFrame:
    """tokens(doc_id, idx, cs, ce) of all words."""
    return docs.select("doc_id", F.posexplode(tokenize_column(word_tokenizer)(F.col("text"))).alias("idx", "t")).select(
        "doc_id", "idx", "t.cs", "t.ce")


def _nth_type(i: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in vocab.TYPES]), i.cast("int"))


def _labels(*rules: tuple[Column, str]) -> Column:
    return F.concat(*[F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for cond, name in rules])


def _long_words(min_len: int):
    """Column function text -> array<struct<start, end, text>> of the words of `word_tokenizer` with at least `min_len` characters."""
    fields = [pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("text", pa.string())]

    @F.arrow_udf("array<struct<start:int,end:int,text:string>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield words_of(texts, min_len, fields)

    return run


def word_concepts(docs: DataFrame, min_len: int) -> DataFrame:
    """Long words as labelled concepts; type, assertions and codes follow from the word."""
    words = docs.select("doc_id", _long_words(min_len)(F.col("text")).alias("w"))
    # the planner would filter a plain column by its size first, and find the words twice for it
    found = F.coalesce("w", F.array().cast(words.schema["w"].dataType))
    rows = words.select("doc_id", F.posexplode(found).alias("cid", "c")).select("doc_id", "cid", "c.*")
    low = F.lower("text")
    typed = rows.withColumn("type", _nth_type(F.length("text") % 5))
    code = F.concat(F.lit("K"), F.substring(low, 1, 2))
    coded = F.col("type").isin(*vocab.TYPES_WITH_CANDIDATES) & F.contains(low, F.lit("en"))
    none = F.array().cast("array<string>")
    return typed.select(
        "doc_id", "cid", "text", "type", "start", "end",
        _labels((F.contains(low, F.lit("th")), "isNegated"), (F.contains(low, F.lit("oi")), "isFamily"),
                (F.contains(low, F.lit("on")), "isHistorical")).alias("assertions"),
        F.when(coded, F.array(code)).otherwise(none).alias("candidates"))


def pair_concepts(docs: DataFrame) -> DataFrame:
    """Every third word together with its follower, as (doc_id, cid, text, type, start, end)."""
    spans = docs.select("doc_id", F.col("text").alias("t"), tokenize_column(word_tokenizer)(F.col("text")).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: (i % 3 == 0) & (i + 1 < F.size("w")))
    rows = spans.select("doc_id", "t", F.explode(F.transform(at, lambda i: F.struct(
        (i / 3).cast("int").alias("cid"), F.get("w", i)["cs"].alias("start"),
        F.get("w", i + 1)["ce"].alias("end")))).alias("c"))
    text = F.substring(F.col("t"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    return rows.select("doc_id", "c.cid", text.alias("text"), _nth_type(F.length(text) % 5).alias("type"),
                       "c.start", "c.end")


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with a unique number `cid` inside their order."""
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return bounded_tasks(lines, "l_orderkey").withColumn("cid", F.row_number().over(w) - 1)


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    parts = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return numbered_lines(spark, sf).join(parts, F.col("l_partkey") == F.col("p_partkey"))


def order_docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))


def order_gold(spark: SparkSession, sf: str) -> DataFrame:
    """One concept per order line; the document is the order."""
    return _gold(_order_lines(spark, sf))


def _gold(x: DataFrame, *more: Column) -> DataFrame:
    key, none = F.col("l_partkey"), F.array().cast("array<string>")
    ctype = _nth_type(key % 5)
    codes = F.filter(F.array(F.concat(F.lit("C"), (key % 50).cast("string")),
                             F.when(key % 9 == 0, F.concat(F.lit("X"), (key % 7).cast("string")))),
                     lambda c: c.isNotNull())
    start = (F.col("cid") * 40).cast("int")
    return x.select(
        F.col("l_orderkey").alias("doc_id"), "cid", F.col("p_name").alias("text"),
        ctype.alias("type"), start.alias("start"), (start + F.length("p_name")).alias("end"),
        _labels((F.col("l_returnflag") == "R", "isNegated"), (F.col("l_suppkey") % 10 == 0, "isFamily"),
                (F.col("l_linestatus") == "F", "isHistorical")).alias("assertions"),
        F.when(ctype.isin(*vocab.TYPES_WITH_CANDIDATES) & (key % 4 != 0), codes).otherwise(none).alias("candidates"), *more)


def order_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Gold with dropped rows and changed types, texts, assertions and codes."""
    x = _order_lines(spark, sf).filter(F.col("cid") % 6 != 5)
    key, none = F.col("l_partkey"), F.array().cast("array<string>")
    ctype = _nth_type((key + F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0)) % 5)
    code = F.concat(F.lit("C"), (F.when(key % 3 == 0, key + 1).otherwise(key) % 50).cast("string"))
    text = F.when(F.col("l_suppkey") % 11 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    start = (F.col("cid") * 40).cast("int")
    return x.select(
        F.col("l_orderkey").alias("doc_id"), "cid", text.alias("text"),
        ctype.alias("type"), start.alias("start"), (start + F.length("p_name")).alias("end"),
        F.when(F.col("l_quantity") > 40, none).otherwise(_labels(
            (F.col("l_returnflag") == "R", "isNegated"),
            (F.col("l_linestatus") == "F", "isHistorical"))).alias("assertions"),
        F.when(ctype.isin(*vocab.TYPES_WITH_CANDIDATES), F.array(code)).otherwise(none).alias("candidates"))


def order_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Gold concepts with a made probability per label (p), a gate probability and picked codes.

    Both come from the same order line, so they are read from it together.
    """
    k = F.col("l_partkey")
    return _gold(
        _order_lines(spark, sf).filter("l_orderkey IS NOT NULL"),
        F.array((F.col("l_quantity") % 11) / 10, (F.col("l_suppkey") % 9) / 8, (k % 13) / 12).alias("p"),
        ((F.col("l_quantity") % 20) / 20).alias("gate"),
        F.array(F.concat(F.lit("C"), (F.when(k % 3 == 0, k + 1).otherwise(k) % 50).cast("string"))).alias("picked"))


def order_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = (F.col("o_custkey") % 120).cast("int")
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), s.alias("s"), (s + 60 + F.floor(F.col("o_totalprice")) % 100).cast("int").alias("e"))


def part_kb(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as knowledge base entries of two concept types."""
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("Aspirin ")).otherwise(""), "p_name", F.lit(" "), "p_brand")
    return read_table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, vocab.DIAGNOSIS).otherwise(vocab.DRUG).alias("type"),
        F.col("p_partkey").alias("ord"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"),
        name.alias("description")).withColumn("norm", fold_punctuation(F.col("description")))


def part_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as mentions of parts, with abbreviations, upper case and stray punctuation."""
    x = _order_lines(spark, sf)
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("ASA ")).otherwise(""),
                    F.upper("p_name"), F.lit(",  "), "p_brand")
    none = F.array().cast("array<string>")
    return x.select(
        F.col("l_orderkey").alias("doc_id"), "cid", name.alias("text"),
        F.when(F.col("cid") % 2 == 0, vocab.DIAGNOSIS).otherwise(vocab.DRUG).alias("type"),
        F.lit(0).alias("start"), F.length(name).alias("end"), none.alias("assertions"), none.alias("candidates"))
