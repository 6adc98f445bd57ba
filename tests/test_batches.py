"""Tuples per text leave Python as Arrow arrays, chunk by chunk."""

import pyarrow as pa
from pyspark.sql import functions as F

from spanwright.functions import batches
from spanwright.operators import models, tagging
from spanwright.plans.derived import word_tokenizer

FIELDS = [pa.field("id", pa.int32()), pa.field("cs", pa.int32())]


def test_chunks_are_bounded_and_keep_order(monkeypatch):
    monkeypatch.setattr(batches, "CHUNK", 10)
    seen = []

    def fn(texts):
        seen.append(sum(map(len, texts)))
        return [[(ord(c), i) for i, c in enumerate(t)] for t in texts]

    texts = ["abc", "", None, "d" * 25, "ef", "ghijklm", None]
    got = batches.lists_of_tuples(pa.array(texts), fn, FIELDS).to_pylist()
    assert got == [None if t is None else [{"id": ord(c), "cs": i} for i, c in enumerate(t)] for t in texts]
    assert seen == [3, 25, 9]
    assert batches.lists_of_tuples(pa.array([], pa.string()), fn, FIELDS).to_pylist() == []


def test_no_tuples_at_all():
    assert batches.lists_of_tuples(pa.array(["", None]), lambda ts: [[] for _ in ts], FIELDS).to_pylist() == [[], None]


def test_tokenizer_sees_bounded_chunks(spark):
    most = batches.CHUNK

    def limited():  # refuses more characters at once than a chunk holds
        inner = word_tokenizer()

        def run(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= most
            return inner(texts)

        return run

    docs = spark.range(600, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 != 7, F.repeat(F.lit("ab cde "), 200)).alias("text"))
    out = docs.select("doc_id", models.tokenize_column(limited)(F.col("text")).alias("t"))
    rows = out.select(F.size("t").alias("n"), F.col("t")[399].alias("last"), F.col("t").isNull().alias("none")).collect()
    assert sum(r["none"] for r in rows) == 12
    assert {(r["n"], r["last"]["id"], r["last"]["cs"], r["last"]["ce"]) for r in rows if not r["none"]} == {(400, 3, 1396, 1399)}


def test_tag_passes_over_null_texts(spark):
    docs = spark.createDataFrame([(1, "big cat"), (2, None), (3, "")], "doc_id long, text string")
    phrases = spark.createDataFrame([("cat", "T", (1, "1", 0))], "phrase string, type string, rank struct<number:long,doc_id:string,cid:int>")
    assert [(r["doc_id"], r["start"], r["text"]) for r in tagging.tag(docs, phrases).collect()] == [(1, 4, "cat")]
