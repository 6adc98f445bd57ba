"""Text documents and concept JSON: folder scans, paired labels, file-per-document output."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright import vocab

LABEL = ("array<struct<text:string,type:string,position:array<int>,"
         "assertions:array<string>,candidates:array<string>>>")


def _stem(extension: str) -> Column:
    return _decoded(F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{extension}$", 1))


def _decoded(name: Column) -> Column:
    """File names are percent-encoded; a plain plus sign stands for itself."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """docs(doc_id, ord, text): one row per .txt file, line ends as \\n, ord for numeric names."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return raw.select(_stem("txt").alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text")).select(
        "doc_id", F.expr("try_cast(doc_id AS bigint)").alias("ord"), "text")


def list_ids(spark: SparkSession, folder: str) -> DataFrame:
    return read_texts(spark, folder).select("ord", "doc_id").orderBy("ord", "doc_id").select("doc_id")


def parse_concepts(raw: DataFrame) -> DataFrame:
    """concepts from (doc_id, value JSON array); missing fields become empty values."""
    none = F.array().cast("array<string>")
    items = raw.select("doc_id", F.posexplode(F.from_json("value", LABEL)).alias("cid", "c"))
    at = lambda i: F.coalesce(F.get("c.position", F.lit(i)), F.lit(0))
    return items.select("doc_id", "cid", F.coalesce("c.text", F.lit("")).alias("text"),
                        F.coalesce("c.type", F.lit("")).alias("type"), at(0).alias("start"), at(1).alias("end"),
                        F.coalesce("c.assertions", none).alias("assertions"),
                        F.coalesce("c.candidates", none).alias("candidates"))


def read_concepts(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return parse_concepts(raw.select(_stem("json").alias("doc_id"), "value"))


def read_labelled(spark: SparkSession, texts: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """(docs, concepts); fails when a text has no label file."""
    docs = read_texts(spark, texts)
    files = spark.read.option("pathGlobFilter", "*.json").format("binaryFile").load(labels)
    named = files.select(_decoded(F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("doc_id"))
    missing = docs.select("doc_id").join(named, "doc_id", "left_anti").limit(1).collect()
    if missing:
        raise FileNotFoundError(f"no label file for document {missing[0][0]}")
    concepts = read_concepts(spark, labels).join(docs.select("doc_id"), "doc_id", "left_semi")
    return docs, concepts


def concept_json(c: Column) -> Column:
    """Output struct of a concept; label fields are NULL, hence absent, where they do not apply."""
    return F.struct(
        c["text"].alias("text"), c["type"].alias("type"), F.array(c["start"], c["end"]).alias("position"),
        F.when(c["type"].isin(*vocab.TYPES_WITH_CANDIDATES), c["candidates"]).alias("candidates"),
        F.when(c["type"].isin(*vocab.TYPES_WITH_ASSERTIONS), c["assertions"]).alias("assertions"))


def to_json_documents(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, value): one JSON array per document, `[]` when it has no concepts."""
    from spanwright.operators.concepts import attach_docs

    packed = attach_docs(docs.select("doc_id"), concepts)
    return packed.select("doc_id", F.to_json(F.transform("concepts", concept_json)).alias("value"))


def write_json_files(documents: DataFrame, folder: str) -> None:
    """One {doc_id}.json per document, written by the tasks to a folder all executors share."""
    os.makedirs(folder, exist_ok=True)

    def write(rows) -> None:
        for row in rows:
            # written under a task-private name first: a retried task replaces whole files only
            path = os.path.join(folder, f"{row.doc_id}.json")
            partial = f"{path}.{os.getpid()}.part"
            with open(partial, "w", encoding="utf-8") as fh:
                fh.write(row.value)
            os.replace(partial, path)

    documents.select("doc_id", "value").foreachPartition(write)


def write_json_table(documents: DataFrame, path: str) -> None:
    """Scalable sink: (doc_id, value) rows as a table instead of one small file per document."""
    documents.write.mode("overwrite").parquet(path)


def package(folder: str, zip_path: str) -> None:
    """Zip the output files as output/{id}.json in numeric order."""
    def order(name: str) -> int:
        stem = name[:-len(".json")]
        return int(stem) if stem.isdigit() else 0

    names = sorted((n for n in os.listdir(folder) if n.endswith(".json")), key=order)
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as out:
        for name in names:
            out.write(os.path.join(folder, name), f"output/{name}")


CONCEPTS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("cid", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("assertions", T.ArrayType(T.StringType())),
    T.StructField("candidates", T.ArrayType(T.StringType()))])
