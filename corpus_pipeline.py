"""Preparation of a training corpus: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import bpe, decontam, minhash, rules, secrets
from spanwright.llm.registered import BYTE_BPE
from spanwright.session import read_table, shared_folder

ORACLE_SQL = None
"""SQL cannot express the encoding; the tests hold run() against a brute-force version."""


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return rules.ledger(docs).where(rules.passes("full-2")).drop("ledger")


def _free(docs: DataFrame) -> str:
    """A column name that `docs` does not have."""
    name = "row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, a null id last.

    Rows are told apart by id and text: of two texts with one id each is judged on its own, and of rows equal in both one
    stays. A row with a null id is judged like any other. Texts without words are in no group.
    """
    key = _free(docs)
    parts = {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "text": F.xxhash64("text")}  # no null within
    rows = docs.withColumn(key, F.struct(*[v.alias(k) for k, v in parts.items()]))
    dropped = minhash.near_duplicates(rows, id_col=key).where("not kept").select(key).distinct()
    return rows.join(dropped, key, "left_anti").dropDuplicates([key]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Rows are told apart by id and text, so null and repeated ids are judged too."""
    key = _free(docs)
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaks = decontam.contaminated(rows, read_table(spark, sf_dir, "benchmark"), id_col=key).select(key).distinct()
    return rows.join(leaks, key, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document's BPE ids."""
    return bpe.encode_digests(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
