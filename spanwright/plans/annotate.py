"""Batch annotation: tag -> assertions -> codes -> validate -> JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators.assertion import annotate_rules
from spanwright.operators.concepts import require_valid
from spanwright.session import durable
from spanwright.sources.documents import CONCEPTS, read_texts, to_json_documents, write_json_files

Tagger = Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame, DataFrame], DataFrame]


def annotate(docs: DataFrame, tagger: Tagger | None = None, mapper: Step | None = None,
             asserter: Step | None = annotate_rules, post: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Concepts of all documents. tagger(docs), asserter(docs, concepts) and mapper(docs,
    concepts) are plain DataFrame functions; a missing one is skipped."""
    if tagger is None:
        return docs.sparkSession.createDataFrame([], CONCEPTS)
    # written out once: the later steps split and rejoin the concepts, and would tag again
    concepts = durable(tagger(docs))
    if asserter is not None:
        concepts = asserter(docs, concepts)
    if mapper is not None:
        concepts = mapper(docs, concepts)
    if post is not None:
        concepts = post(concepts)
    return require_valid(docs, concepts)


def run(spark: SparkSession, input_dir: str, output_dir: str, **stages) -> None:
    """Folder of .txt files in, one .json file per document out."""
    docs = read_texts(spark, input_dir)
    write_json_files(to_json_documents(docs, annotate(docs, **stages)), output_dir)


def as_documents(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    return to_json_documents(docs, concepts).orderBy(F.col("doc_id"))
