"""Labelled JSON lines: external tagging corpora and synthetic records."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPORA = ("phoner", "vimq")  # fixed values: file stems of the known corpora
SCHEMA = "text string, spans array<array<string>>, source string, split string"


def default_paths(folder: str) -> list[str]:
    paths = [os.path.join(folder, f"{name}.jsonl") for name in CORPORA]
    return [p for p in paths if os.path.exists(p)]


def read_records(spark: SparkSession, *paths: str, splits: set[str] | None = None) -> DataFrame:
    """(text, spans array<struct<start,end,type>>, source, split); blank lines are skipped."""
    rows = spark.read.schema(SCHEMA).json(list(paths))
    if splits is not None:
        rows = rows.filter(F.col("split").isin(*sorted(splits)))
    typed = F.transform("spans", lambda x: F.struct(
        x[0].cast("int").alias("start"), x[1].cast("int").alias("end"), x[2].alias("type")))
    return rows.withColumn("spans", typed)


def record_types(records: DataFrame) -> DataFrame:
    """Sorted distinct span types."""
    return records.select(F.explode("spans.type").alias("type")).distinct().orderBy("type")


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines with spans as [start, end, "type"] arrays."""
    line = F.to_json(F.struct("text", F.lit("@spans@").alias("spans"), "concepts", "source", "split"))
    spans = F.concat(F.lit("["), F.array_join(F.transform("spans", lambda s: F.concat(
        F.lit("["), s["start"].cast("string"), F.lit(", "), s["end"].cast("string"), F.lit(', "'), s["type"], F.lit('"]'))), ", "), F.lit("]"))
    fixed = F.concat(F.substring_index(line, '"spans":"@spans@"', 1), F.lit('"spans":'), spans,
                     F.substring(line, F.length(F.substring_index(line, '"spans":"@spans@"', 1)) + 18, F.length(line)))
    records.select(fixed.alias("value")).write.mode("overwrite").text(path)
