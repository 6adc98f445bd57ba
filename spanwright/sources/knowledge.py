"""Knowledge-base CSV files: diagnosis names and drug names, as kb(type, ord, code, description, norm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions.text import normalize, strip


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', multiLine=True, encoding="UTF-8")


def _entries(rows: DataFrame, ctype: str, code: Column, name: Column) -> DataFrame:
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    # the id grows with file position, which is all that ties need
    return rows.select(F.lit(ctype).alias("type"), F.monotonically_increasing_id().alias("ord"),
                       clean(code).alias("code"), clean(name).alias("description")).withColumn(
        "norm", normalize(F.col("description")))


def read_diagnoses(spark: SparkSession, path: str) -> DataFrame:
    """Columns code and description; rows without a code are dropped, empty names stay."""
    rows = _read_csv(spark, path)
    names = {c.lstrip("﻿"): c for c in rows.columns}
    return _entries(rows, vocab.DIAGNOSIS, F.col(f"`{names['code']}`"), F.col(f"`{names['description']}`")).filter("code <> ''")


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    """Any-case header: rxcui or code; name, str or description. Both values are required."""
    rows = _read_csv(spark, path)
    names = {c.lstrip("﻿").lower(): c for c in rows.columns}
    column = lambda *options: F.col(f"`{next(names[o] for o in options if o in names)}`")
    found = _entries(rows, vocab.DRUG, column("rxcui", "code"), column("name", "str", "description"))
    return found.filter("code <> '' and description <> ''")
