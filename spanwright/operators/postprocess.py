"""Clean-up of predictions and replacement by trusted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions.text import collapse, strip, vote_key
from spanwright.operators.concepts import touched_keys


def heading_key(c: Column) -> Column:
    """Single spaces, no surrounding punctuation of list items and headings, lower case."""
    return F.lower(F.regexp_replace(strip(collapse(c)), r"^[:.\-•* \t]+|[:.\-•* \t]+$", ""))


def drop_redacted(concepts: DataFrame) -> DataFrame:
    return concepts.filter(~F.col("text").rlike(r"\*{3,}"))


def drop_headings(concepts: DataFrame, headings=vocab.STOP_HEADINGS) -> DataFrame:
    return concepts.filter(~heading_key(F.col("text")).isin(*headings))


def unify_types(concepts: DataFrame) -> DataFrame:
    """Equal strings of a document take their majority type; the first seen wins a tie.

    Both windows run over rows that lie together by document and share one sort, so the concepts are read once and
    joined with nothing.
    """
    keyed = concepts.withColumn("_k", vote_key(F.col("text"))).filter(F.col("doc_id").isNotNull() & F.col("_k").isNotNull())
    same = Window.partitionBy("doc_id", "_k", "type")
    counted = keyed.withColumn("_n", F.count("*").over(same)).withColumn("_first", F.min("cid").over(same))
    best = F.min_by("type", F.struct(-F.col("_n"), F.col("_first"))).over(Window.partitionBy("doc_id", "_k"))
    return counted.withColumn("type", best).select(concepts.columns)


def unify_labels(concepts: DataFrame) -> DataFrame:
    """Equal string and type: the majority non-empty code list replaces all; assertions stay."""
    keyed = concepts.withColumn("_k", vote_key(F.col("text")))
    same = Window.partitionBy("doc_id", "_k", "type", "candidates")
    counted = keyed.withColumn("_n", F.count("*").over(same)).withColumn("_first", F.min("cid").over(same))
    votes = F.when(F.size("candidates") > 0, F.struct(-F.col("_n"), F.col("_first")))
    best = F.min_by("candidates", votes).over(Window.partitionBy("doc_id", "_k", "type"))
    # without a document, text or type a concept equals no other one
    known = F.col("doc_id").isNotNull() & F.col("_k").isNotNull() & F.col("type").isNotNull()
    return counted.withColumn("_best", best).withColumn(
        "candidates", F.coalesce(F.when(known, F.col("_best")), "candidates")).select(concepts.columns)


def apply(concepts: DataFrame, redacted: bool = True, headings: bool = True, types: bool = True,
          labels: bool = True) -> DataFrame:
    steps = ((redacted, drop_redacted), (headings, drop_headings), (types, unify_types), (labels, unify_labels))
    for on, step in steps:
        concepts = step(concepts) if on else concepts
    return concepts


def graft(pred: DataFrame, gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Inside the spans of a document gold replaces every prediction that touches them.

    Documents with spans but no predictions receive their gold concepts; `cid` is
    renumbered by position.
    """
    keep = pred.join(touched_keys(pred, spans), ["doc_id", "cid"], "left_anti")
    insert = gold.join(touched_keys(gold, spans), ["doc_id", "cid"], "left_semi").select(pred.columns)
    both = keep.withColumn("_o", F.lit(0)).unionByName(insert.withColumn("_o", F.lit(1)))
    w = Window.partitionBy("doc_id").orderBy("start", "end", "_o", "cid")
    return both.withColumn("_n", F.row_number().over(w) - 1).withColumn("cid", F.col("_n")).select(pred.columns)


def graft_stats(grafted: DataFrame, gold: DataFrame, dev: DataFrame) -> DataFrame:
    """Per grafted document the number of concepts equal to gold in place and type."""
    same = grafted.join(gold.select("doc_id", "start", "end", "type").distinct(),
                        ["doc_id", "start", "end", "type"], "left_semi")
    counts = same.groupBy("doc_id").agg(F.count("*").alias("n_gold"))
    return dev.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["n_gold"])


def graft_all(pred: DataFrame, gold: DataFrame, spans: DataFrame, dev: DataFrame,
              known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graft the dev documents that are known to the prediction set: (concepts, stats)."""
    use = dev.join(known.select("doc_id"), "doc_id", "left_semi").select("doc_id")
    chosen = lambda df: df.join(use, "doc_id", "left_semi")
    grafted = graft(pred, chosen(gold), chosen(spans))
    return grafted, graft_stats(grafted, chosen(gold), use)
