"""Concept tables: per-document evaluation, validation, and interval joins.

docs(doc_id, text) and concepts(doc_id, cid, text, type, start, end, assertions, candidates).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions.lines import PIECE, ShortText, Text, cut, pieced

BUCKET = 256  # code points per interval-join bucket


def eligible_for_codes(c: Column | str = "type") -> Column:
    return (F.col(c) if isinstance(c, str) else c).isin(*vocab.TYPES_WITH_CANDIDATES)


def eligible_for_assertions(c: Column | str = "type") -> Column:
    return (F.col(c) if isinstance(c, str) else c).isin(*vocab.TYPES_WITH_ASSERTIONS)


def with_text(docs: DataFrame, concepts: DataFrame,
              **exprs: Callable[[Text, Column], Column]) -> DataFrame:
    """Add columns computed from (document text, concept struct).

    The concepts of a document travel as one array next to its text, so the text is shuffled
    once per document instead of once per concept; only the small results leave the row. A long
    text is cut for random access below the join, so a concept costs what it reads of the text;
    a short one goes with each of its concepts, where no lambda has to be interpreted.
    """
    names = [n for n in concepts.columns if n != "doc_id"]
    packed = concepts.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("_members"))
    text, size = F.col("text"), F.length("text")
    short = docs.select("doc_id", F.when(size <= PIECE, text).alias("_short"), F.when(size <= PIECE, None).otherwise(text).alias("text"))
    rows = cut(short, kept=("_short",)).join(packed, "doc_id").select("doc_id", "_short", F.inline(F.transform(
        "_members", lambda c: F.struct(*[c[n].alias(n) for n in names], *[
            F.when(F.col("_short").isNull(), fn(pieced(), c)).alias("_long_" + k) for k, fn in exprs.items()]))))
    # as fields of one struct the results stay a step of their own, in which shared parts are evaluated once
    whole, concept = ShortText(F.col("_short")), F.struct(*names)
    now = rows.withColumn("_now", F.struct(*[fn(whole, concept).alias(k) for k, fn in exprs.items()]))
    return now.select("doc_id", *[n for n in names if n not in exprs], *[
        F.when(F.col("_short").isNotNull(), F.col(f"_now.{k}")).otherwise(F.col("_long_" + k)).alias(k) for k in exprs])


def attach_docs(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row per document with its concepts as an ordered array (empty when it has none)."""
    packed = concepts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "cid", "text", "type", "start", "end", "assertions", "candidates"))).alias("concepts"))
    filled = docs.join(packed, "doc_id", "left")
    empty = F.array().cast(packed.schema["concepts"].dataType)
    return filled.withColumn("concepts", F.coalesce("concepts", empty))


def validation_errors(text: Text, c: Column) -> Column:
    """Array of error names; empty when the concept is valid for its document."""
    inside = (c["start"] >= 0) & (c["start"] <= c["end"]) & (c["end"] <= text.length())
    known = F.array(*[F.lit(a) for a in vocab.ASSERTIONS])
    checks = F.array(
        F.when(~c["type"].isin(*vocab.TYPES), "bad_type"),
        F.when(~inside, "out_of_range").when(
            text.slice(c["start"], c["end"]) != c["text"], "text_mismatch"),
        F.when(F.exists(c["assertions"], lambda a: ~F.array_contains(known, a)), "bad_assertion"),
        F.when(F.size(c["assertions"]) > 3, "too_many_assertions"),
        F.when((F.size(c["candidates"]) > 0) & ~eligible_for_codes(c["type"]), "codes_not_allowed"),
    )
    return F.filter(checks, lambda e: e.isNotNull())


def validate(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    return with_text(docs, concepts, errors=validation_errors)


def require_valid(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts unchanged; the job fails on the first invalid one."""
    checked = validate(docs, concepts)
    message = F.concat(F.lit("invalid concept in document "), F.col("doc_id").cast("string"),
                       F.lit(": "), F.array_join("errors", ","))
    return checked.filter(F.when(F.size("errors") == 0, F.lit(True))
                          .otherwise(F.raise_error(message).cast("boolean"))).drop("errors")


def _buckets(start: Column, last: Column) -> Column:
    return F.sequence(F.floor(start / BUCKET), F.floor(F.greatest(last, start) / BUCKET))


def inside_spans(concepts: DataFrame, spans: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Concepts lying fully inside at least one span(s, e) of the same document."""
    left = concepts.withColumn("_b", F.floor(F.col("start") / BUCKET))
    right = spans.select(*[F.col(k).alias("_" + k) for k in by], "s", "e",
                         F.explode(_buckets(F.col("s"), F.col("e"))).alias("_rb"))
    on = (F.col("_b") == F.col("_rb")) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e"))
    for k in by:
        on = on & (F.col(k) == F.col("_" + k))
    return left.join(right, on, "left_semi").drop("_b")


def touched_keys(concepts: DataFrame, spans: DataFrame) -> DataFrame:
    """Keys (doc_id, cid) of concepts sharing at least one position with a span, half-open."""
    left = concepts.select("doc_id", "cid", "start", "end",
                           F.explode(_buckets(F.col("start"), F.col("end"))).alias("_b"))
    right = spans.select(F.col("doc_id").alias("_d"), "s", "e",
                         F.explode(_buckets(F.col("s"), F.col("e"))).alias("_rb"))
    on = ((F.col("doc_id") == F.col("_d")) & (F.col("_b") == F.col("_rb"))
          & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")))
    return left.join(right, on, "left_semi").select("doc_id", "cid").distinct()


def overlap_pairs(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str,
                  by: str = "doc_id") -> DataFrame:
    """All (left, right) rows of one document that overlap; each pair once.

    Both sides are spread over position buckets, and a pair is emitted only in the first
    bucket that holds both, so no distinct is needed and no document is one big group.
    """
    lb = left.withColumn("_lb", F.explode(_buckets(F.col(ls), F.col(le) - 1)))
    rb = right.withColumnRenamed(by, "_by").withColumn("_rb", F.explode(_buckets(F.col(rs), F.col(re) - 1)))
    first = F.greatest(F.floor(F.col(ls) / BUCKET), F.floor(F.col(rs) / BUCKET))
    on = ((F.col(by) == F.col("_by")) & (F.col("_lb") == F.col("_rb")) & (F.col("_lb") == first)
          & (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)))
    return lb.join(rb, on).drop("_by", "_lb", "_rb")


def merge_touching(spans: DataFrame, by: list[str]) -> DataFrame:
    """Merge overlapping or adjacent spans (s, e) per key: gaps and islands."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    prior = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(prior.isNull() | (F.col("s") > prior), 1).otherwise(0))
    run = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")


def seen_at() -> Column:
    """Place of a concept in first-seen order: documents in numeric order of their ids, other ids behind them."""
    number = F.coalesce(F.col("doc_id").cast("string").try_cast("bigint"), F.lit((1 << 63) - 1))
    return F.struct(number.alias("number"), "doc_id", "cid")
