"""BIO label schemes over token tables, token windows and model tagging.

tokens(doc_id, idx, cs, ce); special tokens have cs = ce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions.lines import Text
from spanwright.functions.text import clean_span
from spanwright.operators.concepts import overlap_pairs, with_text

IGNORE = -100  # fixed value: label id of special tokens


def label_list(types=vocab.TYPES) -> list[str]:
    return ["O"] + [f"{p}-{t}" for t in types for p in ("B", "I")]


def external_types(spans: DataFrame) -> DataFrame:
    """Distinct types of labelled spans; sort by the column for a reproducible scheme."""
    return spans.select("type").distinct()


def _label_id(types, prefix: Column, ctype: Column) -> Column:
    ids = F.create_map(*[F.lit(x) for i, name in enumerate(label_list(types)) for x in (name, i)])
    return F.try_element_at(ids, F.concat(prefix, F.lit("-"), ctype))


def encode(tokens: DataFrame, spans: DataFrame, types=vocab.TYPES, by: str = "doc_id") -> DataFrame:
    """tokens + label: B on the first token a span touches, I on the rest.

    spans(doc_id, cid, start, end, type). A later span (by start, then order) overwrites.
    """
    known = spans.filter(F.col("type").isin(*types)).select(by, "cid", "start", "end", "type")
    real = tokens.filter("cs <> ce").select(by, "idx", "cs", "ce")
    pairs = overlap_pairs(real, known, "cs", "ce", "start", "end", by=by)
    first = F.min("idx").over(Window.partitionBy(by, "cid"))
    prefixed = pairs.withColumn("prefix", F.when(F.col("idx") == first, "B").otherwise("I"))
    labels = (prefixed.withColumn("label", _label_id(types, F.col("prefix"), F.col("type")))
              .groupBy(by, "idx").agg(F.max_by("label", F.struct("start", "cid")).alias("label")))
    return tokens.join(labels, [by, "idx"], "left").withColumn(
        "label", F.when(F.col("cs") == F.col("ce"), IGNORE).otherwise(F.coalesce("label", F.lit(0))))


def decode(docs: DataFrame, labelled: DataFrame, types=vocab.TYPES) -> DataFrame:
    """concepts from token label ids: gaps and islands over non-special tokens."""
    names = F.array(*[F.lit(n) for n in label_list(types)])
    label = F.coalesce(F.get(names, F.greatest(F.col("label"), F.lit(-1))), F.lit("O"))
    named = labelled.filter("cs <> ce").withColumn("_l", label)
    w = Window.partitionBy("doc_id").orderBy("idx")
    kind, ctype = F.substring("_l", 1, 1), F.substring(F.col("_l"), F.lit(3), F.length("_l"))
    prior = F.lag("_l").over(w)
    opens = ((kind != "I") | prior.isNull() | (prior == "O")
             | (F.substring(prior, F.lit(3), F.length(prior)) != ctype))
    runs = (named.withColumn("type", ctype).withColumn("_open", F.when(opens, 1).otherwise(0))
            .withColumn("_run", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .filter("_l <> 'O'").groupBy("doc_id", "_run")
            .agg(F.first("type").alias("type"), F.min_by("cs", "idx").alias("cs"),
                 F.max_by("ce", "idx").alias("ce")))

    def trimmed(text: Text, c: Column) -> Column:
        s, e = clean_span(text, c["cs"], c["ce"])
        return F.struct(s.alias("start"), e.alias("end"), text.slice(s, e).alias("text"))

    spans = with_text(docs, runs, span=trimmed).filter("span.end > span.start")
    none = F.array().cast("array<string>")
    return spans.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_run")) - 1).alias("cid"),
        "span.text", "type", F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        none.alias("assertions"), none.alias("candidates"))


def token_windows(tokenized: DataFrame, max_length: int = 256, stride: int = 64,
                  n_special: int = 2, bos: int = 0, eos: int = 2) -> DataFrame:
    """Overlapping windows over tokenised documents.

    tokenized(doc_id, tokens array<struct<id, cs, ce>>) -> (doc_id, window, idx, id, cs, ce);
    consecutive windows share `stride` tokens and every window is framed by special tokens.
    """
    room = max_length - n_special
    step = room - stride
    n = F.size("tokens")
    starts = F.when(n <= room, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.ceil((n - room) / step).cast("int")), lambda w: w * step))
    cut = tokenized.select("doc_id", "tokens", F.posexplode(starts).alias("window", "_from"))

    def special(token_id: int) -> Column:
        return F.array(F.struct(F.lit(token_id).alias("id"), F.lit(0).alias("cs"), F.lit(0).alias("ce")))

    body = F.slice("tokens", F.col("_from") + 1, room)
    return cut.select("doc_id", "window", F.posexplode(
        F.concat(special(bos), body, special(eos))).alias("idx", "t")).select(
        "doc_id", "window", "idx", "t.id", "t.cs", "t.ce")


def features(windows: DataFrame, spans: DataFrame, types=vocab.TYPES) -> DataFrame:
    """Training features per window: input_ids, attention_mask, labels as ordered arrays."""
    keyed = windows.withColumn("_w", F.struct("doc_id", "window"))
    spread = spans.join(windows.select("doc_id", "window").distinct(), "doc_id").withColumn(
        "_w", F.struct("doc_id", "window"))
    labelled = encode(keyed, spread, types, by="_w")
    ordered = F.array_sort(F.collect_list(F.struct("idx", "id", "label")))
    return labelled.groupBy("doc_id", "window").agg(ordered.alias("t")).select(
        "doc_id", "window", F.col("t.id").alias("input_ids"),
        F.transform("t", lambda _: F.lit(1)).alias("attention_mask"), F.col("t.label").alias("labels"))


def merge_windows(predicted: DataFrame) -> DataFrame:
    """One label per token span over all windows: the earliest window wins."""
    best = (predicted.filter("cs <> ce").groupBy("doc_id", "cs", "ce")
            .agg(F.min_by("label", F.struct("window", "idx")).alias("label")))
    return best.withColumn("idx", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("cs", "ce")) - 1)
