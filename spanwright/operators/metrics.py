"""Scoring: word error rate, multiset Jaccard, weighted totals, threshold search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions.text import split_words, word_edit_distance
from spanwright.operators.concepts import eligible_for_assertions, eligible_for_codes

# Score weights and the blend of the two ways of counting.
FINAL_WEIGHTS = {"text": 0.3, "assertions": 0.3, "candidates": 0.4}
CONCEPT_FIRST = {"concept": 2 / 3, "value": 1 / 3}
BALANCED = {"concept": 0.5, "value": 0.5}


def blend(mode: str) -> dict[str, float]:
    return {"concept_first": CONCEPT_FIRST, "balanced": BALANCED}.get(mode, {mode: 1.0})


def wer(ref: Column, hyp: Column) -> Column:
    r, h = split_words(ref), split_words(hyp)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(
        word_edit_distance(r, h) / F.size(r))


def text_scores(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per document max(0, 1 - WER) of the concept texts joined in list order."""

    def joined(concepts: DataFrame, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("cid", "text")))
        return concepts.groupBy("doc_id").agg(ordered.alias("t")).select(
            "doc_id", F.array_join("t.text", " ").alias(name))

    both = (docs.select("doc_id").join(joined(gold, "ref"), "doc_id", "left")
            .join(joined(pred, "hyp"), "doc_id", "left").fillna("", ["ref", "hyp"]))
    return both.select("doc_id", F.greatest(F.lit(0.0), 1.0 - wer(F.col("ref"), F.col("hyp"))).alias("text"))


def item_counts(concepts: DataFrame, field: str, mode: str) -> DataFrame:
    """Multiset of labels or codes per document: (doc_id, key, value, n)."""
    eligible = eligible_for_assertions() if field == "assertions" else eligible_for_codes()
    place = F.struct("start", "end", "type")
    key = place if mode == "concept" else F.lit(None).cast("struct<start:int,end:int,type:string>")
    return (concepts.filter(eligible).select("doc_id", key.alias("key"), F.explode(field).alias("value"))
            .groupBy("doc_id", "key", "value").agg(F.count("*").alias("n")))


def jaccard(inter: Column, union: Column, n_gold: Column) -> Column:
    """1 when both are empty, 0 when only gold is empty, else intersection over union."""
    return F.when(union == 0, 1.0).when(n_gold == 0, 0.0).otherwise(inter / union)


def jaccard_scores(docs: DataFrame, gold: DataFrame, pred: DataFrame, field: str, mode: str = "value") -> DataFrame:
    """Per document multiset Jaccard; both sides are counted in one pass without an outer join."""
    g = item_counts(gold, field, mode).withColumn("g", F.col("n")).withColumn("p", F.lit(0))
    p = item_counts(pred, field, mode).withColumn("g", F.lit(0)).withColumn("p", F.col("n"))
    sums = (g.unionByName(p).groupBy("doc_id", "key", "value").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
            .groupBy("doc_id").agg(F.sum(F.least("g", "p")).alias("inter"),
                                   F.sum(F.greatest("g", "p")).alias("union"), F.sum("g").alias("n_gold")))
    full = docs.select("doc_id").join(sums, "doc_id", "left").fillna(0, ["inter", "union", "n_gold"])
    return full.select("doc_id", jaccard(F.col("inter"), F.col("union"), F.col("n_gold")).alias(field))


def code_weights(gold: DataFrame) -> DataFrame:
    return gold.filter(eligible_for_codes()).groupBy("doc_id").agg(
        F.sum(F.size("candidates") + 1).alias("weight"))


def document_scores(docs: DataFrame, gold: DataFrame, pred: DataFrame, mode: str = "value") -> DataFrame:
    return (text_scores(docs, gold, pred)
            .join(jaccard_scores(docs, gold, pred, "assertions", mode), "doc_id")
            .join(jaccard_scores(docs, gold, pred, "candidates", mode), "doc_id")
            .join(code_weights(gold), "doc_id", "left").fillna(0, ["weight"]))


def score_dataset(docs: DataFrame, gold: DataFrame, pred: DataFrame, mode: str = "value") -> DataFrame:
    """One row: text, assertions, candidates, final; candidates weighted by gold size."""
    weighted = F.sum(F.col("candidates") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0))
    sums = document_scores(docs, gold, pred, mode).agg(
        F.count("*").alias("n"), F.avg("text").alias("t"), F.avg("assertions").alias("a"), weighted.alias("c"))
    empty = F.col("n") == 0
    parts = sums.select(F.coalesce("t", F.lit(0.0)).alias("text"),
                        F.coalesce("a", F.lit(0.0)).alias("assertions"),
                        F.when(empty, 0.0).otherwise(F.coalesce("c", F.lit(1.0))).alias("candidates"))
    final = sum((F.col(k) * w for k, w in FINAL_WEIGHTS.items()), F.lit(0.0))
    return parts.withColumn("final", final)


# Threshold grids.
F1_GRID = tuple(i / 20 for i in range(2, 19))
SCORE_GRID = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
GATE_GRID = (0.0,) + tuple(i / 20 for i in range(1, 20))


def f1_thresholds(scored: DataFrame, grid=F1_GRID, labels=vocab.ASSERTIONS) -> DataFrame:
    """(label, threshold, f1): the smallest threshold with the best F1; 0.5 without positives.

    scored(p array, gold array): every threshold is counted in the same aggregate.
    """
    names = F.array(*[F.lit(x) for x in labels])
    rows = scored.select(F.inline(F.arrays_zip(names.alias("label"), F.col("p").alias("p"), F.col("gold").alias("g"))))
    hit, pos = (lambda t: F.col("p") >= t), F.col("g") > 0.5
    counted = rows.groupBy("label").agg(
        F.count_if(pos).alias("n_pos"),
        F.array(*[F.struct(F.lit(t).alias("t"), F.count_if(hit(t) & pos).alias("tp"),
                           F.count_if(hit(t) != pos).alias("miss")) for t in grid]).alias("c"))
    f1 = F.transform("c", lambda x: F.struct(
        F.coalesce(2 * x["tp"] / F.nullif(2 * x["tp"] + x["miss"], F.lit(0)), F.lit(0.0)).alias("f1"),
        (-x["t"]).alias("neg_t")))
    best = F.array_max(f1)
    some = F.col("n_pos") > 0
    return counted.select("label", F.when(some, -best["neg_t"]).otherwise(0.5).alias("threshold"),
                          F.when(some, best["f1"]).alias("f1"))


def _grid_counts(items: DataFrame, by: list[str], grid) -> DataFrame:
    """inter[t], union[t], n_gold per `by` from items(by.., key, value, g, p, prob)."""
    per_item = items.groupBy(*by, "key", "value").agg(
        F.sum("g").alias("g"),
        F.array(*[F.sum(F.when(F.col("prob") >= t, F.col("p")).otherwise(0)) for t in grid]).alias("p"))
    return per_item.groupBy(*by).agg(
        F.array(*[F.sum(F.least(F.col("g"), F.col("p")[i])) for i in range(len(grid))]).alias("inter"),
        F.array(*[F.sum(F.greatest(F.col("g"), F.col("p")[i])) for i in range(len(grid))]).alias("union"),
        F.sum("g").alias("n_gold"))


_PLACE = "struct<start:int,end:int,type:string>"


def _keyed_by_mode(items: DataFrame, modes) -> DataFrame:
    """Repeat items once per counting mode; only `concept` keeps the place of the concept."""
    return items.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))).withColumn(
        "key", F.when(F.col("mode") == "concept", F.struct("start", "end", "type").cast(_PLACE)))


def tune_gate(docs: DataFrame, scored: DataFrame, mode: str = "concept_first", grid=GATE_GRID) -> tuple[float, float]:
    """Gate threshold with the best code score; the smallest one on a tie.

    scored: gold concepts + gate probability + picked (codes chosen for the concept). All
    thresholds are evaluated by one job over (document, mode) count arrays.
    """
    weights = blend(mode)
    rows = scored.filter(eligible_for_codes())
    gold = rows.select("doc_id", "start", "end", "type", F.explode("candidates").alias("value"),
                       F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0.0).alias("prob"))
    pred = rows.select("doc_id", "start", "end", "type", F.explode("picked").alias("value"),
                       F.lit(0).alias("g"), F.lit(1).alias("p"), F.col("gate").alias("prob"))
    counts = _grid_counts(_keyed_by_mode(gold.unionByName(pred), weights), ["doc_id", "mode"], grid)
    share = F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, float(w))])
    # A document without any item has Jaccard 1 at every threshold.
    base = code_weights(rows).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in weights])))
    full = base.join(counts, ["doc_id", "mode"], "left").withColumn("share", share[F.col("mode")])
    totals = [F.sum(F.col("weight") * F.col("share") * F.coalesce(jaccard(
        F.col("inter")[i], F.col("union")[i], F.col("n_gold")), F.lit(1.0))) for i in range(len(grid))]
    row = full.agg(F.sum(F.when(F.col("mode") == next(iter(weights)), F.col("weight"))).alias("w"),
                   F.array(*totals).alias("s")).first()
    scores = [round(s / row["w"], 12) if row["w"] else 0.0 for s in (row["s"] if row["w"] else [0.0] * len(grid))]
    best = max(range(len(grid)), key=lambda i: (scores[i], -i))
    return grid[best], scores[best]


def tune_assertions(docs: DataFrame, scored: DataFrame, mode: str = "concept_first", grid=SCORE_GRID,
                    passes: int = 4, start=(0.5, 0.5, 0.5)) -> tuple[list[float], float]:
    """Coordinate ascent on the assertion score.

    scored: gold concepts + p (label probabilities). Counts add up over labels, so one job
    builds them per (document, mode, label) for every threshold; each step of the ascent then
    evaluates a whole coordinate in one aggregate over those short rows.
    """
    weights = blend(mode)
    points = tuple(dict.fromkeys([*grid, *start]))
    names = F.array(*[F.lit(a) for a in vocab.ASSERTIONS])
    # one narrow shuffle by document; the counts of all labels, modes and thresholds then stay in their task
    partitions = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = scored.filter(eligible_for_assertions()).select(
        "doc_id", "start", "end", "type", "assertions", "p").repartition(partitions, "doc_id")
    rows = slim.select("doc_id", "start", "end", "type", "assertions",
                       F.inline(F.arrays_zip(names.alias("value"), F.col("p").alias("prob"))))
    items = rows.withColumn("p", F.lit(1)).withColumn(
        "g", F.size(F.filter("assertions", lambda a: a == F.col("value"))))
    counts = _grid_counts(_keyed_by_mode(items, weights), ["doc_id", "mode", "value"], points)
    wide = counts.groupBy("doc_id", "mode").agg(*[
        F.max(F.when(F.col("value") == a, F.struct("inter", "union", "n_gold"))).alias(a)
        for a in vocab.ASSERTIONS]).persist()
    n_docs = docs.count()
    if n_docs == 0:
        return list(start), 0.0
    share = F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, float(w))])
    # Documents without eligible concepts score 1 under every threshold.
    covered = wide.select("doc_id").distinct().count()
    constant = (n_docs - covered) * sum(weights.values())

    def evaluate(th: list[float], j: int) -> list[float]:
        """Scores of `th` with every grid point in place j; one row per (document, mode, point)."""
        at = {a: points.index(t) for a, t in zip(vocab.ASSERTIONS, th)}
        moving = vocab.ASSERTIONS[j]
        fixed = [a for a in vocab.ASSERTIONS if a != moving]
        base = lambda f: sum((F.col(a)[f][at[a]] for a in fixed), F.lit(0))
        rows = wide.select(
            share[F.col("mode")].alias("share"), base("inter").alias("i"), base("union").alias("u"),
            sum((F.col(a)["n_gold"] for a in vocab.ASSERTIONS), F.lit(0)).alias("n_gold"),
            F.posexplode(F.arrays_zip(F.col(moving)["inter"].alias("di"), F.col(moving)["union"].alias("du"))).alias("point", "d"))
        score = jaccard(F.col("i") + F.col("d.di"), F.col("u") + F.col("d.du"), F.col("n_gold"))
        found = dict(rows.groupBy("point").agg(F.sum(F.col("share") * score)).collect())
        return [(found.get(i, 0.0) + constant) / n_docs for i in range(len(points))]

    current = list(start)
    best = evaluate(current, 0)[points.index(current[0])]
    for _ in range(passes):
        improved = False
        for j in range(len(vocab.ASSERTIONS)):
            scores = evaluate(current, j)
            for t in grid:
                score = scores[points.index(t)]
                if score > best + 1e-9:
                    best, improved = score, True
                    current = current[:j] + [t] + current[j + 1:]
        if not improved:
            break
    wide.unpersist()
    return current, best
