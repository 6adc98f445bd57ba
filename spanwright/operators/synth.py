"""Synthetic sectioned documents with exact labels, built from a pool of known concepts.

Every random choice is a hash of (seed, document, place), so a lost task redraws the same
values. Concepts and prose windows are drawn by joining on a dense index; text is assembled
from ordered pieces and offsets follow from the piece lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions.text import let
from spanwright.session import durable

# Probabilities and sizes of the generator.
QA_PROB, PROSE_PROB, DRUG_SECTION_PROB = 0.35, 0.65, 0.33
NOISE_PROB, NOISE_PAIR_PROB, NEGATED_PROB = 0.10, 0.6, 0.12
PROSE_CHARS, PROSE_TRIES = 900, 10
KB_DIAGNOSES, KB_DRUGS, KB_MIN_LEN, KB_MAX_LEN = 4000, 1500, 3, 70

_POOL = ("text", "type", "assertions", "candidates")


def build_pool(concepts: DataFrame) -> DataFrame:
    """pool(type, akey, text, assertions, candidates): akey is the first assertion or NULL."""
    return concepts.select("type", F.get("assertions", F.lit(0)).alias("akey"), "text", "assertions", "candidates")


def merge_pools(*pools: DataFrame) -> DataFrame:
    merged = pools[0]
    for p in pools[1:]:
        merged = merged.unionByName(p)
    return merged


def kb_pool(kb: DataFrame, n_diagnoses: int = KB_DIAGNOSES, n_drugs: int = KB_DRUGS, seed: int = 0,
            max_len: int = KB_MAX_LEN) -> DataFrame:
    """Knowledge-base names as labelled mentions: a fixed-size sample per type, three label variants."""
    usable = kb.filter(F.length("description").between(KB_MIN_LEN, max_len))
    parts = None
    for ctype, n in ((vocab.DIAGNOSIS, n_diagnoses), (vocab.DRUG, n_drugs)):
        drawn = (usable.filter(F.col("type") == ctype)
                 .orderBy(F.xxhash64(F.lit(seed), "code", "description"), "code", "ord").limit(n))
        parts = drawn if parts is None else parts.unionByName(drawn)
    variants = F.array(F.lit(None).cast("string"), F.lit("isHistorical"), F.lit("isNegated"))
    none = F.array().cast("array<string>")
    return parts.withColumn("akey", F.explode(variants)).select(
        "type", "akey", F.col("description").alias("text"),
        F.when(F.col("akey").isNull(), none).otherwise(F.array("akey")).alias("assertions"),
        F.array("code").alias("candidates"))


def dense_index(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df + idx 0..n-1 per key, counts(key, n)) without ever sorting one key in one task.

    Rows are numbered inside (input partition, key) and shifted by per-partition counts.
    """
    # the numbering is written out once: computed twice it could follow different partitions
    tagged = durable(df.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_id", 33)))
    local = Window.partitionBy("_part", *keys).orderBy("_id")
    sizes = tagged.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = tagged.withColumn("_rn", F.row_number().over(local) - 1)
    cond = None
    for c in ("_part", *keys):
        e = numbered[c].eqNullSafe(offsets[c])
        cond = e if cond is None else cond & e
    joined = numbered.join(offsets, cond)
    out = joined.select(*[numbered[c] for c in df.columns], (F.col("_rn") + F.col("_off")).alias("idx"))
    counts = sizes.groupBy(*keys).agg(F.sum("_n").alias("n")) if keys else sizes.agg(F.sum("_n").alias("n"))
    return out, counts


def unit(seed: int, *parts) -> Column:
    """Uniform number in [0, 1) from a hash of its arguments."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)).cast("double") / float(1 << 53)


def pick(values, u: Column) -> Column:
    options = F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])
    return F.get(options, F.floor(u * len(values)).cast("int"))


def _below(n: Column, u: Column) -> Column:
    return F.floor(u * n).cast("int")


def _shuffled(items: Column, seed: int, *place) -> Column:
    """Array in an order drawn from the hash of (place, position)."""
    keyed = F.transform(items, lambda x, i: F.struct(unit(seed, *place, i).alias("u"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def _grammar() -> Column:
    """Section grammar as an array of structs (order, titles, subsections)."""
    def slot(t: str, a: str | None) -> Column:
        return F.struct(F.lit(t).alias("type"), F.lit(a).cast("string").alias("akey"))

    def sub(titles, slots) -> Column:
        return F.struct(F.array(*map(F.lit, titles)).alias("titles"),
                        F.array(*[slot(*s) for s in slots]).alias("slots"))

    return F.array(*[F.struct(F.lit(i).alias("order"), F.array(*map(F.lit, titles)).alias("titles"),
                              F.array(*[sub(*s) for s in subs]).alias("subs"))
                     for i, (titles, subs) in enumerate(vocab.SECTIONS)])


def _one(options: Column, u: Column) -> Column:
    return F.get(options, _below(F.size(options), u))


def outline(spark, n: int, seed: int, qa_prob: float = QA_PROB) -> DataFrame:
    """One row per section line: (doc_id, qa, sec, sub, item, slot type and assertion)."""
    doc = spark.range(n).withColumnRenamed("id", "doc_id")
    d = F.col("doc_id")
    count = 2 + _below(F.lit(3), unit(seed, "n_sec", d))
    grammar = _grammar()
    catalog = F.when(unit(seed, "drugs", d) < DRUG_SECTION_PROB, grammar).otherwise(F.slice(grammar, 1, 3))
    drawn = doc.withColumn("qa", unit(seed, "qa", d) < qa_prob).withColumn(
        "secs", F.array_sort(F.slice(_shuffled(catalog, seed, F.lit("secs"), d), F.lit(1), count),
                             lambda a, b: a["order"] - b["order"]))
    sections = drawn.select("doc_id", "qa", F.posexplode("secs").alias("sec", "s"))
    s = F.col("sec")
    n_sub = 1 + _below(F.least(F.size("s.subs"), F.lit(3)), unit(seed, "n_sub", d, s))
    subs = sections.withColumn("title", _one(F.col("s.titles"), unit(seed, "h1", d, s))).select(
        "doc_id", "qa", "sec", "title",
        F.posexplode(F.slice(_shuffled(F.col("s.subs"), seed, F.lit("subs"), d, s), F.lit(1), n_sub)).alias("sub", "b"))
    b = F.col("sub")
    items = subs.withColumn("subtitle", _one(F.col("b.titles"), unit(seed, "h2", d, s, b))).withColumn(
        "item", F.explode(F.sequence(F.lit(0), 1 + _below(F.lit(5), unit(seed, "n_item", d, s, b)))))
    return items.withColumn("slot", _one(F.col("b.slots"), unit(seed, "slot", d, s, b, F.col("item")))).select(
        "doc_id", "qa", "sec", "title", "sub", "subtitle", "item",
        F.col("slot.type").alias("type"), F.col("slot.akey").alias("akey"))


def _draw(slots: DataFrame, indexed: DataFrame, counts: DataFrame, seed: int, name: str) -> DataFrame:
    """Add `name`: a pool row drawn for (type, want), NULL when the pool has none."""
    sizes = F.broadcast(counts.select(F.col("type").alias("_t"), F.col("akey").alias("_a"), F.col("n").alias("_n")))
    sized = slots.join(sizes, (F.col("type") == F.col("_t")) & F.col("want").eqNullSafe(F.col("_a")), "left")
    place = [F.col(c) for c in ("doc_id", "sec", "sub", "item")]
    target = sized.withColumn("_i", F.floor(unit(seed, name, *place) * F.col("_n")).cast("long")).drop("_t", "_a", "_n")
    rows = indexed.select(F.col("type").alias("_t"), F.col("akey").alias("_a"), "idx", F.struct(*_POOL).alias(name))
    return target.join(rows, (F.col("type") == F.col("_t")) & F.col("want").eqNullSafe(F.col("_a"))
                       & (F.col("_i") == F.col("idx")), "left").drop("_t", "_a", "idx", "_i")


def prose_windows(wanted: DataFrame, docs: DataFrame, concepts: DataFrame, seed: int,
                  target: int = PROSE_CHARS) -> DataFrame:
    """For each wanted (doc_id, at): the first of ten random line-aligned windows with a concept.

    Result: doc_id, at, text, items (concept structs with offsets inside the window).
    """
    packed = concepts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cid", *_POOL, "start", "end"))).alias("c"))
    rows = docs.select("doc_id", "text").join(packed, "doc_id", "left").select("text", "c")
    indexed, counts = dense_index(rows, [])
    total = counts.first()["n"] or 0
    tries = wanted.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(PROSE_TRIES - 1))))
    u = lambda what: unit(seed, what, F.col("doc_id"), F.col("at"), F.col("try"))
    aimed = tries.withColumn("idx", F.floor(u("doc") * total).cast("long")).join(indexed, "idx")
    n = F.length("text")
    raw = F.floor(u("from") * (n - target)).cast("int")
    placed = aimed.withColumn("whole", n <= target + 2).withColumn("raw", F.when(F.col("whole"), 0).otherwise(raw))
    a = F.when(F.col("whole"), 0).otherwise(
        F.col("raw") - F.length(F.substring_index(F.substring("text", F.lit(1), F.col("raw")), "\n", -1)))
    lined = placed.withColumn("a", a.cast("int"))
    after = F.substring(F.col("text"), F.col("a") + target + 1, n)  # the end is looked for from the moved start
    b = F.when(F.col("whole"), n).otherwise(F.col("a") + target + F.length(F.substring_index(after, "\n", 1)))
    cut = lined.withColumn("b", b.cast("int"))
    moved = let(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), lambda w: F.transform(
        F.filter("c", lambda x: (x["start"] >= w["a"]) & (x["end"] <= w["b"])),
        lambda x: F.struct(*[x[f].alias(f) for f in _POOL], (x["start"] - w["a"]).alias("start"),
                           (x["end"] - w["a"]).alias("end"))))
    hit = cut.select("doc_id", "at", "try", F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")).alias("text"),
                     moved.alias("items")).filter(F.size("items") > 0)
    return hit.groupBy("doc_id", "at").agg(F.min_by(F.struct("text", "items"), "try").alias("w")).select(
        "doc_id", "at", "w.text", "w.items")


def synthesize(spark, pool: DataFrame, n: int = 400, seed: int = 0, qa_prob: float = QA_PROB,
               labelled: tuple[DataFrame, DataFrame] | None = None, prose_prob: float = PROSE_PROB) -> DataFrame:
    """n documents (doc_id, text, concepts) with the layout and label rules of the grammar.

    `labelled` = (docs, concepts) enables real prose windows between the sections.
    """
    lines = durable(outline(spark, n, seed, qa_prob))
    place = [F.col(c) for c in ("doc_id", "sec", "sub", "item")]
    u = lambda what: unit(seed, what, *place)
    indexed, counts = dense_index(pool, ["type", "akey"])
    noisy = u("noise") < NOISE_PROB
    noise = F.when(u("noise_kind") < NOISE_PAIR_PROB,
                   pick([f"    - {k}: {v}\n" for k, v in vocab.NOISE_PAIRS], u("noise_pair"))).otherwise(
        pick([f"    - {x}\n" for x in vocab.NOISE_LINES], u("noise_line")))
    base = lines.withColumn("noise", F.when(noisy, noise)).withColumn(
        "negate", F.col("akey").isNull() & (u("negate") < NEGATED_PROB))
    wants = base.withColumn("want", F.when(F.col("negate"), F.lit("isNegated")))
    tried = _draw(wants, indexed, counts, seed, "negated")
    tried = _draw(tried.withColumn("want", F.col("akey")), indexed, counts, seed, "plain")
    tried = _draw(tried.withColumn("want", F.lit(None).cast("string")), indexed, counts, seed, "fallback")
    negated = F.col("negate") & F.col("negated").isNotNull()
    chosen = F.when(negated, F.col("negated")).otherwise(F.coalesce("plain", "fallback"))
    prefix = F.concat(pick(vocab.BULLETS, u("bullet")),
                      F.when(negated, pick(vocab.NEGATION_PREFIXES, u("neg_prefix"))).otherwise(""))
    entries = tried.withColumn("chosen", F.when(F.col("noise").isNull(), chosen)).withColumn(
        "lead", F.when(F.col("noise").isNotNull(), F.col("noise")).when(F.col("chosen").isNotNull(), prefix))

    none = F.array().cast("array<struct<text:string,type:string,assertions:array<string>,"
                          "candidates:array<string>,start:int,end:int>>")
    size = F.length("lead")
    item = F.array(F.struct(*[F.col(f"chosen.{f}").alias(f) for f in _POOL], size.alias("start"),
                            (size + F.length("chosen.text")).alias("end")))
    order = lambda stage, sec=-1, sub=-1, line=-1: F.struct(
        F.lit(stage).alias("stage"), *[(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(k)
                                       for k, x in (("sec", sec), ("sub", sub), ("line", line))])
    sec, sub = F.col("sec"), F.col("sub")
    body = entries.filter("lead is not null").select(
        "doc_id", order(1, sec, sub, F.col("item")).alias("o"),
        F.when(F.col("chosen").isNull(), F.col("lead")).otherwise(
            F.concat("lead", F.col("chosen.text"), F.lit("\n"))).alias("piece"),
        F.when(F.col("chosen").isNull(), none).otherwise(item).alias("items"))
    heads = lines.select("doc_id", "sec", "title").distinct().select(
        "doc_id", order(1, sec).alias("o"), F.concat((sec + 1).cast("string"), F.lit(".  "), "title", F.lit("\n")).alias("piece"),
        none.alias("items"))
    subheads = lines.select("doc_id", "sec", "sub", "subtitle").distinct().select(
        "doc_id", order(1, sec, sub).alias("o"), F.concat(F.lit("    "), "subtitle", F.lit("\n")).alias("piece"), none.alias("items"))
    docs = lines.select("doc_id", "qa").distinct()
    d = F.col("doc_id")
    ends = lines.select("doc_id", "sec").distinct().select(
        "doc_id", order(1, sec, 1 << 20).alias("o"), F.lit("\n").alias("piece"), none.alias("items"))
    asked = docs.filter("qa").select(
        "doc_id", order(0).alias("o"), F.concat(pick(vocab.QUESTION_OPENINGS, unit(seed, "open", d)), F.lit("\n")).alias("piece"),
        none.alias("items"))
    answered = docs.filter("qa").select(
        "doc_id", order(2).alias("o"),
        F.concat(pick(vocab.ANSWER_OPENINGS, unit(seed, "answer", d)), F.lit("\n"),
                 pick(vocab.ANSWER_GREETINGS, unit(seed, "greet", d)), F.lit("\n")).alias("piece"), none.alias("items"))
    pieces = body
    for more in (heads, subheads, ends, asked, answered):
        pieces = pieces.unionByName(more)
    if labelled is not None:
        after_section = lines.select("doc_id", "sec").distinct().filter(
            unit(seed, "prose", d, sec) < prose_prob * 0.5).select("doc_id", order(1, sec, (1 << 20) + 1).alias("at"))
        opening = docs.filter(F.col("qa") & (unit(seed, "prose_q", d) < prose_prob)).select("doc_id", order(0, 0).alias("at"))
        closing = docs.filter(F.col("qa") & (unit(seed, "prose_a", d) < prose_prob)).select("doc_id", order(2, 0).alias("at"))
        windows = prose_windows(opening.unionByName(after_section).unionByName(closing), *labelled, seed)
        pieces = pieces.unionByName(windows.select(
            "doc_id", F.col("at").alias("o"), F.concat("text", F.lit("\n")).alias("piece"), "items"))
    return assemble(pieces)


def assemble(pieces: DataFrame) -> DataFrame:
    """Join ordered pieces to documents; item offsets move with the start of their piece."""
    w = Window.partitionBy("doc_id").orderBy("o")
    placed = pieces.withColumn("base", F.coalesce(F.sum(F.length("piece")).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    grouped = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o", "piece", "base", "items"))).alias("p"))
    moved = F.flatten(F.transform("p", lambda x: F.transform(x["items"], lambda c: F.struct(
        c["text"].alias("text"), c["type"].alias("type"), (c["start"] + x["base"]).alias("start"),
        (c["end"] + x["base"]).alias("end"), c["assertions"].alias("assertions"), c["candidates"].alias("candidates")))))
    return grouped.select("doc_id", F.array_join("p.piece", "").alias("text"), moved.alias("concepts"))


def to_records(dataset: DataFrame) -> DataFrame:
    """Records for JSON lines: text, spans, concepts (labels only where they apply), source, split."""
    from spanwright.sources.documents import concept_json

    return dataset.select(
        "text",
        F.transform("concepts", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["type"].alias("type"))).alias("spans"),
        F.transform("concepts", concept_json).alias("concepts"),
        F.lit("layout_synth").alias("source"), F.lit("train").alias("split"))
