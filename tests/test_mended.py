"""Cases that earlier versions answered wrongly."""

import random

from pyspark.sql import functions as F

from spanwright.functions.context import parse_labels
from spanwright.operators import mapping, models, retrieval, tagging
from spanwright import vocab


def test_first_seen_is_numeric(spark):
    rows = [("10", 0, "ho", vocab.DIAGNOSIS, 0, 2, [], ["A"]), ("2", 0, "ho", vocab.DRUG if hasattr(vocab, "DRUG") else vocab.TYPES_WITH_CANDIDATES[-1], 0, 2, [], ["B"])]
    concepts = spark.createDataFrame(rows, "doc_id string, cid int, text string, type string, start int, end int, assertions array<string>, candidates array<string>")
    assert tagging.fit_gazetteer(concepts).first()["type"] == rows[1][3]
    same = concepts.withColumn("type", F.lit(vocab.DIAGNOSIS))
    assert mapping.fit_lookup(same).first()["code"] == "B"


def test_labels_need_strict_json(spark):
    answers = spark.createDataFrame([("['isNegated'] not isFamily",), ('["isNegated"] not isFamily',)], "a string")
    got = [sorted(r[0]) for r in answers.select(parse_labels(F.col("a"))).collect()]
    assert got == [["isFamily", "isNegated"], ["isNegated"]]


def test_zero_fill_has_no_pool(spark):
    """Entries that score below zero fill more than any fixed pool; the zero-score ones still come first."""
    scored = spark.range(1300).select(F.lit("q").alias("key"), F.col("id").cast("int").alias("ord"), F.lit(-0.2).alias("score"))
    entries = spark.range(1400).select(F.col("id").cast("int").alias("ord"))
    queries = spark.createDataFrame([("q",)], "key string")
    fill = retrieval._zero_fill(queries, scored, entries, 5).orderBy("ord").limit(5).collect()
    assert [r["ord"] for r in fill] == [1300, 1301, 1302, 1303, 1304]


def test_zero_fill_lists_the_first_free_entries(spark):
    """Against brute force: gaps at both ends, ords with holes, queries without hits, with all entries, with enough hits."""
    rng, depth = random.Random(4), 6
    ords = sorted(rng.sample(range(1000), 90))
    taken = {f"q{i}": rng.sample(ords, rng.choice((0, 1, 5, 30, 85, 90))) for i in range(40)} | {"all": ords, "head": ords[:7], "none": []}
    score = {(q, o): rng.choice((-0.5, 0.0, 0.0, 0.4)) if q != "head" else 0.4 for q, os in taken.items() for o in os}
    scored = spark.createDataFrame([(*k, v) for k, v in score.items()], "key string, ord int, score double")
    entries = spark.createDataFrame([(o,) for o in rng.sample(ords, len(ords))], "ord int")
    got = {}
    for r in retrieval._zero_fill(spark.createDataFrame([(q,) for q in taken], "key string"), scored, entries, depth).collect():
        got.setdefault(r["key"], []).append(r["ord"])
    short = [q for q, os in taken.items() if sum(score[q, o] > 0 for o in os) < depth]
    want = {q: [o for o in ords if o not in taken[q]][:depth] for q in short}
    assert {q: sorted(os) for q, os in got.items()} == {q: os for q, os in want.items() if os}
    numbers = retrieval.number_entries(entries).orderBy("ord").collect()
    assert [(r["ord"], r["slot"]) for r in numbers] == [(o, n) for n, o in enumerate(ords)]
    assert retrieval.number_entries(entries.limit(0)).count() == 0


def test_model_cache_hits_and_frees():
    def loader(n):
        return lambda: (lambda: n)

    first = models._instance(loader(1))
    assert models._instance(loader(1)) is first
    models._instance(loader(2))
    assert len(models._LOADED) == 1
