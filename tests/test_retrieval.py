"""Retrieval and tuning against direct computation on small random data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.operators import mapping, metrics, retrieval


def okapi(corpus, query):
    n = len(corpus)
    lengths = [len(d) for d in corpus]
    mean = sum(lengths) / n
    df = {}
    for d in corpus:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    return [round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean))
                      for w in query), 9) for d in corpus]


@pytest.mark.parametrize("seed,hot", [(1, 100_000), (2, 5), (3, 1)])
def test_bm25(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(retrieval, "HOT_POSTINGS", hot)
    rng, k = random.Random(seed), 3
    rare = [f"r{i}" for i in range(40)]
    common = ["a", "b", "c"]
    corpus = [[rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randint(1, 14))] for _ in range(70)]
    queries = [[rng.choice(common + rare) for _ in range(rng.randint(1, 6))] for _ in range(12)] + [["zz"], ["a"], ["a", "b", "c"]]
    # digits and letters are split apart by the tokenizer, in the corpus and in the queries
    split = lambda ws: [p for w in ws for p in ([w[0], w[1:]] if len(w) > 1 and w[1:].isdigit() else [w])]
    entries = spark.createDataFrame([(i, f"c{i % 9}", " ".join(d), " ".join(d)) for i, d in enumerate(corpus)],
                                    "ord long, code string, description string, norm string")
    asked = spark.createDataFrame([(str(i), " ".join(q)) for i, q in enumerate(queries)], "key string, norm string")
    got = {}
    for r in retrieval.bm25_search(asked, entries, k).collect():
        got.setdefault(r.key, []).append((r.rank, r.code, round(r.score, 6)))
    for i, q in enumerate(queries):
        scores = okapi([split(d) for d in corpus], split(q))
        order = sorted(range(len(corpus)), key=lambda j: (-scores[j], j))[:3 * k]
        best = {}
        for j in order:
            best.setdefault(f"c{j % 9}", round(scores[j], 6))
        want = [(n, c, s) for n, (c, s) in enumerate(list(best.items())[:k])]
        assert sorted(got[str(i)]) == want


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    e, q, k = rng.normal(size=(90, 8)), rng.normal(size=(40, 8)), 4
    entries = spark.createDataFrame([(i, f"c{i % 30}", "", v.tolist()) for i, v in enumerate(e)],
                                    "ord long, code string, description string, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "key long, vector array<double>")
    got = {}
    for r in retrieval.dense_search(asked, entries, k).collect():
        got.setdefault(r.key, []).append((r.rank, r.code))
    for i in range(len(q)):
        order = np.argsort(-np.round(e @ q[i], 9), kind="stable")[:3 * k]
        codes = list(dict.fromkeys(f"c{j % 30}" for j in order))[:k]
        assert sorted(got[i]) == list(enumerate(codes))


def test_fusion(spark):
    def hits(codes):
        return spark.createDataFrame([("q", i, c, 0.0, f"{c}!") for i, c in enumerate(codes)],
                                     "key string, rank int, code string, score double, description string")

    got = retrieval.fuse([hits("ab"), hits("bc")], 3).orderBy("rank").collect()
    assert [r.code for r in got] == ["b", "a", "c"]
    assert abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-9


def test_lookup_needs_one_entry(spark, tables):
    _, concepts = tables
    dx = vocab.DIAGNOSIS
    kb = spark.createDataFrame([(dx, 1, "I1", "ho khan", "ho khan"), (dx, 2, "I1", "ho khan", "ho khan"),
                                (dx, 3, "J1", "sốt", "sốt"), (vocab.DRUG, 4, "R1", "aspirin 81", "aspirin 81")],
                               "type string, ord long, code string, description string, norm string")
    rows = [(1, 0, "Ho khan", dx, 0, 7, [], []), (1, 1, "Sốt!", dx, 8, 11, [], []), (1, 2, "ASA 81", vocab.DRUG, 12, 18, [], []),
            (1, 3, "x", "TRIỆU_CHỨNG", 0, 1, [], ["Z"]), (1, 4, "known", dx, 0, 5, [], ["K9"])]
    lookup = mapping.fit_lookup(concepts(rows))
    got = {r.cid: r.candidates for r in mapping.map_lookup(concepts(rows), lookup, kb).collect()}
    assert got == {0: [], 1: ["J1"], 2: [], 3: [], 4: ["K9"]}
    exact = mapping.with_unique_exact(concepts(rows[:3]).withColumn("norm", F.lower(F.regexp_replace("text", "!", ""))), kb)
    assert {r.cid: (r.n_exact, r.exact_code) for r in exact.collect()} == {0: (2, None), 1: (1, "J1"), 2: (1, "R1")}


def random_scored(rng, n_docs):
    rows = []
    for d in range(n_docs):
        for c in range(rng.randint(0, 5)):
            gold = [a for a in vocab.ASSERTIONS if rng.random() < 0.4]
            codes = [rng.choice("XY")] if rng.random() < 0.6 else []
            rows.append((d, c, f"t{c}", rng.choice(vocab.TYPES), c * 5, c * 5 + 2, gold, codes,
                         [round(rng.random(), 2) for _ in range(3)], round(rng.random(), 2), [rng.choice("XY")]))
    return rows


def overlap(gold, pred):
    if not gold and not pred:
        return 1.0
    values = set(gold) | set(pred)
    if not gold:
        return 0.0
    return sum(min(gold.count(v), pred.count(v)) for v in values) / sum(max(gold.count(v), pred.count(v)) for v in values)


@pytest.mark.parametrize("seed", [1, 2])
def test_tuning(spark, seed):
    rng = random.Random(seed)
    n_docs, rows = 12, random_scored(rng, 12)
    scored = spark.createDataFrame(rows, "doc_id long, cid int, text string, type string, start int, end int, assertions array<string>, "
                                         "candidates array<string>, p array<double>, gate double, picked array<string>")
    docs = spark.range(n_docs).withColumnRenamed("id", "doc_id")
    weights = {"concept": 2 / 3, "value": 1 / 3}

    def score(th):
        total = 0.0
        for mode, w in weights.items():
            for d in range(n_docs):
                mine = [r for r in rows if r[0] == d and r[3] in vocab.TYPES_WITH_ASSERTIONS]
                tag = lambda r, a: (r[4], r[3], a) if mode == "concept" else a
                gold = [tag(r, a) for r in mine for a in r[6]]
                pred = [tag(r, a) for r in mine for a, p, t in zip(vocab.ASSERTIONS, r[8], th) if p >= t]
                total += w * overlap(gold, pred)
        return total / n_docs

    current, best, moved, rounds = [0.5] * 3, score([0.5] * 3), True, 0
    while moved and rounds < 4:
        moved, rounds = False, rounds + 1
        for j in range(3):
            for t in metrics.SCORE_GRID:
                trial = current[:j] + [t] + current[j + 1:]
                if score(trial) > best + 1e-9:
                    best, current, moved = score(trial), trial, True
    th, s = metrics.tune_assertions(docs, scored)
    assert th == current and abs(s - best) < 1e-9

    def gate_score(t):
        total = 0.0
        for mode, w in weights.items():
            num = den = 0.0
            for d in range(n_docs):
                mine = [r for r in rows if r[0] == d and r[3] in vocab.TYPES_WITH_CANDIDATES]
                tag = lambda r, v: (r[4], r[3], v) if mode == "concept" else v
                size = sum(len(r[7]) + 1 for r in mine)
                num += size * overlap([tag(r, v) for r in mine for v in r[7]], [tag(r, v) for r in mine if r[9] >= t for v in r[10]])
                den += size
            total += w * num / den
        return total

    all_scores = [(-round(gate_score(t), 12), t) for t in metrics.GATE_GRID]
    t, s = metrics.tune_gate(docs, scored)
    assert (t, round(s, 9)) == (min(all_scores)[1], round(-min(all_scores)[0], 9))


def test_scores_of_equal_sides(spark, tables):
    _, concepts = tables
    rows = [(1, 0, "a b", vocab.DIAGNOSIS, 0, 3, ["isNegated"], ["X"]), (2, 0, "c", vocab.DRUG, 0, 1, [], [])]
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    row = metrics.score_dataset(docs, concepts(rows), concepts(rows)).first()
    assert (row.text, row.assertions, row.candidates, row.final) == (1.0, 1.0, 1.0, 1.0)
    empty = metrics.score_dataset(docs.limit(0), concepts(rows).limit(0), concepts(rows).limit(0)).first()
    assert (empty.text, empty.assertions, empty.candidates, empty.final) == (0.0, 0.0, 0.0, 0.0)
