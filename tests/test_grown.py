"""Work that grew faster than the input: what a step shuffles, keeps or repeats."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanwright.operators import retrieval


def test_bm25_shuffles_no_pairs(spark, monkeypatch):
    """Scores of (query, entry) pairs are summed where the entry lies; no plan groups by both."""
    plans, kept = [], retrieval.durable
    monkeypatch.setattr(retrieval, "durable", lambda df: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    entries = spark.createDataFrame([(i, f"c{i}", "d", f"a b{i % 3}") for i in range(30)], "ord long, code string, description string, norm string")
    asked = spark.createDataFrame([("x", "a"), ("y", "b 1"), ("z", "")], "key string, norm string")
    hits = retrieval.bm25_search(asked, entries, 4)
    plans.append(hits._jdf.queryExecution().toString())
    assert not [p for p in plans if re.search(r"hashpartitioning\(key#\d+, ord#", p)]
    got = {(r["key"], r["rank"]): r["code"] for r in hits.collect()}
    assert [got["y", i] for i in range(4)] == ["c1", "c4", "c7", "c10"]
    assert [got["z", i] for i in range(4)] == ["c0", "c1", "c2", "c3"]


def test_block_scores_keep_ties_in_entry_order():
    """Fewer entries than asked for, queries without a term, negative weights, equal scores."""
    q = pa.table({"key": ["a", "a", "b", "n"], "tid": pa.array([1, None, None, None], pa.int64()), "w": [2.0, 0.0, 0.0, 0.0]})
    e = pa.table({"ord": pa.array([9, 9, 4, 7, 7, 2], pa.int32()), "tid": pa.array([1, None, None, 1, None, None], pa.int64()),
                  "w": [0.5, 0.0, 0.0, -1.0, 0.0, 0.0]})
    out = retrieval._block_scores(3)(q, e).to_pylist()
    rows = lambda k: sorted(((r["ord"], r["score"]) for r in out if r["key"] == k))
    assert rows("a") == [(2, 0.0), (4, 0.0), (9, 1.0)] and rows("b") == rows("n") == [(2, 0.0), (4, 0.0), (7, 0.0)]
    assert len(retrieval._block_scores(9)(q, e)) == 12
    assert len(retrieval._block_scores(3)(q.slice(0, 0), e)) == len(retrieval._block_scores(3)(q, e.slice(0, 0))) == 0
    assert np.isclose(sum(r["score"] for r in retrieval._block_scores(9)(q, e).to_pylist()), -1.0)


def test_short_texts_are_not_cut(spark):
    """A text of one piece gets its piece and line breaks directly; the numbers stay those of the text."""
    from spanwright.functions.lines import PIECE, cut

    texts = [None, "", "\n", "a", "ab\ncd", "\n\n", "x" * PIECE, "\n" + "é" * (PIECE - 1), "\U0001F600" * (PIECE - 1) + "\n", "x\n" * (PIECE // 2) + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in cut(docs).collect():
        t = texts[r["doc_id"]]
        if t is None:
            assert r["_size"] is None
            continue
        pieces = [t[i:i + PIECE] for i in range(0, len(t), PIECE)]
        at = [i * PIECE for i in range(len(pieces) + 1)]
        assert (r["_size"], r["_pieces"]) == (len(t), pieces)
        assert r["_above"] == [t.rfind("\n", 0, i) + 1 for i in at], repr(t[:20])
        assert r["_below"] == [t.find("\n", i) if t.find("\n", i) >= 0 else len(t) for i in at], repr(t[:20])
    assert cut(docs)._jdf.queryExecution().optimizedPlan().toString().count("array(text") > 0


def test_unified_concepts_are_read_once(spark):
    """Types and labels against direct counting, with nulls and ties; no join, no shuffle of rows laid out by document."""
    import random

    from spanwright.operators import postprocess

    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice(["Ho ", "ho", "x", None]), rng.choice(["A", "B", None]),
             rng.choice([[], ["p"], ["q"], ["p", "q"], None])) for i in range(160)]
    concepts = spark.createDataFrame(rows, "doc_id long, cid int, text string, type string, candidates array<string>")
    key = lambda r: (r[0], r[2].strip().lower() if r[2] is not None else None)

    def majority(members, value):
        seen = {}
        for r in members:
            seen.setdefault(repr(value(r)), []).append(r)
        return value(min(seen.values(), key=lambda rs: (-len(rs), min(r[1] for r in rs)))[0])

    whole = [r for r in rows if None not in key(r)]
    types = {r["cid"]: r["type"] for r in postprocess.unify_types(concepts).collect()}
    assert types == {r[1]: majority([x for x in whole if key(x) == key(r)], lambda x: x[3]) for r in whole}
    want = {}
    for r in rows:
        peers = [x for x in whole if key(x) == key(r) and x[3] == r[3] and r[3] is not None and x[4]]
        want[r[1]] = majority(peers, lambda x: x[4]) if peers else r[4]
    assert {r["cid"]: r["candidates"] for r in postprocess.unify_labels(concepts).collect()} == want
    plan = postprocess.unify_labels(postprocess.unify_types(concepts.repartition("doc_id")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_large_tables_get_bounded_tasks(spark, monkeypatch):
    from spanwright import session

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    assert session.bounded_tasks(spark.range(5000), "id").rdd.getNumPartitions() == 100
    small = spark.range(300)
    assert session.bounded_tasks(small, "id") is small


def test_sections_keep_the_layout_by_document(spark):
    """Concepts with their section are grouped by document without another shuffle."""
    from spanwright.operators import layout

    concepts = spark.createDataFrame([(1, 0, "x", 5), (2, 0, "y", 1)], "doc_id long, cid int, text string, start int")
    headings = spark.createDataFrame([(1, 2, 4, 1, "Top")], "doc_id long, start int, end int, level int, title string")
    placed = layout.section_path(concepts, headings)
    assert placed.columns == [*concepts.columns, "section"]
    assert sorted(map(tuple, placed.collect())) == [(1, 0, "x", 5, "Top"), (2, 0, "y", 1, "")]
    plan = placed.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_short_texts_are_read_without_lambdas(spark, tables):
    """Texts of one piece, of several and null ones side by side; only long texts go through interpreted lambdas."""
    from spanwright.functions import context as ctx
    from spanwright.functions.lines import PIECE
    from spanwright.operators.concepts import with_text

    texts = {1: "ab\n- cd ef\n", 2: "x" * PIECE + "\n- cd ef", 3: None, 4: "\u3000é\u2028 "}
    rows = spark.createDataFrame([(1, 0, 5, 7), (1, 1, 0, 2), (2, 0, PIECE + 3, PIECE + 5), (3, 0, 0, 1), (4, 0, 1, 2)],
                                 "doc_id long, cid int, start int, end int")
    done = with_text(tables[0](texts), rows, line=ctx.line_of, at=lambda t, c: t.line_start(c["start"]),
                     kinds=lambda t, c: F.array(F.when(t.length() > 3, "long"), F.lit("any")))
    got = {(r["doc_id"], r["cid"]): (r["line"], r["at"], r["kinds"]) for r in done.collect()}
    assert got == {(1, 0): ("- cd ef", 3, ["long", "any"]), (1, 1): ("ab", 0, ["long", "any"]), (2, 0): ("- cd ef", PIECE + 1, ["long", "any"]),
                   (3, 0): (None, None, [None, "any"]), (4, 0): ("é", 0, ["long", "any"])}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "_now" in plan and "isnull(_short" in plan.lower()


def test_words_are_found_as_by_the_pattern():
    from spanwright.functions.batches import CHUNK, words_of

    fields = [pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("text", pa.string())]
    texts = [None, "", "ab_cde fgh1", "😀é²Ⅷ中௧ª\u0301\x00½x", "abcd", "efgh", "x" * CHUNK, " " + "ü" * CHUNK, None]
    for least in (1, 3, 4):
        want = [None if t is None else [dict(start=m.start(), end=m.end(), text=m.group()) for m in re.finditer(r"[^\W_]+", t)
                                        if m.end() - m.start() >= least] for t in texts]
        assert words_of(pa.array(texts), least, fields).to_pylist() == want
        assert words_of(pa.array(texts).slice(2, 3), least, fields).to_pylist() == want[2:5]
    assert len(words_of(pa.array([], pa.string()), 1, fields)) == 0


def test_blanks_are_those_of_the_pattern(spark):
    from spanwright.functions.text import BLANKS, WS, lstrip, strip

    every = spark.range(0x10000).filter("id < 55296 or id > 57343").select(F.decode(
        F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert sorted(r["c"] for r in every.filter(F.col("c").rlike(f"^{WS}$")).collect()) == sorted(BLANKS)
    sides = spark.createDataFrame([(BLANKS + "a " + BLANKS + "b" + BLANKS,), (BLANKS,), ("",), (None,)], "t string")
    assert [tuple(r) for r in sides.select(strip(F.col("t")), lstrip(F.col("t"))).collect()] == [
        ("a " + BLANKS + "b", "a " + BLANKS + "b" + BLANKS), ("", ""), ("", ""), (None, None)]


def test_outlines_are_made_once(spark):
    """Every reading of the outlines in a plan is the same shuffle, and words are found once per reading."""
    from spanwright.plans.registered import REGISTERED

    frame = REGISTERED["mention_lines"][0](spark, "/root/testdata/sf0.001")
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 1 and len(re.findall(r"ArrowEvalPython", final)) == 1


def test_dense_blocks_travel_packed(spark, monkeypatch):
    """Blocks of several sizes, ties across tiles and blocks, both kinds of vectors: as by sorting all products."""
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(90, 4)), 1).astype("float32")
    vectors[50:60] = vectors[:10]
    vectors[88] = 0
    rows = [(i, f"c{i % 40}", "", [float(x) for x in v]) for i, v in enumerate(vectors)]
    sims = np.round(vectors.astype("float64") @ vectors.astype("float64").T, 9)
    want = {}
    for i in range(90):
        codes = []
        for j in np.argsort(-sims[i], kind="stable")[:9]:
            codes += [(f"c{j % 40}", sims[i, j])] if f"c{j % 40}" not in [c for c, _ in codes] else []
        want[i] = codes[:3]
    monkeypatch.setattr(retrieval, "TILE", (7, 13))
    for kind, size in (("float", 1 << 20), ("float", 400), ("double", 640)):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        monkeypatch.setattr(retrieval, "ENTRY_BYTES", size)
        entries = spark.createDataFrame(rows, f"ord int, code string, description string, vector array<{kind}>")
        hits = retrieval.dense_search(entries.select(F.col("ord").alias("key"), "vector"), entries, 3)
        got = {}
        for r in sorted(hits.collect(), key=lambda r: (r["key"], r["rank"])):
            got.setdefault(r["key"], []).append((r["code"], r["score"]))
        assert got == want, (kind, size)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not re.search(r"cast\(vector#\d+ as array<double>\).*explode\(sequence", plan)


def test_best_products_of_few_and_equal_columns():
    """Fewer columns than asked for, all equal, none left out by rounding."""
    one, two = np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([[0.5, 0.1]] * 3)
    row, column, score = retrieval._best(one, two, 5)
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and column.tolist() == [0, 1, 2] * 2 and score.tolist() == [0.5] * 3 + [0.1] * 3
    assert retrieval._best(one, two, 2)[1].tolist() == [0, 1, 0, 1]
    close = np.array([[0.3 + 4e-10], [0.3 - 4e-10], [0.3]] * 2)
    assert retrieval._best(np.array([[1.0]]), close, 3)[1].tolist() == [0, 1, 2]


def test_shards_are_written_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """A task with many shards writes groups of bounded size, and the index is the same."""
    import pyarrow.parquet as pq

    from spanwright.llm import collocations

    class Every:
        value = np.full(1 << 10, 255, np.uint8)

    rng = np.random.default_rng(1)
    texts = spark.createDataFrame([(" ".join(f"w{k}" for k in rng.integers(0, 400, 300)), "en") for _ in range(60)], "text string, lang string").coalesce(1)
    found = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a shard is closed between batches only
    for size in (16 << 20, 20_000):
        monkeypatch.setattr(collocations, "INDEX_BYTES", size)
        path = str(tmp_path / str(size))
        found.append(sorted(map(str, collocations.index(texts, path, Every, 0, 600).collect())))
        groups = [pq.ParquetFile(f).metadata for f in (tmp_path / str(size)).glob("*.parquet")]
        rows = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
        assert sum(rows) == len(found[0]) >= 25 and (len(rows) == 1 if size > 1 << 20 else max(rows) <= 10)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]
