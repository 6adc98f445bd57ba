"""Texts with random access against plain strings: slices, lines, clauses, contexts and their cost."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions import context as ctx
from spanwright.functions.lines import GROUP, PIECE, cut, pieced
from spanwright.functions.text import WS
from spanwright.operators.concepts import with_text

BLANK = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), WS)
LETTERS = "ab-,;. \t\n-, 😀é•"


def _text(rng, size, breaks):
    return "".join(rng.choices(LETTERS + "\n" * breaks, k=size)) if breaks else "".join(
        rng.choices(LETTERS.replace("\n", "") + "abcdefgh" * 4, k=size))


def _line(t, s, e):
    a = t.rfind("\n", 0, s) + 1
    b = t.find("\n", e)
    return a, len(t) if b < 0 else b


def _clause(t, s):
    return re.split(rf"[\n;.]|(?:^|{BLANK})-{BLANK}|,{BLANK}", t[_line(t, s, s)[0]:s])[-1].lower()


def _strip(s):
    return re.sub(rf"\A{BLANK}+|{BLANK}+\Z", "", s)


def _window(t, s, e, before, after, lb, la):
    left = "\n".join(t[:s].split("\n")[-(lb + 1):])[-before:]
    right = "\n".join(t[e:].split("\n")[:la + 1])[:after]
    return _strip(left + vocab.MARK_LEFT + t[s:e] + vocab.MARK_RIGHT + right)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    texts = ["", "a", "\n", "a" * PIECE, "\n" * PIECE, "a" * PIECE + "\n" + "b" * PIECE, " " * 3000 + "- x",
             "x, " + ", - " * 400 + "y", "x" * (GROUP * PIECE - 1) + "\n" + "y" * 300 + "\n" + "z" * (2 * GROUP * PIECE)]
    texts += [_text(rng, rng.choice((3, 40, PIECE - 1, PIECE, PIECE + 1, 3 * PIECE, 5000)), rng.choice((0, 0, 1, 8))) for _ in range(60)]
    places = []
    for d, t in enumerate(texts):
        spots = [(0, 0), (len(t), len(t))] + [tuple(sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))) for _ in range(4)]
        spots += [(s, min(len(t), s + 5)) for s in (rng.randint(0, len(t)) for _ in range(12))]
        places += [(d, i, s, e) for i, (s, e) in enumerate(spots)]
    return dict(enumerate(texts)), places


def test_against_plain_strings(spark, tables, cases):
    texts, places = cases
    docs = tables[0](texts)
    rows = spark.createDataFrame(places, "doc_id long, cid int, start int, end int")
    got = with_text(docs, rows, piece=lambda t, c: t.slice(c["start"], c["end"]),
                    at=lambda t, c: F.array(t.line_start(c["start"]), t.line_end(c["end"]), t.length()),
                    clause=lambda t, c: ctx.clause_before(t, c["start"]), line=ctx.line_of,
                    bullet=lambda t, c: ctx.in_bullet_line(t, c["start"]),
                    narrow=ctx.context_window, wide=lambda t, c: ctx.context_window(t, c, 40, 30, 1, 2)).collect()
    assert len(got) == len(places)
    for r in got:
        t, s, e = texts[r.doc_id], r.start, r.end
        a, b = _line(t, s, e)
        assert r.piece == t[s:e]
        assert r["at"] == [a, b, len(t)], (r.doc_id, s, e)
        assert r.clause == _clause(t, s), (r.doc_id, s)
        assert r.line == _strip(t[a:b])[:200]
        assert r.bullet == bool(re.match(r"[ \t]*[-–—•]", t[a:_line(t, s, s)[1]]))
        assert r.narrow == _window(t, s, e, 160, 60, 0, 0)
        assert r.wide == _window(t, s, e, 40, 30, 1, 2)


def test_plain_column_gives_the_same(spark, tables, cases):
    texts, places = cases
    rows = spark.createDataFrame(places, "doc_id long, cid int, start int, end int")
    same = ["clause", "line", "window"]
    c = F.struct("start", "end")
    plain = rows.join(tables[0](texts), "doc_id").select(
        "doc_id", "cid", ctx.clause_before(F.col("text"), F.col("start")).alias("clause"),
        ctx.line_of(F.col("text"), c).alias("line"), ctx.context_window(F.col("text"), c).alias("window"))
    cutted = with_text(tables[0](texts), rows, clause=lambda t, c: ctx.clause_before(t, c["start"]), line=ctx.line_of,
                       window=ctx.context_window).select("doc_id", "cid", *same)
    assert plain.exceptAll(cutted).count() == cutted.exceptAll(plain).count() == 0


def test_null_and_missing_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 0, 0, 3), (2, 0, 0, 3), (3, 0, 0, 3)], "doc_id long, cid int, start int, end int")
    got = with_text(docs, rows, piece=lambda t, c: t.slice(c["start"], c["end"]), line=ctx.line_of)
    assert {r.doc_id: (r.piece, r.line) for r in got.collect()} == {1: (None, None), 2: ("", "")}
    assert cut(docs.limit(0)).select(pieced().length().alias("n")).count() == 0


@pytest.mark.parametrize("breaks", [0, 1])
def test_double_document_double_time(spark, tables, breaks):
    """A document of one long line, or of many lines, with a mention every 100 characters."""
    rng, took = random.Random(3), []
    base = _text(rng, 100_000, breaks)
    for times in (1, 2, 8):
        text = base * times
        rows = spark.range(len(text) // 100).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("cid"),
                                                    (F.col("id") * 100).cast("int").alias("start"), (F.col("id") * 100 + 5).cast("int").alias("end"))
        work = with_text(tables[0]({1: text}), rows, line=ctx.line_of, window=ctx.context_window,
                         clause=lambda t, c: ctx.clause_before(t, c["start"]))
        start = time.perf_counter()
        work.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    assert took[2] < 8 * took[1] + 2, took  # four times the text; far below the 16 of quadratic work
