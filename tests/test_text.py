"""Hand-computed cases of the text, context, layout and label functions."""

from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions import context as ctx
from spanwright.functions import text as tx
from spanwright.operators import assertion, bio, layout, metrics, postprocess, tagging
from spanwright.operators.concepts import validate

DX = vocab.DIAGNOSIS


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_normal_forms(spark):
    c = F.col("s")
    assert one(spark, tx.normalize(c), s="Viêm phổi² (cấp)") == "viêm phổi² cấp"
    assert one(spark, tx.normalize(c), s="  é  B ") == "é b"
    assert one(spark, tx.match_key(c), s=" Ho\t KHAN, ") == "ho khan,"
    assert one(spark, tx.tokens(tx.normalize(c)), s="ASA325mg") == ["asa", "325", "mg"]
    assert one(spark, tx.expand_aliases(tx.normalize(c)), s="asa 325mg") == "aspirin 325mg"
    assert one(spark, tx.clean_title(c), s=" 2) Bệnh sử : ") == "Bệnh sử"
    assert one(spark, tx.shingles(c), s="a b c") == []
    assert one(spark, tx.shingles(c, 2), s="A b a B") == ["a b", "b a"]
    assert one(spark, postprocess.heading_key(c), s="- Kết quả  xét nghiệm: ") == "kết quả xét nghiệm"


def test_wer(spark):
    w = metrics.wer(F.col("a"), F.col("b"))
    assert abs(one(spark, w, a="a b c", b="a c") - 1 / 3) < 1e-12
    assert one(spark, w, a="", b="x") == 1.0
    assert one(spark, w, a=" ", b="") == 0.0
    assert one(spark, w, a="a", b="x y z") == 3.0
    many = " ".join(f"w{i}" for i in range(3000))
    assert one(spark, w, a=many, b=many.replace("w7 ", "")) == 1 / 3000


def test_answers(spark):
    s = F.col("s")
    assert one(spark, ctx.parse_labels(s), s='ok ["isFamily","isNegated","x"]') == ["isNegated", "isFamily"]
    assert one(spark, ctx.parse_labels(s), s="isHistorical [1]") == ["isHistorical"]
    assert one(spark, ctx.parse_labels(s), s="[broken isFamily") == ["isFamily"]
    codes = F.array(F.lit("I10"), F.lit("I10.1"))
    assert one(spark, ctx.parse_code(s, codes), s=" I10.1 ") == "I10.1"
    assert one(spark, ctx.parse_code(s, codes), s="none of them") is None
    assert one(spark, ctx.parse_code(s, codes), s="I10, not none") == "I10"
    assert one(spark, ctx.parse_code(s, codes), s="XI10") is None


def test_rules_and_contexts(spark, tables):
    docs, concepts = tables
    a, b = "bệnh nhân sốt, không có ho", "tiền sử gia đình đái tháo đường"
    rows = [(1, 0, "ho", DX, 24, 26, [], []), (1, 1, "ho", "TÊN_XÉT_NGHIỆM", 24, 26, [], []),
            (2, 0, "đái tháo đường", DX, 17, 31, [], [])]
    out = {(r.doc_id, r.cid): r.assertions for r in
           assertion.annotate_rules(docs({1: a, 2: b}), concepts(rows)).collect()}
    assert out == {(1, 0): ["isNegated"], (1, 1): [], (2, 0): ["isHistorical", "isFamily"]}


def test_layout(spark, tables):
    docs, concepts = tables
    text = "1. A\nB:\n- x\n2. C\n- y\n1.5 mg"
    found = sorted((r.start, r.level, r.title) for r in layout.find_headings(docs({1: text})).collect())
    assert found == [(0, 1, "A"), (5, 2, "B"), (12, 1, "C"), (21, 1, "5 mg")]
    at = [(1, i, t, DX, text.index(t), text.index(t) + 1, [], []) for i, t in enumerate("xy")]
    for parts, want in ((2, {"x": "A › B", "y": "C"}), (1, {"x": "B", "y": "C"}), (0, {"x": "A › B", "y": "C"})):
        got = layout.section_path(concepts(at), layout.find_headings(docs({1: text})), parts).collect()
        assert {r.text: r.section for r in got} == want
    made = layout.model_inputs(docs({1: text}), concepts(at), section=False, lines_before=0, lines_after=0).collect()
    assert {r.text: r.input for r in made} == {"x": f"{DX} | - «x»", "y": f"{DX} | - «y»"}


def test_validation(spark, tables):
    docs, concepts = tables
    rows = [(1, 0, "sốt", "TRIỆU_CHỨNG", 3, 6, [], []), (1, 1, "sốt", "TRIỆU_CHỨNG", 3, 9, [], []),
            (1, 2, "ho", "TRIỆU_CHỨNG", 0, 2, ["bad"], ["X"])]
    got = {r.cid: r.errors for r in validate(docs({1: "ho sốt"}), concepts(rows)).collect()}
    assert got == {0: [], 1: ["out_of_range"], 2: ["bad_assertion", "codes_not_allowed"]}


def test_gazetteer(spark, tables):
    docs, _ = tables
    phrases = spark.createDataFrame([("ho", "A", (1, 0)), ("ho khan", "B", (1, 1)), ("x", "C", (1, 2))],
                                    "phrase string, type string, rank struct<doc_id:long,cid:int>")
    got = sorted((r.doc_id, r.start, r.end, r.type, r.text) for r in tagging.tag(
        docs({1: "Ho khan, ho", 2: "khoẻ_ho x"}), phrases).collect())
    assert got == [(1, 0, 7, "B", "Ho khan"), (1, 9, 11, "A", "ho"), (2, 5, 7, "A", "ho")]


def test_gazetteer_without_head_table(spark, tables, monkeypatch):
    docs, _ = tables
    monkeypatch.setattr(tagging, "BROADCAST_BYTES", -1)
    test_gazetteer(spark, tables)


def test_gazetteer_greedy_order(spark):
    hits = spark.createDataFrame(
        [(1, 0, 4, "A", 3), (1, 3, 8, "B", 2), (1, 7, 11, "C", 1), (1, 8, 12, "D", 0), (1, 20, 22, "E", 5)],
        "doc_id long, start int, end int, type string, rank int")
    got = sorted((r.start, r.type) for r in tagging.longest_first(hits).collect())
    assert got == [(3, "B"), (8, "D"), (20, "E")]


def test_bio(spark, tables):
    docs, _ = tables
    types = ("A", "B")
    rows = [(1, i, s, s + 1) for i, s in enumerate(range(0, 10, 2))]
    tokens = spark.createDataFrame(rows, "doc_id long, idx int, cs int, ce int")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 4), (1, 3, 0), (1, 4, 2)],
                                   "doc_id long, idx int, label int")
    got = sorted((r.start, r.end, r.type) for r in bio.decode(
        docs({1: "a b c d e"}), tokens.join(labels, ["doc_id", "idx"]), types).collect())
    assert got == [(0, 3, "A"), (4, 5, "B"), (8, 9, "A")]
    spans = spark.createDataFrame([(1, 0, 0, 5, "A"), (1, 1, 4, 7, "B"), (1, 2, 0, 9, "Z")],
                                  "doc_id long, cid int, start int, end int, type string")
    coded = bio.encode(tokens.union(spark.createDataFrame([(1, 9, 0, 0)], tokens.schema)), spans, types)
    assert [r.label for r in coded.orderBy("idx").collect()] == [1, 2, 3, 4, 0, -100]


def test_postprocess(spark, tables):
    _, concepts = tables
    rows = [(1, 0, "ho", "A", 0, 2, [], []), (1, 1, "Ho ", "B", 3, 6, [], ["c1"]), (1, 2, "ho", "B", 7, 9, [], ["c2"]),
            (1, 3, "Kết quả xét nghiệm:", "A", 10, 20, [], []), (1, 4, "a **** b", "A", 30, 38, [], []),
            (1, 5, "a ** b", "A", 40, 46, [], [])]
    got = {r.cid: (r.type, r.candidates) for r in postprocess.apply(concepts(rows)).collect()}
    assert got == {0: ("B", ["c1"]), 1: ("B", ["c1"]), 2: ("B", ["c1"]), 5: ("A", [])}


def test_graft(spark, tables):
    _, concepts = tables
    pred = concepts([(1, 0, "a", "T", 0, 3, [], []), (1, 1, "b", "T", 4, 8, [], [])])
    gold = concepts([(1, 0, "g", "T", 5, 7, [], [])])
    spans = spark.createDataFrame([(1, 5, 9)], "doc_id long, s int, e int")
    dev = spark.createDataFrame([(1,), (2,)], "doc_id long")
    grafted, stats = postprocess.graft_all(pred, gold, spans, dev, dev.filter("doc_id = 1"))
    assert sorted((r.start, r.end, r.text) for r in grafted.collect()) == [(0, 3, "a"), (5, 7, "g")]
    assert [(r.doc_id, r.n_gold) for r in stats.collect()] == [(1, 1)]
