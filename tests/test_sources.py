"""Files in and out, the folder pipeline, synthesis and the stream wrapper."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.operators import synth, tagging
from spanwright.plans.annotate import run
from spanwright.sources import documents, external, knowledge
from spanwright.streaming.annotate import annotate_stream, watch_json

PHRASES = "phrase string, type string, rank struct<doc_id:long,cid:int>"


@pytest.fixture
def folder(tmp_path):
    texts = tmp_path / "in"
    texts.mkdir()
    (texts / "2.txt").write_bytes("sốt\r\nho khan".encode())
    (texts / "10.txt").write_bytes("không có ho".encode())
    (texts / "1.txt").write_bytes(b"nothing")
    return tmp_path


def test_read_texts(spark, folder):
    got = {r.doc_id: (r.ord, r.text) for r in documents.read_texts(spark, str(folder / "in")).collect()}
    assert got == {"1": (1, "nothing"), "2": (2, "sốt\nho khan"), "10": (10, "không có ho")}
    assert [r.doc_id for r in documents.list_ids(spark, str(folder / "in")).collect()] == ["1", "2", "10"]


def test_run_writes_one_file_per_document(spark, folder):
    phrases = spark.createDataFrame([("ho", "TRIỆU_CHỨNG", (1, 0)), ("ho khan", vocab.DIAGNOSIS, (1, 1))], PHRASES)
    out = folder / "out"
    run(spark, str(folder / "in"), str(out), tagger=lambda d: tagging.tag(d, phrases))
    read = lambda n: json.loads((out / f"{n}.json").read_text(encoding="utf-8"))
    assert sorted(p.name for p in out.iterdir()) == ["1.json", "10.json", "2.json"]
    assert read(1) == []
    assert read(2) == [{"text": "ho khan", "type": vocab.DIAGNOSIS, "position": [4, 11], "candidates": [], "assertions": []}]
    assert read(10) == [{"text": "ho", "type": "TRIỆU_CHỨNG", "position": [9, 11], "assertions": ["isNegated"]}]
    documents.package(str(out), str(folder / "o.zip"))
    assert zipfile.ZipFile(folder / "o.zip").namelist() == ["output/1.json", "output/2.json", "output/10.json"]
    docs, concepts = documents.read_labelled(spark, str(folder / "in"), str(out))
    assert (docs.count(), concepts.count()) == (3, 2)
    (out / "1.json").unlink()
    with pytest.raises(FileNotFoundError):
        documents.read_labelled(spark, str(folder / "in"), str(out))


def test_invalid_concepts_stop_the_run(spark, tables):
    from spanwright.operators.concepts import require_valid

    docs, concepts = tables
    bad = concepts([(1, 0, "x", vocab.DRUG, 0, 9, [], [])])
    with pytest.raises(Exception, match="out_of_range"):
        require_valid(docs({1: "x"}), bad).collect()


def test_missing_fields(spark):
    raw = spark.createDataFrame([("a", '[{"text":"x"},{"position":[1,2],"assertions":null,"candidates":["c"]}]')], "doc_id string, value string")
    got = [tuple(r) for r in documents.parse_concepts(raw).orderBy("cid").collect()]
    assert got == [("a", 0, "x", "", 0, 0, [], []), ("a", 1, "", "", 1, 2, [], ["c"])]


def test_knowledge_files(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes('﻿code,description\nA01," Sốt ""cao"", kéo dài "\nB02,\n,x\n'.encode())
    (tmp_path / "r.csv").write_bytes("RXCUI,STR\n1,Aspirin 81\n2,\n,z\n".encode())
    dx = knowledge.read_diagnoses(spark, str(tmp_path / "d.csv")).orderBy("ord").collect()
    assert [(r.code, r.description, r.norm) for r in dx] == [("A01", 'Sốt "cao", kéo dài', "sốt cao kéo dài"), ("B02", "", "")]
    rx = knowledge.read_drugs(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.code, r.description, r.type) for r in rx] == [("1", "Aspirin 81", vocab.DRUG)]


def test_external_records(spark, tmp_path):
    lines = [{"text": "a", "spans": [[0, 1, "B"], [0, 1, "A"]], "source": "s", "split": "train"},
             {"text": "b", "spans": [], "source": "s", "split": "test"}]
    (tmp_path / "vimq.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines))
    paths = external.default_paths(str(tmp_path))
    assert len(paths) == 1
    records = external.read_records(spark, *paths, splits={"train"})
    assert [(r.text, [tuple(s) for s in r.spans]) for r in records.collect()] == [("a", [(0, 1, "B"), (0, 1, "A")])]
    assert [r.type for r in external.record_types(records).collect()] == ["A", "B"]


def pool_rows():
    return [(1, i, f"{t.lower()} {i}", t, 0, 4, [a] if a else [], [f"K{i}"]) for t in vocab.TYPES
            for a in (None, "isHistorical", "isNegated") for i in range(3)]


def test_synthesis(spark, tables, tmp_path):
    docs, concepts = tables
    text = "\n".join(f"dòng {i} ho khan và sốt cao" for i in range(120))
    gold = concepts([(1, 0, "ho khan", "TRIỆU_CHỨNG", 7, 14, [], []), (1, 1, "sốt", "TRIỆU_CHỨNG", text.index("sốt", 2000), text.index("sốt", 2000) + 3, [], [])])
    pool = synth.build_pool(concepts(pool_rows()))
    make = lambda seed: synth.synthesize(spark, pool, n=40, seed=seed, labelled=(docs({1: text}), gold))
    made = make(3).collect()
    assert len(made) == 40 and sum(len(r.concepts) for r in made) > 200
    assert any("Câu" in r.text for r in made) and any("dòng" in r.text for r in made)
    for r in made:
        assert r.text.startswith(("1.  ",) + tuple(vocab.QUESTION_OPENINGS))
        for c in r.concepts:
            assert r.text[c.start:c.end] == c.text
    again = {r.doc_id: r.text for r in make(3).collect()}
    assert again == {r.doc_id: r.text for r in made}
    assert {r.doc_id: r.text for r in make(4).collect()} != again
    external.write_records(synth.to_records(make(3)), str(tmp_path / "out"))
    back = external.read_records(spark, str(tmp_path / "out"))
    assert {r.text: len(r.spans) for r in back.collect()} == {r.text: len(r.concepts) for r in made}


def test_dense_index_covers_every_row(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") % 3 == 0).cast("string").alias("k"), "id")
    indexed, counts = synth.dense_index(df, ["k"])
    sizes = {r.k: r.n for r in counts.collect()}
    got = {}
    for r in indexed.collect():
        got.setdefault(r.k, []).append(r.idx)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in sizes.items()}


def test_stream(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"doc_id": "1", "text": "không có ho"}) + "\n")
    phrases = spark.createDataFrame([("ho", "TRIỆU_CHỨNG", (1, 0))], PHRASES)
    for expected in (1, 2):
        q = annotate_stream(watch_json(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"),
                            tagger=lambda d: tagging.tag(d, phrases))
        q.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (source / "b.json").write_text(json.dumps({"doc_id": "2", "text": "ho"}) + "\n")
