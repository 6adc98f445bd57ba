"""Operators 11 to 13 against plain versions on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanwright.llm import collocations, infill, tokengroups
from spanwright.llm.fmindex import WordIndex, transform
from spanwright.llm.words import utf8

DOCS = "doc_id long, text string, lang string, infill string, a string, h1 int, word string, rank int, id string, rep int, token string"


@pytest.fixture(scope="module")
def texts(prose):
    base = prose(60, 1)
    near = base.split()
    near[3] = "changed"
    return [None, "", " \n\t ", "one", "Two words", base, base, " ".join(near), base.upper(), prose(30000, 2), "é" * 300, "a\nb\na\n\n" * 30,
            base + " <S> x", prose(30, 3) + " 中文 🙂\x0b🙂 <P", "P>" + base, *[prose(9, k) + ". the new york Times, of the" for k in range(40)]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "x", "y", 1, "z", 2, "i", 3, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, texts[5], *[None] * 9)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_matches_plain_version(docs, texts, empty):
    form, output = F.col("infill.form"), F.col("infill.output")
    moved = infill.infilled(docs)
    assert moved.columns == [c for c in docs.columns]
    got = moved.select("doc_id", "infill.*", *[c.alias(n) for c, n in zip(infill.part_lengths(form, output), "pm", strict=True)],
                       infill.restored(form, output).alias("restored")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[5 if r.doc_id is None else r.doc_id]
        assert (r.n, r.form, r.p, r.m, r.output) == plain_infill(r.doc_id, text)
        assert r.restored == (text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.infilled(empty).count() == 0


def test_a_very_long_text_is_cut_without_a_deep_stack(spark):
    text = "ab " * 400_000 + "  "
    many = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    form, output = F.col("infill.form"), F.col("infill.output")
    got = infill.infilled(many).select("doc_id", "infill.n", "infill.form", (infill.restored(form, output) == text).alias("same")).collect()
    assert all(r.same and r.n == 400_001 for r in got) and any(r.form != "plain" for r in got)


@pytest.mark.parametrize("alphabet", [2, 4, 9])
def test_index_counts_every_phrase(alphabet):
    rng = np.random.default_rng(alphabet)
    for _ in range(60):
        text = np.concatenate(([0], rng.integers(0, alphabet, rng.integers(1, 80)), [0]))
        found = WordIndex(transform(text, 4), transform(text[::-1], 4), alphabet)
        one = found.single()
        two = found.left(one)
        steps = [one, two, found.left(two), found.right(two), found.right(found.left(two)), found.left(found.right(two))]
        for p in steps:
            k = p.symbols.shape[1]
            want = Counter(tuple(map(int, text[i:i + k])) for i in range(len(text) - k + 1) if 0 not in text[i:i + k])
            assert {tuple(map(int, s)): int(c) for s, c in zip(p.symbols, p.count, strict=True)} == want


def plain_collocations(rows, least, percent=80, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        found = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in able.items()):
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def test_rare_pairs_are_counted_without_their_words(spark, tmp_path):
    values = np.array([0, 1, 255, 256, 70000, 2**32 - 1])
    assert collocations._unplaned(np.frombuffer(collocations._planes(values), np.uint8)).tolist() == values.tolist()
    rows = [(i, f"good old day w{i} x{i}", "en") for i in range(40)] + [(99, "old day. w1 x2 w1 x2 w3", "en")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang").repartition(3)
    every = spark.sparkContext.broadcast(np.full(1 << 17, 255, np.uint8))
    shards = collocations.index(texts, str(tmp_path / "index"), every, shard_words=20)
    seen = collocations._likely_pairs(shards, 5, every, 1 << 20, bucket_words=1)
    assert 0 < int(np.unpackbits(seen.value).sum()) <= 2          # "good old" and "old day", of more than eighty pairs
    found = collocations._summed(shards, 2, 5, [every], seen).collect()
    assert sorted(r.a for r in found) == [40, 41]


@pytest.mark.parametrize("shard,slots", [(1 << 19, 1 << 25), (150, 1 << 12)])
def test_collocations_match_plain_version(docs, empty, shard, slots):
    """Also with many small shards, and with phrases that share a slot so that only the final counts decide."""
    got = collocations.collocations(docs, least=5, shard_words=shard, slots=slots).collect()
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, got)) == plain_collocations(rows, 5) and len(got) > 20
    assert collocations.collocations(empty).count() == 0


def test_shard_words_do_not_depend_on_pieces(texts, monkeypatch):
    def taken():
        shard, column = collocations._Shard(), pa.array(texts)
        shard.add(*utf8(column), np.arange(len(texts)) % 2)
        words, of, _, _, symbols, new = shard.taken(["en", "de"], 0)
        return [(words[int(k)].as_py(), int(of[k]), bool(n)) for k, n in zip(symbols, new, strict=True)]

    whole = taken()
    for size in (5, 400):
        monkeypatch.setattr("spanwright.llm.words.GROUP_BYTES", size)
        monkeypatch.setattr(collocations, "GROUP_BYTES", size)
        assert taken() == whole


def test_check_numbers_tell_words_apart(prose):
    words = sorted({*prose(3000, 8).split(), "ab", "ba", "aab", "aba", "é", ""})
    numbers = collocations._check_number(pa.array(words), np.zeros(len(words), np.uint64))
    assert len(set(numbers.tolist())) == len(words)
    assert numbers[3] == collocations._check_number(pa.array([words[3]]), np.zeros(1, np.uint64))[0]


def test_collocations_take_another_seed_when_hashes_clash(docs, monkeypatch):
    real, seeds = collocations._frequent, []

    def clashing(*given):
        seeds.append(1)
        words = real(*given)
        return words.withColumn("clash", F.lit(True)) if len(seeds) == 1 else words

    monkeypatch.setattr(collocations, "_frequent", clashing)
    assert collocations.collocations(docs, least=20).count() > 0 and len(seeds) == 2


def plain_components(rows, width, percent):
    """{row number: (set size, smallest id reachable)} by comparing all pairs of rows with an id."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        k = min(width, len(words))
        sets.append(frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset())
    low = [r[0] for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and None not in (low[a], low[b])
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    return [(r[0], len(s), x) for r, s, x in zip(rows, sets, low, strict=True)]


def families(prose):
    """Texts with near copies at all distances around the threshold, a chain of edits, a shared passage, and copies."""
    draw = random.Random(11)
    out = [None, "", "one", "one two", "Two words", "two WORDS", prose(3000, 1)]
    base = prose(60, 2).split()
    for k in range(150):  # one family of many groups
        copy = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 6])):
            copy[draw.randrange(len(copy))] = f"w{draw.randrange(400)}"
        out.append(" ".join(copy))
    chain = prose(80, 3).split()
    for k in range(40):
        chain[k] = f"c{k}"
        out.append(" ".join(chain))
    passage = prose(25, 4)
    out += [passage + " " + prose(draw.randint(1, 60), 50 + k) for k in range(40)]
    out += [" ".join(prose(n, 200 + n).split()[:-1]) for n in range(2, 30)] + [prose(n, 200 + n) for n in range(2, 30)]
    out += out[5:40]
    return out


@pytest.mark.parametrize("percent,width", [(90, 3), (80, 2)])
def test_jaccard_components_match_brute_force(spark, prose, empty, percent, width):
    rows = [(1000 - i if i % 2 else i, t) for i, t in enumerate(families(prose))] + [(None, prose(60, 2)), (5, prose(60, 2)), (5, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, "g", "c", 2) for i, t in rows], "doc_id long, text string, rep string, n int, g string, c string, m1 int")
    got = tokengroups.jaccard_components(docs, width, percent).collect()
    # of rows with one id the sizes tell which is which
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_components(rows, width, percent)))
    assert tokengroups.jaccard_components(empty).count() == 0


def test_jaccard_refuses_low_thresholds(docs):
    with pytest.raises(ValueError):
        tokengroups.jaccard_components(docs, percent=70)


def test_linked_sets_share_prefix_tokens():
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 9, tokengroups.SKETCH).astype(np.uint16)
    for percent in (80, 90):
        for _ in range(300):
            size = int(draw.integers(5, 120))
            one = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
            two = np.unique(np.concatenate((draw.choice(one, max(1, len(one) - int(draw.integers(0, size // 5 + 1))), replace=False),
                                            draw.integers(0, 1 << 63, int(draw.integers(0, size // 8 + 1))).astype(np.uint64))))
            both = len(np.intersect1d(one, two))
            if 100 * both >= percent * (len(one) + len(two) - both) and both < max(len(one), len(two)):  # linked, not equal
                met = np.intersect1d(tokengroups.prefix(one, counts, percent), tokengroups.prefix(two, counts, percent))
                assert len(met) >= tokengroups.MEET


def test_large_linked_sets_share_more_prefix_tokens():
    draw = np.random.default_rng(4)
    counts = draw.integers(0, 9, tokengroups.SKETCH).astype(np.uint16)
    for percent in (80, 90):
        for size in (150, 600, 4000):
            for _ in range(20):
                one = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
                lost = len(one) * (100 - percent) // 100  # as many as a link allows where nothing else is added
                two = draw.choice(one, len(one) - int(draw.integers(1, lost + 1)), replace=False)
                two.sort()
                met = np.intersect1d(tokengroups.prefix(one, counts, percent), tokengroups.prefix(two, counts, percent))
                assert len(met) >= tokengroups.meet(len(two)) > tokengroups.MEET
