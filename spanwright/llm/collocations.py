"""Phrase collocations: counts of word sequences from an FM-index per shard, scores over all shards.

A first pass counts words. A shard is a run of whole documents with about `SHARD_WORDS` words; its FM-index over
the ids of frequent words (`fmindex`) is written once, and each further length is one pass over these indexes, in which all intervals of the phrases
that can still matter are extended at once, to the left for two and three words, to the right for four.
The counts of the extensions are summed across shards, and only phrases that reach the least count in
the whole corpus are extended in the next pass, since no longer phrase is more frequent than its parts.

What the corpus has passed on travels back to the shards as a bitmap of fixed size over hashed phrases
(`SLOTS`): a phrase missed by it cannot be frequent, one let through in error only costs a row. Words go
by a 64-bit hash of (lang, word); a second, independent number of 32 bits shows whether a frequent word shares its hash
with another word, and the next seed is taken then.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.llm.fmindex import WordIndex, transform
from spanwright.llm.words import GROUP_BYTES, LOWER, U64, groups, mix, pieces, spans, utf8, word_hashes
from spanwright.session import durable, shared_folder

LONGEST = 4
LEAST = 30
SHARD_WORDS = 1 << 19
SLOTS = 1 << 25
NO_LANG = "und"
SEEDS = 8
INDEX_BYTES = 16 << 20
"""Bytes of shards that are written and read together; a task may have many more of them."""
LOW = 24
"""Bits of the numbers by which pairs of one bucket are first counted; pairs that share one only cost a row."""

# What ends a piece, and what else separates words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True

_INDEX = ("shard string, sizes array<struct<lang:string,words:bigint>>, words array<string>, hashes array<bigint>, "
          "forward binary, reverse binary")


def _chunks(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes, row bounds, goes on with the last row) of parts of bounded size."""
    if len(data) <= 2 * GROUP_BYTES:
        yield 0, data, bounds, False
        return
    for row in range(len(bounds) - 1):
        for k, piece in enumerate(pieces(data[bounds[row]:bounds[row + 1]], APART)):
            yield row, piece, np.array([0, len(piece)]), k > 0


class _Shard:
    """Words of whole documents, gathered until there are enough for an index."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.starts: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.size = 0
        self.broken = False

    def add(self, data: np.ndarray, bounds: np.ndarray, langs: np.ndarray) -> None:
        """Rows of one group with the number of each row's language."""
        for row, raw, cuts, goes_on in _chunks(data, bounds):
            self.broken = self.broken and goes_on
            low = LOWER[raw]
            starts, ends = spans(low, cuts, APART)
            breaks = np.concatenate(([0], np.cumsum(BREAK[low])))
            if not len(starts):
                self.broken |= bool(breaks[-1])
                continue
            rows = np.searchsorted(cuts, starts, "right") - 1
            new = np.concatenate(([not goes_on or self.broken or breaks[starts[0]] > 0],
                                  (breaks[starts[1:]] > breaks[ends[:-1]]) | (rows[1:] > rows[:-1])))
            self.broken = bool(breaks[-1] > breaks[ends[-1]])
            offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
            self.words.append(pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[~APART[low]])))
            self.starts.append(new)
            self.langs.append(langs[row + rows])
            self.size += len(starts)

    def taken(self, names: list[str], seed: int):
        """(words, their languages' numbers, counts, hashes, symbol of each word in order, piece starts); the shard is empty then."""
        coded = pa.chunked_array(self.words, pa.string()).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        known = coded.dictionary
        pairs, symbols, counts = np.unique(np.concatenate(self.langs) * np.int64(len(known)) + coded.indices.to_numpy(),
                                           return_inverse=True, return_counts=True)
        words, of = known.take(pa.array(pairs % len(known))), pairs // len(known)
        _, hashed = word_hashes(*utf8(words), separators=np.zeros(256, bool), lower=False)
        salt = mix(np.array([_name_hash(n) for n in names], U64) + U64(seed))
        new = np.concatenate(self.starts)
        self.__init__()
        return words, of, counts, mix(hashed ^ salt[of]).view(np.int64), symbols, new


def _name_hash(name: str) -> int:
    _, hashed = word_hashes(*utf8(pa.array(["=" + name])), separators=np.zeros(256, bool), lower=False)
    return int(hashed[0])


def _gathered(batches: Iterator[pa.RecordBatch], seed: int, shard_words: int) -> Iterator[tuple[list[str], tuple]]:
    """(language names, what `_Shard.taken` gives) of one shard after another, from batches (text, lang)."""
    shard, names = _Shard(), []
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(1).dictionary_encode()
        names += [n for n in coded.dictionary.to_pylist() if n not in names]
        langs = np.array([names.index(n) for n in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        data, bounds = utf8(batch.column(0))
        for low, high in groups(bounds):
            shard.add(data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low], langs[low:high])
            if shard.size >= shard_words:
                yield names, shard.taken(names, seed)
    if shard.size:
        yield names, shard.taken(names, seed)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))


def _check_number(words: pa.Array, salt: np.ndarray) -> np.ndarray:
    """A 32-bit number of each word, made otherwise than its hash: sums of its bytes, plain and by place."""
    data, bounds = utf8(words)
    value = mix(data.astype(U64) + U64(0x51)) >> U64(8)
    place = np.arange(len(data), dtype=U64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(U64)
    one, two = (np.concatenate((np.zeros(1, U64), np.cumsum(v))) for v in (value, value * (place * place + U64(1))))
    total = (one[bounds[1:]] - one[bounds[:-1]]) * U64(0x9E3779B97F4A7C15) + (two[bounds[1:]] - two[bounds[:-1]])
    return (mix(total ^ salt) >> U64(32)).astype(np.uint32).view(np.int32)


def _frequent(texts: DataFrame, seed: int, least: int, shard_words: int) -> DataFrame:
    """(h1, lang, a, clash) of the words with at least `least` occurrences; `clash`: another word has the same hash."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, (words, of, counts, hashed, _, _) in _gathered(batches, seed, 2 * shard_words):
            check = _check_number(words, np.array([_name_hash(n) for n in names], U64)[of])
            yield pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(names, pa.string()).take(pa.array(of)), pa.array(counts), pa.array(check)],
                                             ["h1", "lang", "a", "check"])

    # counted per run of documents already; summing once more per task would gain little
    rows = texts.mapInArrow(each, "h1 bigint, lang string, a bigint, check int").repartition("h1")
    words = rows.groupBy("h1", "lang").agg(F.sum("a").alias("a"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    clash = (F.count(F.lit(1)).over(Window.partitionBy("h1")) > 1) | (F.col("lo") < F.col("hi"))
    return durable(words.select("h1", "lang", "a", clash.alias("clash")).where(F.col("a") >= least))


def index(texts: DataFrame, path: str, frequent, seed: int = 0, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Write an FM-index row per shard of `texts` (text, lang) as Parquet at `path` and read it.

    Words outside the bitmap `frequent` end a piece as breaks do: no frequent phrase runs over them. `sizes` counts all
    words; symbol k + 1 is the k-th of the words. Symbols take two bytes each where the shard's words allow it, else four.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        for made, (names, (words, of, counts, hashed, symbols, new)) in enumerate(_gathered(batches, seed, shard_words)):
            totals = np.bincount(of, weights=counts, minlength=len(names)).astype(np.int64)
            sizes = [{"lang": n, "words": int(t)} for n, t in zip(names, totals, strict=True) if t]
            keep = _in(bits, hashed, np.arange(len(hashed))[:, None])
            kind = np.uint16 if keep.sum() < 65535 else np.uint32
            text = np.zeros(len(symbols) + int(new.sum()) + 1, np.int64)
            text[np.arange(len(symbols)) + np.cumsum(new)] = (np.cumsum(keep) * keep)[symbols]
            text = text[np.concatenate(([True], (text[1:] > 0) | (text[:-1] > 0)))]
            text = text if text[-1] == 0 else np.append(text, 0)
            both = [pa.array([transform(t, LONGEST).astype(kind).tobytes()], pa.binary()) for t in (text, text[::-1])]
            kept = pa.array(np.flatnonzero(keep))
            bounds = pa.array([0, len(kept)], pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, v.take(kept)) for v in (words, pa.array(hashed))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{TaskContext.get().partitionId()}-{made}"]),
                 pa.array([sizes], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))), *lists, *both],
                ["shard", "sizes", "words", "hashes", "forward", "reverse"])

    # a row has megabytes, and Parquet looks at the size of a group after a hundred rows only: writer and reader would hold all shards of a task
    sized = {"parquet.block.size": INDEX_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    texts.mapInArrow(each, _INDEX).write.options(compression="zstd", **sized).parquet(path)
    return texts.sparkSession.read.parquet(path)


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    acc = np.zeros(len(columns[0]), U64)
    for c in columns:
        acc = mix(acc * U64(0xA0761D6478BD642F) + c.view(U64) + U64(1))
    return acc


def _slots(columns: list[np.ndarray], slots: int) -> np.ndarray:
    return (_mixed(columns) >> U64(64 - slots.bit_length() + 1)).astype(np.int64)


def _bitmap(spark: SparkSession, phrases: DataFrame, n: int, slots: int):
    """A broadcast bitmap of the places of all phrases of n hashes; `slots` (a power of two) bits, whatever their number."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(slots // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                at = _slots([batch.column(k).to_numpy() for k in range(n)], slots)
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        cells = bits.view("<i8")
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "bits"])

    found = phrases.select(*[f"h{k}" for k in range(1, n + 1)]).mapInArrow(each, "cell bigint, bits bigint")
    return _collected(spark, found, slots)


def _collected(spark: SparkSession, found: DataFrame, slots: int):
    """The broadcast bitmap of all (cell, bits)."""
    rows = found.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(slots // 64, "<i8")
    cells[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return spark.sparkContext.broadcast(cells.view(np.uint8))


def _in(bits: np.ndarray, hashes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    at = _slots([hashes[symbols[:, k]] for k in range(symbols.shape[1])], 8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32 byte by byte, all lowest bytes first: the empty high bytes cost nothing once compressed."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _likely_pairs(shards: DataFrame, least: int, single, slots: int, bucket_words: int = 1 << 21):
    """A broadcast bitmap of all pairs of words with at least `least` occurrences, and of a few others.

    Most pairs of a shard are rare everywhere. Their counts are first summed by a number of `LOW` bits within a bucket, which
    travels as compressed sorted differences; only pairs let through are counted by both words.
    """
    words = shards.select(F.inline("sizes")).agg(F.sum("words")).first()[0] or 0
    high = max(4, (words // bucket_words).bit_length())  # buckets follow the words, so each stays of bounded size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = single.value
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.concatenate(([0], batch.column(0)[i].values.to_numpy()))
                kind = np.uint16 if len(hashes) - 1 < 65535 else np.uint32
                side = np.frombuffer(batch.column(1)[i].as_buffer(), kind)
                found = WordIndex(side, side, len(hashes))
                at = found.single()
                at = found.left(at.where(_in(bits, hashes, at.symbols)))
                at = at.where(_in(bits, hashes, at.symbols[:, :1]))
                code = _mixed([hashes[at.symbols[:, k]] for k in range(2)]) >> U64(64 - LOW - high)
                order = np.argsort(code)
                code, held = code[order], np.minimum(at.count[order], least)
                bucket, low = (code >> U64(LOW)).astype(np.int64), (code & U64((1 << LOW) - 1)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(code)) if len(code) else [0]
                parts = [(int(bucket[a]), int(b - a), pa.compress(_planes(np.diff(low[a:b], prepend=0)) + _planes(held[a:b]), "zstd", asbytes=True))
                         for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in parts], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))],
                                                 ["bucket", "n", "pairs"])
            pa.default_memory_pool().release_unused()

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, helds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            n, raw = (batch.column(batch.schema.get_field_index(c)) for c in ("n", "pairs"))
            for k in range(batch.num_rows):
                one, two = np.frombuffer(pa.decompress(raw[k].as_buffer(), 8 * n[k].as_py(), "zstd"), np.uint8).reshape(2, -1)
                lows.append(np.cumsum(_unplaned(one)))
                helds.append(_unplaned(two))
        low, held = np.concatenate(lows), np.concatenate(helds)
        order = np.argsort(low)
        low, held = low[order], held[order]
        heads = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, np.int64)
        total = np.add.reduceat(held, heads) if len(heads) else held
        code = (U64(key[0].as_py()) << U64(LOW)) | low[heads][total >= least].astype(U64)
        at = np.unique(code >> U64(LOW + high - slots.bit_length() + 1)).astype(np.int64)
        cells, first = np.unique(at >> 6, return_index=True)
        masks = np.left_shift(U64(1), (at & 63).astype(U64))
        joined = np.bitwise_or.reduceat(masks, first) if len(at) else masks
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(joined.view(np.int64))], ["cell", "bits"])

    packed = shards.select("hashes", "forward").mapInArrow(each, "bucket int, n int, pairs binary")
    return _collected(shards.sparkSession, packed.groupBy("bucket").applyInArrow(merged, "cell bigint, bits bigint"), slots)


def _summed(shards: DataFrame, n: int, least: int, passed: list, likely=None) -> DataFrame:
    """(h1..hn, a) of all phrases of n words with at least `least` occurrences; `passed` holds the bitmaps of shorter ones.

    `likely`, if given, is a bitmap of all phrases of n words that can be among them.
    """
    names = [f"h{k}" for k in range(1, n + 1)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.concatenate(([0], batch.column(0)[i].values.to_numpy()))
                kind = np.uint16 if len(hashes) - 1 < 65535 else np.uint32
                sides = [np.frombuffer(c[i].as_buffer(), kind) for c in batch.columns[1:]]
                found = WordIndex(*(sides * 2)[:2], len(hashes))  # extension to the right comes with four words only
                at = found.single()
                for k in range(1, n):
                    bits = passed[k - 1].value
                    at = at.where(_in(bits, hashes, at.symbols))
                    at = found.right(at) if k == 3 else found.left(at)
                    part = at.symbols[:, 1:] if k == 3 else at.symbols[:, :-1]  # the other part was held to the bitmap before
                    at = at.where(_in(bits, hashes, part))
                if likely is not None:
                    at = at.where(_in(likely.value, hashes, at.symbols))
                columns = [pa.array(hashes[at.symbols[:, k]]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at.count)], [*names, "a"])
            pa.default_memory_pool().release_unused()

    sides = ["forward", "reverse"] if n > 3 else ["forward"]
    counted = shards.select("hashes", *sides).mapInArrow(each, ", ".join(f"{c} bigint" for c in [*names, "a"]))
    return durable(counted.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def _strings(shards: DataFrame, used: DataFrame, slots: int) -> DataFrame:
    """(h, word) of the hashes in `used` (h1), and of a few others."""
    bitmap = _bitmap(shards.sparkSession, used, 1, slots)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # at most the words asked for, and those that share their slots
        for batch in batches:
            for i in range(batch.num_rows):
                hashed = batch.column(0)[i].values.to_numpy()
                at = np.flatnonzero(_in(bitmap.value, hashed, np.arange(len(hashed))[:, None]))
                at = np.array([k for k in at if int(hashed[k]) not in seen], np.int64)
                seen.update(map(int, hashed[at]))
                yield pa.RecordBatch.from_arrays([c[i].values.take(pa.array(at)) for c in batch.columns], ["h", "word"])

    return shards.select("hashes", "words").mapInArrow(each, "h bigint, word string").distinct()


def counted(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS,
            slots: int = SLOTS):
    """(shards, sizes(lang, n), words(h1, lang, a), [phrases of 2, 3, 4 words (h1.., a)]), all counts over the corpus."""
    spark, texts = docs.sparkSession, _texts(docs, text_col, lang_col)
    for seed in range(SEEDS):
        words = _frequent(texts, seed, least, shard_words)
        if words.where("clash").isEmpty():
            break
    else:
        raise RuntimeError(f"frequent words share a hash with others under each of {SEEDS} seeds")
    passed, tables = [_bitmap(spark, words, 1, slots)], []
    shards = index(texts, f"{shared_folder(spark)}/word-index-{uuid.uuid4().hex}", passed[0], seed, shard_words)
    for n in range(2, LONGEST + 1):
        likely = _likely_pairs(shards, least, passed[0], slots) if n == 2 else None
        tables.append(_summed(shards, n, least, passed, likely))
        if n < LONGEST:
            passed.append(_bitmap(spark, tables[-1], n, slots))
    sizes = shards.select(F.inline("sizes")).groupBy("lang").agg(F.sum("words").alias("n"))
    return shards, sizes, words.drop("clash"), tables


def _renamed(df: DataFrame, prefix: str, first: int) -> DataFrame:
    """Hash columns counted from `first`, all others with a prefix."""
    return df.select(*[F.col(c).alias(f"h{int(c[1:]) + first - 1}") if c[0] == "h" and c[1:].isdigit() else F.col(c).alias(prefix + c)
                       for c in df.columns])


def _cut(k: int, left: str, right: str):
    score = F.expr(f"(2000000 * CAST(a AS DECIMAL(30, 0))) div (CAST({left} AS DECIMAL(20, 0)) + {right})")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, least: int = LEAST, percent: int = 80, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang", shard_words: int = SHARD_WORDS, slots: int = SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at `[.,;:!?\\x0A-\\x0D]`, these into words at spaces and tabs.
    A phrase of at least `least` occurrences scores floor(2000000 * a / (l + r)) at the cut where that is lowest, the
    first such cut on ties; l and r count the two parts. It is left out if a longer phrase around it has at least
    `percent` of its occurrences. Each language shows its first `top` by score, occurrences and phrase.

    A null text is empty; a null language is `und`. Repeated rows count each time. A language without a frequent
    phrase has no rows, an empty table none at all. Other columns are ignored, whatever their names.
    """
    shards, sizes, words, (twos, threes, fours) = counted(docs, least, text_col, lang_col, shard_words, slots)
    first = words.select("h1", "lang", F.col("a").alias("fa"))
    last = words.select(F.col("h1").alias("h2"), F.col("a").alias("fz"))
    two = durable(twos.join(first, "h1").join(last, "h2").select(
        "h1", "h2", "lang", "a", "fa", "fz", F.col("fa").alias("head"), F.col("fz").alias("tail"), F.array(_cut(1, "fa", "fz")).alias("cuts")))
    three = durable(threes.join(_renamed(two, "p_", 1), ["h1", "h2"]).join(_renamed(two, "s_", 2), ["h2", "h3"]).select(
        "h1", "h2", "h3", F.col("p_lang").alias("lang"), "a", F.col("p_fa").alias("fa"), F.col("s_fz").alias("fz"),
        F.col("p_a").alias("head"), F.col("s_a").alias("tail"), F.array(_cut(1, "p_fa", "s_a"), _cut(2, "p_a", "s_fz")).alias("cuts")))
    four = durable(fours.join(_renamed(three, "p_", 1), ["h1", "h2", "h3"]).join(_renamed(three, "s_", 2), ["h2", "h3", "h4"]).select(
        "h1", "h2", "h3", "h4", F.col("p_lang").alias("lang"), "a",
        F.array(_cut(1, "p_fa", "s_a"), _cut(2, "p_head", "s_tail"), _cut(3, "p_a", "s_fz")).alias("cuts")))

    def maximal(shorter: DataFrame, longer: DataFrame, n: int) -> DataFrame:
        """Without the phrases that a phrase of one more word covers; one of still more words is never more frequent."""
        names = [f"h{k}" for k in range(1, n + 1)]
        parts = longer.select(*names, "a").union(longer.select(*[F.col(f"h{k + 1}").alias(f"h{k}") for k in range(1, n + 1)], "a"))
        around = parts.groupBy(*names).agg(F.max("a").alias("most"))
        covered = F.col("most").isNotNull() & (F.lit(100) * F.col("most") >= F.lit(percent) * F.col("a"))
        return shorter.join(around, names, "left").where(~covered)

    def ready(phrases: DataFrame, n: int) -> DataFrame:
        return phrases.select("lang", "a", F.array_min("cuts").alias("cut"), *[(F.col(f"h{k}") if k <= n else F.lit(None).cast("long")).alias(f"h{k}")
                                                                               for k in range(1, LONGEST + 1)])

    kept = ready(maximal(two, three, 2), 2).union(ready(maximal(three, four, 3), 3)).union(ready(four, LONGEST))
    # words are fetched for the best phrases and those level with the last of them only
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    ranked = durable(kept.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top))
    hashes = [f"h{k}" for k in range(1, LONGEST + 1)]
    strings = _strings(shards, ranked.select(F.explode(F.array(*hashes)).alias("h1")).where("h1 is not null"), slots)
    for h in hashes:
        ranked = ranked.join(strings.select(F.col("h").alias(h), F.col("word").alias("w" + h)), h, "left")
    named = ranked.withColumn("phrase", F.concat_ws(" ", *["w" + h for h in hashes]))
    final = named.withColumn("rank", F.row_number().over(best.orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return final.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").cast("long").alias("score"))
