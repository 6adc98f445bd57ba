"""Benchmark passages in documents by SimHash of item-sized windows.

The items give fingerprints of windows of their own size class (the longest class length that
fits into the item). Every document position starts a window of each such length; its
fingerprint is the majority of the word-hash bits, kept up to date by prefix sums. 64 bits are
cut into `RADIUS + 1` blocks: two fingerprints within `RADIUS` bits agree in one block at least, so a
table lookup per block finds all of them. Each find names an item and an aligned region of
the document, whose shingles are then compared with the item's; a shingle weighs as much as its words are long.

An edited word in the middle of an item lies in all of its windows and can move all fingerprints out of the
radius. So the rarest shingles of each item are looked up as well, as many as weigh more than a similar region
may lack: a region at `SIMILARITY` holds one of them at least, and all regions around such a find are weighed.

Documents are never shuffled: the index of at most `ITEMS_PER_PASS` items travels to the tasks, and a
larger benchmark is taken in several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.words import NOT_WORD, U64, groups, row_slices, shingles, spans, utf8, word_hashes

RADIUS = 3
SHINGLE = 5
SIMILARITY = 0.8
ITEMS_PER_PASS = 20_000
CHUNK = 16_384
"""Words whose windows are fingerprinted at once."""

_BLOCKS = RADIUS + 1
_BLOCK = np.dtype(f"<u{8 // _BLOCKS}")


def size_class(n: int) -> int:
    """The longest window length that fits n words: 1 to 8, then each half as long again."""
    length = min(n, 8)
    while length * 3 // 2 <= n and length >= 8:
        length = length * 3 // 2
    return length


def fingerprints(words: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(length, position of the first, fingerprints) of all windows of the lengths, in chunks."""
    reach = max(lengths, default=1) - 1
    for low in range(0, len(words), CHUNK):
        part = words[low:low + CHUNK + reach]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8)).reshape(-1, 64)
        sums = np.zeros((len(part) + 1, 64), np.uint16)  # wraps around, differences stay right
        np.cumsum(bits, axis=0, dtype=np.uint16, out=sums[1:])
        for length in lengths:
            n = min(CHUNK, len(part) - length + 1)
            if n > 0:
                ones = sums[length:length + n] - sums[:n]
                yield length, low, np.packbits(ones > length // 2, axis=1).reshape(-1).view("<u8")


@dataclass
class Index:
    """Fingerprints by window length, the weighted shingles of each item with their first places, and the looked-up shingles."""

    item_ids: list
    n_words: list[int]
    members: list[np.ndarray]
    weights: list[np.ndarray]
    places: list[np.ndarray]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list]]
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]


def build_index(items: list[tuple[object, str | None]]) -> Index:
    """Index of items (id, text). A shingle weighs as many bytes as its words have."""
    ids, counts, members, weights, places = [], [], [], [], []
    found: dict[int, list[tuple[int, int, int]]] = {}
    for item_id, text in items:
        data, bounds = utf8(pa.array([text], pa.string()))
        _, words = word_hashes(data, bounds, NOT_WORD)
        if not len(words):
            continue
        starts, ends = spans(data, bounds, NOT_WORD)
        own, first = np.unique(shingles(words, SHINGLE), return_index=True)
        ids.append(item_id)
        counts.append(len(words))
        members.append(own)
        places.append(first)
        weights.append(np.convolve(ends - starts, np.ones(min(SHINGLE, len(words))), "valid")[first])
        length = size_class(len(words))
        last = len(words) - length
        every = np.concatenate([f for _, _, f in fingerprints(words, [length])])
        at = sorted({0, last, *range(0, last, max(1, length // 2))})
        found.setdefault(length, []).extend((int(every[p]), len(ids) - 1, p) for p in at)
    by_length = {}
    for length, rows in found.items():
        prints = np.array([r[0] for r in rows], U64)
        blocks = []
        for block in prints.astype("<u8").view(_BLOCK).reshape(-1, _BLOCKS).T:
            order = np.argsort(block, kind="stable")
            present = np.zeros(1 << (8 * _BLOCK.itemsize), bool)
            present[block] = True
            blocks.append((present, block[order], order))
        by_length[length] = (prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), blocks)
    return Index(ids, counts, members, weights, places, by_length, _rare(counts, members, weights))


def _rare(counts: list[int], members: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table of their low bits, hashes in order, item of each) of the shingles looked up for items of SHINGLE words or more.

    Per item the shingles in the fewest items, until they weigh more than a region at SIMILARITY may lack. Shorter items
    need none: a copy has the very fingerprint of the item.
    """
    longer = [k for k, n in enumerate(counts) if n >= SHINGLE]
    every, number = np.unique(np.concatenate([members[k] for k in longer] or [np.zeros(0, U64)]), return_counts=True)
    hashes, items = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for k in longer:
        order = np.lexsort((members[k], number[np.searchsorted(every, members[k])]))
        weight = np.cumsum(weights[k][order])
        n = int(np.searchsorted(weight, (1 - SIMILARITY) * weight[-1] + 1e-6, "right")) + 1
        hashes.append(members[k][order[:n]])
        items.append(np.full(len(hashes[-1]), k))
    keys, owners = np.concatenate(hashes), np.concatenate(items)
    order = np.argsort(keys, kind="stable")
    table = np.zeros(1 << max(10, (16 * len(keys)).bit_length()), bool)
    table[(keys & U64(len(table) - 1)).astype(np.int64)] = True
    return table, keys[order], owners[order]


def _near(prints: np.ndarray, entry: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(window, index row) of all pairs of fingerprints within RADIUS bits."""
    known, _, _, blocks = entry
    parts = prints.view(_BLOCK).reshape(-1, _BLOCKS)
    windows, rows = [], []
    for k, (present, ordered, order) in enumerate(blocks):
        at = np.flatnonzero(present[parts[:, k]])
        if not len(at):
            continue
        low = np.searchsorted(ordered, parts[at, k], "left")
        n = np.searchsorted(ordered, parts[at, k], "right") - low
        window = np.repeat(at, n)
        row = order[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        close = np.bitwise_count(prints[window] ^ known[row]) <= RADIUS
        windows.append(window[close])
        rows.append(row[close])
    if not windows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(windows), np.concatenate(rows)


def _similarity(words: np.ndarray, start: int, index: Index, item: int) -> float:
    """Weighted share of the item's shingles in the item-sized region at `start`."""
    region = words[max(0, start):max(0, start + index.n_words[item])]
    inside = np.isin(index.members[item], shingles(region, SHINGLE))
    return float(index.weights[item][inside].sum() / index.weights[item].sum())


def _rare_hits(found: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(position, item) of the looked-up shingles among those of a group of rows."""
    table, keys, owners = index.rare
    at = np.flatnonzero(table[(found & U64(len(table) - 1)).astype(np.int64)])
    low = np.searchsorted(keys, found[at], "left")
    n = np.searchsorted(keys, found[at], "right") - low
    return np.repeat(at, n), owners[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _best_region(found: np.ndarray, start: int, index: Index, item: int) -> tuple[float, int] | None:
    """(similarity, first word) of the best item-sized region among a row's shingles from `start` on, if it is similar.

    Of equal regions, the first that begins with a shingle of the item or has one in its place in the item.
    """
    members, weights = index.members[item], index.weights[item]
    which = np.minimum(np.searchsorted(members, found), len(members) - 1)
    at = np.flatnonzero(members[which] == found)
    which, total = which[at], weights.sum()
    if weights[np.unique(which)].sum() / total < SIMILARITY:
        return None
    reach = index.n_words[item] - SHINGLE
    order = np.argsort(which, kind="stable")
    before = np.full(len(at), -reach - 1)  # the shingle's place before, so that a region counts it once
    again = which[order][1:] == which[order][:-1]
    before[order[1:][again]] = at[order[:-1][again]]
    sums = np.zeros(len(found) + reach + 2)  # weights of the regions from -reach on
    np.add.at(sums, np.maximum(before + 1, at - reach) + reach, weights[which])
    np.subtract.at(sums, at + reach + 1, weights[which])
    sums = np.cumsum(sums)
    first = np.unique(np.concatenate((at, np.maximum(at - index.places[item][which], max(-start, -reach)))))
    best = int(first[np.argmax(sums[first + reach])])
    score = float(sums[best + reach] / total)
    return (score, start + best) if score >= SIMILARITY else None


def leaks(words: np.ndarray, cuts: np.ndarray, index: Index) -> dict[tuple[int, int], tuple[float, int]]:
    """(row, item) -> (similarity, first word) of the passages found in rows of words."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    seen = set()
    for length, low, prints in fingerprints(words, sorted(index.by_length)):
        entry = index.by_length[length]
        window, hit = _near(prints, entry)
        first = window + low
        row = np.searchsorted(cuts, first, "right") - 1
        inside = first + length <= cuts[row + 1]
        for r, f, item, offset in zip(row[inside].tolist(), first[inside].tolist(), entry[1][hit][inside].tolist(),
                                      entry[2][hit][inside].tolist(), strict=True):
            start = f - offset - int(cuts[r])
            if (r, item, start) in seen:
                continue
            seen.add((r, item, start))
            score = _similarity(words[cuts[r]:cuts[r + 1]], start, index, item)
            if score >= SIMILARITY and (-score, max(0, start)) < best.get((r, item), (0.0, 0)):
                best[r, item] = (-score, max(0, start))
    for r, item, start, score in _around_rare(words, cuts, index):
        if (-score, start) < best.get((r, item), (0.0, 0)):
            best[r, item] = (-score, start)
    return {pair: (-score, start) for pair, (score, start) in best.items()}


def _around_rare(words: np.ndarray, cuts: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, float]]:
    """(row, item, first word, similarity) of the best regions around looked-up shingles."""
    if len(words) < SHINGLE:
        return
    found = shingles(words, SHINGLE)
    at, item = _rare_hits(found, index)
    row = np.searchsorted(cuts, at, "right") - 1
    inside = at + SHINGLE <= cuts[row + 1]
    row, item, at = row[inside], item[inside], at[inside]
    if not len(at):
        return
    order = np.lexsort((at, item, row))
    row, item, at = row[order], item[order], at[order]
    reach = np.array(index.n_words, np.int64)[item] - SHINGLE
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0) | (np.diff(at, prepend=-1) > 2 * reach))
    for low, high in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
        r, k = int(row[low]), int(item[low])
        begin = max(int(cuts[r]), int(at[low] - reach[low]))
        end = min(int(cuts[r + 1]) - SHINGLE, int(at[high - 1] + reach[low])) + 1
        best = _best_region(found[begin:end], begin - int(cuts[r]), index, k)
        if best is not None:
            yield r, k, best[1], best[0]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple]]:
    rows = benchmark.select(item_col, text_col).where(F.col(item_col).isNotNull()).toLocalIterator()
    while part := [tuple(r) for r in islice(rows, size)]:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(id_col, item_col, similarity, start_word, n_words) of every benchmark item found in a document.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. An item is found
    when some item-sized region of the document holds shingles of five words with 0.8 or more of the
    weight of the item's shingles; an item of fewer words is one shingle. start_word and n_words give
    the best region. Null or empty texts and items without words match nothing; rows with a null id or
    null item id are passed over. Repeated rows and items count once per pair of ids. Other columns are ignored.
    """
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[1]]
    schema = f"id {kinds[0]}, item {kinds[1]}, similarity double, start_word long, n_words long"
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for items in _passes(benchmark, item_col, item_text, items_per_pass):
        index = build_index(items)
        if not index.item_ids:
            continue

        def each(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = utf8(batch.column(1))
                out = []
                for low, high in groups(bounds):
                    rows, words = word_hashes(data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low], NOT_WORD)
                    hits = leaks(words, row_slices(rows, high - low), index)
                    out += [(low + r, index.item_ids[item], score, start, index.n_words[item])
                            for (r, item), (score, start) in hits.items()]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], item_type),
                     pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                    ["id", "item", "similarity", "start_word", "n_words"])

        part = source.mapInArrow(each, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    best = F.min_by(F.struct("similarity", "start_word", "n_words"), F.struct(-F.col("similarity"), "start_word"))
    return found.groupBy("id", "item").agg(best.alias("best")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "best.*")
