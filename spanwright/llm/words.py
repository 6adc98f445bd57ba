"""Words and word hashes of whole Arrow string columns, as numpy arrays.

A helper of the operators that run inside Spark tasks: texts come in as the UTF-8 buffer of a
column, words are found by byte tables and hashed without a Python step per word. Texts are
taken in groups of bounded size, a long text in pieces cut between words, so memory follows the
piece, not the text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
"""Texts are hashed in groups of about this many bytes."""

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
"""Separators of the words `[^\\x20\\x09-\\x0D]+`."""

NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
"""Separators that leave runs of ASCII letters, digits and all non-ASCII characters."""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = U64(0x9E3779B97F4A7C15)
_MULTIPLIER = 0xD1342543DE82EF95


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (a bijection)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix((np.arange(256, dtype=U64) + U64(1)) * _STEP)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _grow(n: int) -> None:
    """Powers of the multiplier, and of its inverse, up to n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, GROUP_BYTES + 1)
        for base, name in ((_MULTIPLIER, "_powers"), (pow(_MULTIPLIER, -1, 1 << 64), "_inverses")):
            steps = np.full(size, base, U64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row bounds) of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def groups(bounds: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes, one row at least."""
    low, n = 0, len(bounds) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, high
        low = high


def spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; no word crosses a row bound."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = separators[data]
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    before = np.concatenate(([True], gap[:-1]))
    before[filled] = True
    after = np.concatenate((gap[1:], [True]))
    after[filled[1:] - 1] = True
    return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(U64) * _STEP)


def word_hashes(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = WHITE,
                lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, 64-bit hash of each word) for a group of rows, in text order."""
    if len(data) <= 2 * GROUP_BYTES:
        starts, ends = spans(data, bounds, separators)
        rows = np.searchsorted(bounds, starts, "right") - 1
        return rows, _hashed(LOWER[data] if lower else data, starts, ends)
    rows, found = [], []
    for row in range(len(bounds) - 1):
        for piece in pieces(data[bounds[row]:bounds[row + 1]], separators):
            starts, ends = spans(piece, np.array([0, len(piece)]), separators)
            found.append(_hashed(LOWER[piece] if lower else piece, starts, ends))
            rows.append(np.full(len(starts), row))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, U64))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all `width`-word windows of one text; fewer words are one window, none are none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U64)
    span = min(width, n)
    out = np.full(n - span + 1, U64(span)) * _STEP
    for k in range(span):
        out = mix(out * U64(0xA0761D6478BD642F) + words[k:n - span + 1 + k])
    return out


def row_slices(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's words, given the row of each word in order."""
    return np.searchsorted(rows, np.arange(n + 1))


def word_parts(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, prefixes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of each word and of its beginnings of so many bytes (of longer words only), a part of the group at a time."""
    def parts(raw: np.ndarray, cuts: np.ndarray, row0: int) -> tuple[np.ndarray, np.ndarray]:
        raw = LOWER[raw]
        starts, ends = spans(raw, cuts, separators)
        rows = np.searchsorted(cuts, starts, "right") - 1 + row0
        all_rows, found = [rows], [_hashed(raw, starts, ends)]
        for n in prefixes:
            longer = ends - starts > n
            all_rows.append(rows[longer])
            found.append(mix(_hashed(raw, starts[longer], starts[longer] + n)))
        return np.concatenate(all_rows), np.concatenate(found)

    if len(data) <= 2 * GROUP_BYTES:
        yield parts(data, bounds, 0)
        return
    for row in range(len(bounds) - 1):
        for piece in pieces(data[bounds[row]:bounds[row + 1]], separators):
            yield parts(piece, np.array([0, len(piece)]), row)


def pieces(text: np.ndarray, separators: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about GROUP_BYTES, cut before separators; a longer word stays whole."""
    low = 0
    while low < len(text):
        high = min(len(text), low + GROUP_BYTES)
        while high < len(text):
            stop = np.flatnonzero(separators[text[high:high + GROUP_BYTES]])
            high = high + int(stop[0]) if len(stop) else min(len(text), high + GROUP_BYTES)
            if len(stop):
                break
        yield text[low:high]
        low = high
