"""Lists of tuples per text as Arrow arrays, a bounded number of characters at a time.

An Arrow batch holds up to 10,000 texts. As Python objects the tokens of all of them take gigabytes, so only the tuples
of one chunk exist at once; what is kept of a chunk is its Arrow array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
"""Characters of texts taken together; a longer text is a chunk of its own."""


def _chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    chunk, size = [], 0
    for value in texts:
        text = value.as_py()
        if chunk and size + len(text or "") > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text or "")
    if chunk:
        yield chunk


def _nested(rows: list[list[tuple] | None], fields: list[pa.Field]) -> pa.Array:
    columns = zip(*chain.from_iterable(r for r in rows if r))
    arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)] or [pa.array([], f.type) for f in fields]
    ends = [0, *accumulate(len(r or ()) for r in rows)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=fields),
                                    mask=pa.array([r is None for r in rows], pa.bool_()))


def lists_of_tuples(texts: pa.Array, fn: Callable[[list[str]], list[list[tuple]]], fields: list[pa.Field]) -> pa.Array:
    """array<struct<fields>> of every text; `fn` gets the texts of a chunk and is not asked for null texts."""
    parts = []
    for chunk in _chunks(texts):
        found = iter(fn([t for t in chunk if t is not None]))
        parts.append(_nested([None if t is None else next(found) for t in chunk], fields))
    return pa.concat_arrays(parts) if parts else _nested([], fields)


@lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    """For every code point whether the regular expression `[^\\W_]` matches it."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _runs(texts: pa.Array, min_len: int, fields: list[pa.Field]) -> pa.Array:
    valid = pc.fill_null(texts, "")
    bounds = np.concatenate(([0], np.cumsum(pc.binary_length(valid).to_numpy(zero_copy_only=False)))).astype(np.int64)
    raw = "".join(valid.to_pylist()).encode()
    data = np.frombuffer(raw, np.uint8)
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of every code point, and the end
    inside = _alphanumeric()[np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")]
    rows = np.searchsorted(first, bounds)  # the first code point of every text, and the end
    begins = np.zeros(len(inside) + 1, bool)
    begins[rows] = True
    before, after = np.concatenate(([False], inside[:-1])), np.append(inside[1:], False)
    start = np.flatnonzero(inside & ~(before & ~begins[:-1]))
    end = np.flatnonzero(inside & ~(after & ~begins[1:])) + 1
    long = end - start >= min_len
    start, end = start[long], end[long]
    row = np.searchsorted(rows, start, "right") - 1
    edges = np.zeros(len(data) + 1, np.int8)
    edges[first[start]] += 1
    edges[first[end]] -= 1
    kept = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    ends = np.concatenate(([0], np.cumsum(first[end] - first[start]))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept)))
    places = [pa.array((at - rows[row]).astype(np.int32)) for at in (start, end)]
    lists = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([*places, words], fields=fields), mask=pc.is_null(texts))


def words_of(texts: pa.Array, min_len: int, fields: list[pa.Field]) -> pa.Array:
    """array<struct<fields>> (start, end, text) of the runs of letters and digits with at least `min_len` code points.

    All texts of a chunk are looked at together, so a word costs no Python object.
    """
    texts, parts, low = texts.cast(pa.string()), [], 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK, "right")))
        parts.append(_runs(texts.slice(low, high - low), min_len, fields))
        low = high
    return pa.concat_arrays(parts) if parts else _runs(texts, min_len, fields)
