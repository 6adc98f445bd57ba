"""Secrets in texts, also behind layers of encoding.

A worklist per text starts with the text itself. Each layer is scanned; its encoded runs (percent
codes, backslash-u codes, base64, also between slashes, dashes or the like, and compressed data inside base64) are unwrapped in place, which gives
the next layer, until nothing is left to unwrap or a layer comes back (a cycle). Each step keeps the way
back from places inside to places outside, so a find in any layer gets a span of the text.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import re
import urllib.parse
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_CODE = re.compile(r"\\u([0-9A-Fa-f]{4})")
_GLUE = re.compile(r"[+/_-]")
LEAST = 16
"""Characters of the shortest base64 run, or part of one, that is unwrapped."""

Span = tuple[int, int, str]


def scan(text: str) -> list[Span]:
    """(start, end, kind) of the secrets in plain sight; per kind leftmost and without overlap."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _readable(raw: bytes) -> str | None:
    """The text in unwrapped bytes, decompressed if need be; null if it is empty or no UTF-8. Any character may occur in it."""
    for magic, unpack in ((b"\x1f\x8b", gzip.decompress), (b"\x78", zlib.decompress)):
        if raw.startswith(magic):
            try:
                raw = unpack(raw)
            except (OSError, EOFError, zlib.error):
                pass
            break
    try:
        return raw.decode("utf-8") or None
    except UnicodeDecodeError:
        return None


def _standard(run: str) -> str:
    return run.rstrip("=").replace("-", "+").replace("_", "/")


def _bytes(body: str) -> bytes:
    """Bytes of base64 without padding, less the last character if it makes no byte."""
    body = body[:-1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _from_base64(run: str) -> str | None:
    body = _standard(run)
    if len(body) % 4 == 1:
        return None
    try:
        return _readable(base64.b64decode(body + "=" * (-len(body) % 4), validate=True))
    except (binascii.Error, ValueError):
        return None


def _packed_end(body: str, start: int) -> int | None:
    """Bytes of the compressed data that base64 begins with at `start`; null if it is none or not whole."""
    for wbits, magic in ((31, b"\x1f\x8b"), (15, b"\x78")):
        if _bytes(body[start:start + 4]).startswith(magic):
            unpack, used = zlib.decompressobj(wbits), 0
            try:
                for low in range(start, len(body), 4096):
                    raw = _bytes(body[low:low + 4096])
                    unpack.decompress(raw)
                    used += len(raw)
                    if unpack.eof:
                        return used - len(unpack.unused_data)
            except zlib.error:
                pass
    return None


def _text_end(body: str, start: int) -> int:
    """Bytes of text (UTF-8) that base64 begins with at `start`."""
    size = 64
    while True:
        raw = _bytes(body[start:start + size])
        try:
            good = len(raw.decode("utf-8").encode())
        except UnicodeDecodeError as error:
            good = error.start
        if good < len(raw) - 3 or start + size >= len(body):
            return good
        size *= 4


def _parts(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, inner text) of the parts of a run that decode, from one of `+/_-` to another, leftmost and longest first.

    Text never begins with one of them, as no UTF-8 does; it may hold and end with them.
    """
    body = _standard(run)
    glue = [m.start() for m in _GLUE.finditer(body)]
    ends = sorted({*glue, *(g + 1 for g in glue), len(body)})
    at = 0
    for start in (0, *(g + 1 for g in glue)):
        if start < at or len(body) - start < LEAST:
            continue
        packed = _packed_end(body, start)
        if packed is not None:
            some = ends[bisect_left(ends, start + -(-packed * 4 // 3)):][:1]
        else:
            good = _text_end(body, start)
            some = ends[bisect_left(ends, start + LEAST):bisect_right(ends, start + (good * 8 + 7) // 6)][::-1]
        for end in some:
            inner = _from_base64(body[start:end])
            if inner is None:
                continue
            if end < len(body) and body[end - 1] in "+/" and end - 1 - start >= LEAST:  # glue, if all ends well without it
                shorter = _from_base64(body[start:end - 1])
                if shorter is not None and base64.b64encode(_bytes(body[start:end - 1])).decode().rstrip("=") == body[start:end - 1]:
                    inner, end = shorter, end - 1
            at = len(run) if end == len(body) else end
            yield start, at, inner
            break


def _base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    for m in BASE64.finditer(text):
        inner = _from_base64(m[0])
        if inner is not None:
            yield m.start(), m.end(), inner
        elif _GLUE.search(m[0]):
            yield from ((m.start() + start, m.start() + end, part) for start, end, part in _parts(m[0]))


def _from_percent(run: str) -> str | None:
    try:
        return urllib.parse.unquote(run, errors="strict")
    except UnicodeDecodeError:
        return None


def _from_escapes(run: str) -> str:
    text = _CODE.sub(lambda m: chr(int(m[1], 16)), run)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def encoded_runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, inner text) of the encoded runs of a layer, leftmost first and without overlap."""
    runs = list(_base64_runs(text))
    if "%" in text:
        runs += [(m.start(), m.end(), _from_percent(m[0])) for m in PERCENT.finditer(text)]
    if "\\u" in text:
        runs += [(m.start(), m.end(), _from_escapes(m[0])) for m in ESCAPED.finditer(text)]
    out, at = [], 0
    for start, end, inner in sorted(r for r in runs if r[2] is not None):
        if start >= at:
            out.append((start, end, inner))
            at = end
    return out


class _Step:
    """One unwrapping of a layer: the layer within, and the way back of its spans."""

    def __init__(self, text: str, runs: list[tuple[int, int, str]]) -> None:
        parts, self.inner, self.outer, at, size = [], [], [], 0, 0
        for start, end, inner in runs:
            parts += [text[at:start], inner]
            size += start - at
            self.inner.append((size, size + len(inner)))
            self.outer.append((start, end))
            size += len(inner)
            at = end
        self.text = "".join([*parts, text[at:]])
        self.starts = [s for s, _ in self.inner]

    def _back(self, at: int) -> tuple[int, int]:
        """The span outside of the character at a place inside."""
        k = bisect_right(self.starts, at) - 1
        while k >= 0 and self.inner[k][0] == self.inner[k][1]:  # a run that was empty inside
            k -= 1
        if k >= 0 and at < self.inner[k][1]:
            return self.outer[k]
        k = bisect_right(self.starts, at) - 1
        place = at if k < 0 else self.outer[k][1] + at - self.inner[k][1]
        return place, place + 1

    def outside(self, start: int, end: int) -> tuple[int, int]:
        return self._back(start)[0], self._back(end - 1)[1]


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """(spans in plain sight, all spans) of a text; what an encoded run hides has the span of that run."""
    if not text:
        return [], []
    base = scan(text)
    spans, steps, layer, seen = set(base), [], text, {text}
    while runs := encoded_runs(layer):
        steps.append(_Step(layer, runs))
        layer = steps[-1].text
        if layer in seen:  # a cycle
            break
        seen.add(layer)
        for start, end, kind in scan(layer):
            for step in reversed(steps):
                start, end = step.outside(start, end)
            spans.add((start, end, kind))
    order = {k: n for n, k in enumerate(KINDS)}
    key = lambda s: (s[0], order[s[2]], s[1])
    return sorted(base, key=key), sorted(spans, key=key)


def secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a column `secrets`: struct of arrays `base` and `spans` of (start, end, kind).

    Offsets are code points, ends exclusive, sorted by start, then kind, then end. Null and empty texts have none.
    Texts are scanned whole. Rows are independent; the other columns stay (one named `secrets` is replaced).
    """
    span = "array<struct<start:bigint,end:bigint,kind:string>>"
    kept = [f for f in docs.columns if f != "secrets"]
    item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    schema = docs.select(*[docs[c] for c in kept]).withColumn("secrets", F.lit(None).cast(f"struct<base:{span},spans:{span}>")).schema
    at = kept.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t.as_py()) for t in batch.column(at)]
            both = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in row[k]] for row in found], item) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(both, ["base", "spans"])], [*kept, "secrets"])

    return docs.select(*kept).mapInArrow(each, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret span replaced by `mark`; overlapping spans become one mark. Null texts stay null."""
    def masked(text: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at)]
            clean = pa.array([masked(t, find_secrets(t)[1]) if t else t for t in texts], batch.column(at).type)
            yield batch.set_column(at, batch.schema.field(at), clean)

    return docs.mapInArrow(each, docs.schema)
