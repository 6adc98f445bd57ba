"""Token counts of the parts of a document, by the offsets of one encoding of the whole.

A text is encoded once, as a whole. Every token has the span of characters that it stands for; the spans are
joined with the sections by interval. A token that crosses a section's end goes where the rule says:
`start` gives it to the section of its first character, `most` to the section with most of its characters (the first of
equals), `split` divides it by characters. Counts over sections therefore add up to the document's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.bpe import encoder, token_bytes

RULES = ("start", "most", "split")
OUTSIDE = "outside"


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first characters, ends) of the tokens of a text, in code points; a character cut by tokens is in each of them."""
    ids = encoder(path, pattern).encode_to_numpy(text, disallowed_special=())
    sizes = np.diff(token_bytes(path, pattern)[1])[ids]
    ends = np.cumsum(sizes)
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before each byte
    starts = ends - sizes
    return ids, chars[starts + 1] - 1 if len(ids) else chars[:0], chars[ends] if len(ids) else chars[:0]


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """Title (the first line that is not blank), table (lines with a bar) and body; runs of lines of one name are one section."""
    out: list[tuple[str, int, int]] = []
    at, titled = 0, False
    for line in text.split("\n"):
        end = min(len(text), at + len(line) + 1)
        name = "table" if "|" in line else "body"
        if not titled and line.strip():
            name, titled = "title", True
        if end > at:
            if out and out[-1][0] == name:
                out[-1] = (name, out[-1][1], end)
            else:
                out.append((name, at, end))
        at = end
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[str, int, int]], rule: str) -> list[tuple[str, float, int]]:
    """(section, tokens, tokens that cross its end) for each section in order, and what is outside of all if there is any.

    Sections are (name, start, end), sorted and without overlap.
    """
    lows = np.array([s for _, s, _ in sections], np.int64)
    highs = np.array([e for _, _, e in sections], np.int64)
    at = np.searchsorted(lows, starts, "right") - 1
    inside = (at >= 0) & (starts < highs[at]) if len(sections) else np.zeros(len(starts), bool)
    at = np.where(inside, at, len(sections))
    limit = np.where(inside, np.append(highs, 0)[at], np.append(lows, np.iinfo(np.int64).max)[np.searchsorted(lows, starts, "left")])
    crossing = ends > limit
    totals = np.bincount(at if rule == "start" else at[~crossing], minlength=len(sections) + 1).astype(float)
    crossed = np.bincount(at[crossing], minlength=len(sections) + 1)
    if rule != "start":
        for a, b in zip(starts[crossing].tolist(), ends[crossing].tolist(), strict=True):
            first = max(0, int(np.searchsorted(highs, a, "right")))
            shares, left = [], b - a
            for k in range(first, len(sections)):
                if lows[k] >= b:
                    break
                shares.append((k, int(min(b, highs[k]) - max(a, lows[k]))))
                left -= shares[-1][1]
            if left:
                shares.append((len(sections), left))
            if rule == "most":
                totals[max(shares, key=lambda s: s[1])[0]] += 1
            else:
                for k, n in shares:
                    totals[k] += n / (b - a)
    rows = [(name, float(totals[k]), int(crossed[k])) for k, (name, _, _) in enumerate(sections)]
    return rows + ([(OUTSIDE, float(totals[-1]), int(crossed[-1]))] if totals[-1] or crossed[-1] else [])


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "start", sections_col: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, section, n_sections, n_tokens, n_crossing) for each row of `docs` and name of its sections.

    Sections come from `sections_col`, an array of (name, start, end) in code points, sorted and without overlap, or
    else from `line_sections`. n_tokens is a double (whole but for the rule `split`). Tokens outside of all sections count under
    the name `outside`. A null or empty text has one row: section null, no tokens. Repeated rows count each; other
    columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id_col].dataType.simpleString()
    given = [F.col(sections_col).alias("sections")] if sections_col else []
    names = ["id", "section", "n_sections", "n_tokens", "n_crossing"]

    def rows_of(text: str | None, given_sections: list[dict] | None) -> list[tuple]:
        if not text:
            return [(None, 0, 0.0, 0)]
        sections = [(s["name"], s["start"], s["end"]) for s in given_sections or []] if sections_col else line_sections(text)
        _, starts, ends = token_spans(text, path, pattern)
        merged: dict[str, list] = {}
        for name, tokens, crossing in attribute(starts, ends, sections, rule):
            row = merged.setdefault(name, [0, 0.0, 0])
            row[0] += 1
            row[1] += tokens
            row[2] += crossing
        return [(name, *row) for name, row in merged.items()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, out = [], []
            for k in range(batch.num_rows):
                found = rows_of(batch.column(1)[k].as_py(), batch.column(2)[k].as_py() if sections_col else None)
                owners += [k] * len(found)
                out += found
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())], names)

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *given)
            .mapInArrow(each, f"id {kind}, section string, n_sections long, n_tokens double, n_crossing long").withColumnRenamed("id", id_col))
