"""Texts with random access: a text cut into pieces once, with the line breaks around each piece.

`substring` on a string walks from its first character, so one slice per mention makes a document cost mentions x
length. Here a document is cut once; a slice then reads the pieces it touches, and the line around a place is found in
its own piece or by two numbers kept per piece. Cutting and the running numbers are linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import let

SHIFT = 10
PIECE = 1 << SHIFT
"""Code points of a piece."""
GROUP = 64
"""Pieces per group of the running numbers."""
PARTS = ("_size", "_pieces", "_above", "_below")


def _piece(at: Column) -> Column:
    return F.shiftright(at, SHIFT).cast("int")


class Text:
    """A plain string column."""

    def __init__(self, column: Column) -> None:
        self.column = column

    def length(self) -> Column:
        return F.length(self.column)

    def slice(self, start: Column, end: Column) -> Column:
        return F.substring(self.column, start + 1, end - start)

    def line_start(self, at: Column) -> Column:
        return at - F.length(F.substring_index(self.slice(F.lit(0), at), "\n", -1))

    def line_end(self, at: Column) -> Column:
        return at + F.length(F.substring_index(self.slice(at, self.length()), "\n", 1))


class ShortText(Text):
    """A string column of at most `PIECE` code points, read by plain string functions only.

    Lambdas are interpreted, a few microseconds each; a slice of a short text costs less than binding it to one.
    """

    def line_start(self, at: Column) -> Column:
        return F.greatest(at, F.lit(0)) - F.length(self.line_before(at))

    def line_end(self, at: Column) -> Column:
        return at + F.length(self.line_after(at))

    def line_before(self, at: Column) -> Column:
        """What stands on the line in front of a place."""
        return F.substring_index(F.substring(self.column, F.lit(1), at), "\n", -1)

    def line_after(self, at: Column) -> Column:
        return F.substring_index(F.substring(self.column, at + 1, F.lit(PIECE)), "\n", 1)


class PiecedText(Text):
    """The columns that `cut` made: the work of a slice or line depends on its length only."""

    def __init__(self, size: Column, pieces: Column, above: Column, below: Column) -> None:
        self.size, self.pieces, self.above, self.below = size, pieces, above, below

    def length(self) -> Column:
        return self.size

    def slice(self, start: Column, end: Column) -> Column:
        first = _piece(F.greatest(start, F.lit(0)))
        last = F.greatest(_piece(end - 1), first)
        return let(first, lambda k: F.substring(
            F.array_join(F.slice(self.pieces, k + 1, last - k + 1), ""), start - k * PIECE + 1, end - start))

    def line_start(self, at: Column) -> Column:
        piece = _piece(at)
        inside = F.substring(F.get(self.pieces, piece), F.lit(1), at - piece * PIECE)
        return let(inside, lambda s: F.when(F.contains(s, F.lit("\n")), at - F.length(F.substring_index(s, "\n", -1)))
                   .otherwise(F.coalesce(F.get(self.above, piece), F.get(self.above, F.size(self.above) - 1))))

    def line_end(self, at: Column) -> Column:
        piece = _piece(at)
        inside = F.substring(F.get(self.pieces, piece), at - piece * PIECE + 1, F.lit(PIECE))
        return let(inside, lambda s: F.when(F.contains(s, F.lit("\n")), at + F.length(F.substring_index(s, "\n", 1)))
                   .otherwise(F.coalesce(F.get(self.below, piece + 1), self.size)))


def as_text(text: Column | Text) -> Text:
    return text if isinstance(text, Text) else Text(text)


def _running(values: Column, start: Column, pick: Callable[..., Column], best: Callable[[Column], Column]) -> Column:
    """[start, pick(start, v0), pick(start, v0, v1), ...]; nulls are passed over.

    An array grows by copying, so it is grown within groups and from group to group, never piece by piece over the whole text.
    """
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / GROUP).cast("int")),
                         lambda g: F.slice(values, g * GROUP + 1, F.lit(GROUP)))

    def grow(items: Column, first: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, F.array(first), lambda kept, x: F.concat(
            kept, F.array(pick(F.element_at(kept, -1), value(x)))))

    def joined(parts: Column, heads: Column) -> Column:
        within = F.transform(parts, lambda part, n: F.slice(grow(part, F.get(heads, n), lambda x: x), F.lit(1), F.size(part)))
        return F.concat(F.flatten(within), F.array(F.element_at(heads, -1)))

    return let(groups, lambda parts: let(grow(parts, start, best), lambda heads: joined(parts, heads)))


def cut(docs: DataFrame, text_col: str = "text", kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, _size, _pieces, _above, _below): texts ready for `PiecedText`; null texts give nulls.

    `_above[i]` is the start of the line in force where piece i begins, `_below[i]` the first line break from there on
    (the length of the text if there is none); both have one entry more than there are pieces.
    """
    text = F.col(text_col)
    one = F.length(text).between(1, PIECE)  # a short text is its only piece and needs no running numbers
    pieced = docs.select("doc_id", *kept, F.length(text).alias("_size"), F.when(one, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_pieces"))
    broken = lambda x: F.contains(x, F.lit("\n"))
    last = F.transform("_pieces", lambda x, i: F.when(broken(x), i * PIECE + F.length(x) - F.length(F.substring_index(x, "\n", -1))))
    first = F.transform("_pieces", lambda x, i: F.when(broken(x), i * PIECE + F.length(F.substring_index(x, "\n", 1))))
    above = _running(last, F.lit(0), F.greatest, F.array_max)
    below = F.reverse(_running(F.reverse(first), F.col("_size"), F.least, F.array_min))
    only = F.get("_pieces", F.lit(0))
    one = F.col("_size").between(1, PIECE)
    single_above = F.array(F.lit(0), F.when(broken(only), F.col("_size") - F.length(F.substring_index(only, "\n", -1))).otherwise(0))
    single_below = F.array(F.length(F.substring_index(only, "\n", 1)), F.col("_size"))
    return pieced.select("doc_id", *kept, "_size", "_pieces", F.when(one, single_above).otherwise(above).alias("_above"),
                         F.when(one, single_below).otherwise(below).alias("_below"))


def pieced() -> PiecedText:
    return PiecedText(*[F.col(c) for c in PARTS])
