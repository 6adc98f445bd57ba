"""String functions as Spark columns. Offsets are code points, 0-based, half-open."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.vocab import DRUG_ALIASES

# Unicode white space, a superset of Java's (?U)\s; regex word characters; decimal digits.
WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LETTERISH = r"[\p{L}\p{Nl}\p{No}_]"


def let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable, so that inner lambdas do not evaluate it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space (`BLANKS`, the characters of `WS`) at both ends; only the ends are looked at, as no pattern would."""
    return F.btrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def normalize(c: Column) -> Column:
    """Matching form: NFC, lower case, punctuation to spaces, single spaces."""
    return fold_punctuation(nfc(c))


def fold_punctuation(c: Column) -> Column:
    """`normalize` for text that is already NFC; stays inside the JVM."""
    # plain spaces are left alone, so only real punctuation costs a replacement
    spaced = F.regexp_replace(F.lower(c), r"(?:[^\p{L}\p{N}_À-ỹ ]|\x{1680})+", " ")
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def match_key(c: Column) -> Column:
    """Dictionary key: stripped, lower case, single spaces; punctuation kept."""
    return collapse(F.lower(strip(c)))


def vote_key(c: Column) -> Column:
    return F.lower(strip(c))


def tokens(normed: Column) -> Column:
    """Retrieval tokens of a normalised string: digits and letters are split apart."""
    after = F.regexp_replace(normed, rf"(\p{{Nd}})({_LETTERISH})", "$1 $2")
    parts = F.split(F.regexp_replace(after, rf"({_LETTERISH})(\p{{Nd}})", "$1 $2"), " ", -1)
    return F.filter(parts, lambda t: t != "")


def expand_aliases(normed: Column, aliases: dict[str, str] = DRUG_ALIASES) -> Column:
    """Replace each known abbreviation token of a normalised mention by its full name."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.array_join(
        F.transform(F.split(normed, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def is_bullet(line: Column) -> Column:
    return line.rlike(r"^[ \t]*[-–—•][ \t]*")


def clean_title(c: Column) -> Column:
    body = F.regexp_replace(strip(c), rf"^\p{{Nd}}+[.)]{WS}*", "")
    return strip(F.regexp_replace(strip(body), ":+$", ""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"), F.lit(1))


def shingles(c: Column, k: int = 8) -> Column:
    """Distinct word k-grams of the lower-cased text; empty below k words."""
    return let(words(c), lambda w: F.when(
        F.size(w) >= k,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)),
                                     lambda i: F.array_join(F.slice(w, i, k), " "))),
    ).otherwise(F.array().cast("array<string>")))


def shingle_hashes(c: Column, k: int = 8) -> Column:
    """64-bit hashes of the distinct word k-grams of the lower-cased text, without a string for each gram."""
    return let(words(c), lambda w: F.when(
        F.size(w) >= k,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))),
    ).otherwise(F.array().cast("array<bigint>")))


def clean_span(text, start: Column, end: Column) -> tuple[Column, Column]:
    """Shrink a span over white space at both ends; an all-blank span becomes empty. `text` answers `slice`."""
    piece = text.slice(start, end)
    left = F.length(F.regexp_extract(piece, f"^{WS}+", 0))
    right = F.length(F.regexp_extract(piece, f"{WS}+$", 0))
    return start + left, F.greatest(end - right, start + left)


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+", -1), lambda t: t != "")


def word_edit_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over words: every distinct word of the pair becomes one code point."""

    def encode(ws: Column, vocabulary: Column) -> Column:
        code = lambda w: F.lit(0x4E00) + F.array_position(vocabulary, w)
        # code points step over the surrogate range, so that any vocabulary size works
        safe = lambda n: F.when(n >= 0xD800, n + 0x800).otherwise(n)
        hexed = F.transform(ws, lambda w: F.lpad(F.hex(safe(code(w))), 8, "0"))
        return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-32")

    return let(F.array_distinct(F.concat(ref, hyp)),
               lambda v: F.levenshtein(encode(ref, v), encode(hyp, v)))
