"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bigint with a
bit per failed rule; a policy is a mask over these bits, so any version of the policy, and what
each of its rules costs, follow from the ledger without reading a text again.

Only DataFrame functions are used. Texts are never exploded: words and windows stay arrays of
their row, so the one-row-per-document result needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word pattern, the symbols and the window of the rules.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"

RULES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("few_words", lambda m: m["n_words"] < MIN_WORDS),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 3 * m["word_chars"]),
    ("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 40 * m["n_lines"]),
    ("upper_case", lambda m: 100 * m["n_upper"] > 40 * m["word_chars"]),
    ("stutter", lambda m: 100 * m["n_stutter"] > 20 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 25 * m["n_words"]),
    ("digits", lambda m: 100 * m["n_digits"] > 60 * m["word_chars"]),
)
"""(name, condition of failing over the measurements); the position is the bit."""

BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
POLICIES = {
    "base-1": BIT["few_words"] | BIT["repeated_windows"],
    "full-2": sum(BIT.values()),
}
"""Versioned policies: the mask of the rules that reject."""

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stutter")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _covered(windows: Column, n_words: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(rows: Column) -> Column:
        last = F.size(rows) - 1
        same = F.transform(rows, lambda r, k: F.when(
            (F.get(rows, k - 1)["h"] == r["h"]) | ((k < last) & (F.get(rows, k + 1)["h"] == r["h"])), r["i"]))
        return F.array_sort(F.filter(same, lambda i: i.isNotNull()))

    def length(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), n_words) - i))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    return _let(_let(ordered, starts), length)


def _repeats(words: Column) -> Column:
    """n_repeat_words of an array of words: windows are compared by a hash of their word hashes."""
    def over(hashes: Column) -> Column:
        n = F.size(hashes)
        windows = F.transform(F.sequence(F.lit(0), n - WINDOW),
                              lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        def count(w: Column) -> Column:
            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w, n))
        return F.when(n < WINDOW + 1, F.lit(0)).otherwise(_let(windows, count))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), over)


def _stutters(words: Column) -> Column:
    return _let(words, lambda ws: F.size(F.filter(F.transform(ws, lambda w, k: (k > 0) & (F.get(ws, k - 1) == w)), lambda same: same)))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with one struct column `ledger`: the measurements (bigint) and `failed`, the bits of the failed rules.

    A null text has no words, like an empty one: it fails the word count. Rows are independent, so repeated rows
    get equal ledgers; all columns of `docs` stay as they are (a column named `ledger` is replaced).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    counted = _let(words, lambda ws: F.struct(
        F.size(ws).alias("n_words"), _repeats(ws).alias("n_repeat_words"), _stutters(ws).alias("n_stutter")))
    lined = _let(lines, lambda ls: F.struct(
        F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")))
    parts = F.struct(
        counted.alias("of_words"), lined.alias("of_lines"), F.length(F.translate(text, WHITE, "")).alias("word_chars"),
        _without(text, SYMBOLS).alias("n_symbols"), _without(text, UPPER).alias("n_upper"), _without(text, DIGITS).alias("n_digits"))
    of = {"n_words": "of_words", "n_repeat_words": "of_words", "n_stutter": "of_words", "n_lines": "of_lines", "n_dup_lines": "of_lines"}
    flat = _let(parts, lambda p: F.struct(*[(p[of[m]][m] if m in of else p[m]).cast("long").alias(m) for m in MEASURES]))
    return docs.withColumn("ledger", _let(flat, lambda m: F.struct(*[m[n].alias(n) for n in MEASURES], _bits(m).alias("failed"))))


def _bits(m: Column) -> Column:
    """The failure bits over the measurements `m`."""
    total = F.lit(0).cast("long")
    for name, fails in RULES:
        total = total.bitwiseOR(F.when(fails(m), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return total


def passes(policy: str, failed: Column | str = "ledger.failed") -> Column:
    """True where none of the policy's rules failed."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(ledgers: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_rejected): per policy and rule, documents that fail the rule, that only this
    rule rejects (what dropping it would bring back), and that the policy rejects.

    One bitwise aggregation over the distinct bit patterns; texts are not read again. No documents: no rows.
    """
    patterns = ledgers.groupBy(F.col("ledger.failed").alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    cases = F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(mask).cast("long").alias("mask"), F.lit(rule).alias("rule"), F.lit(BIT[rule]).cast("long").alias("bit"))
        for p, mask in POLICIES.items() for rule, _ in RULES if mask & BIT[rule]]))
    rows = patterns.select("n", "failed", cases.alias("c")).select("n", "c.*", F.col("failed").bitwiseAND(F.col("c.mask")).alias("hit"))
    return rows.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("hit") != 0, F.col("n")).otherwise(0)).alias("n_rejected"))
