"""Fill-in-middle texts by one counted match per document, inside the JVM.

A text is a sequence of units: a word with the white space before it, or white space at the end.
`regexp_count` gives their number, hashes of the id give two places among them, and one pattern made
for the row, `(unit{a}+)(unit{b-a}+)(.*)`, captures prefix, middle and suffix in a single match, which
a replacement puts into the new order. The possessive counts keep Java's matcher iterative: its stack
does not grow with the text and nothing is tried twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The units of a text, and the marks before prefix, suffix and middle.
UNIT = r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

PSM = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"
SPM = f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of `seed:id`; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def infilled(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """`docs` with one more column `infill`: struct(n, form, output).

    `n` is the number of units and `form` one of plain, psm and spm. Of all texts about `percent` in a
    hundred are rearranged, of these `spm_percent` in the order suffix, prefix, middle. A text that is
    empty or null (`output` is then empty) or holds a mark stays plain. Rows with one id are cut by the
    same draws; other columns are kept, a column named `infill` is replaced. An empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = draws(id_col, seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    n = F.regexp_count(text, F.lit(UNIT)).cast("long")
    drawn = docs.withColumn("infill", F.struct(n.alias("n"), form.alias("form")))
    ends = [x % (F.col("infill.n") + 1) for x in h[:2]]
    a, b = F.least(*ends), F.greatest(*ends)
    pattern = F.format_string(rf"(?s)\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)(.*)\z", a, b - a)
    order = F.when(F.col("infill.form") == "spm", SPM).otherwise(PSM)
    output = F.when(F.col("infill.form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order))
    return drawn.withColumn("infill", F.struct("infill.n", "infill.form", output.alias("output")))


def restored(form: Column, output: Column) -> Column:
    """The text that became `output` in this form."""
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\z", "$2$3$1")
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\z", "$1$3$2")
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def part_lengths(form: Column, output: Column) -> tuple[Column, Column]:
    """Code points of prefix and middle; null for a plain text."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    size = len(PREFIX)
    prefix = F.when(form == "spm", m - p - size).when(form == "psm", s - p - size)
    middle = F.when(form != "plain", F.length(output) - m - (size - 1))
    return prefix.cast("long"), middle.cast("long")
